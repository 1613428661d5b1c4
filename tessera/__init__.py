"""A PySpark-native engine for embedding analytics and dataset processing."""
