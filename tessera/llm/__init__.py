"""Operators for large training-data pipelines.

Nothing outside this package imports it.  Each module is one operator;
``queries`` registers one query per operator and the pipeline.
"""
