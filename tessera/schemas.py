"""Schemas of the records that the engine reads and writes, as DDL.  Nothing is inferred."""

from __future__ import annotations

#: A line of a raw record dump; ``created_utc`` may be an integer, a string or a float.
RAW_ENTRY = (
    "url string, over_18 boolean, title string, author string, selftext string, subreddit string, "
    "created_utc string, post_hint string, id string"
)
#: An entry after fetching and encoding.
PROCESSED_ENTRY = (
    "url string, id string, title string, subreddit string, author string, timestamp long, embedding array<float>, "
    "metadata struct<mime_type:string,original_file_size:long,dimension:struct<width:int,height:int>,final_url:string>"
)
#: A stored file; ``frame`` is set for frames of a video container.
FILES = (
    "container string, frame int, embedding_time long, ocr_time long, thumbnail_time long, embedding array<float>, ocr string, "
    "ocr_segments array<struct<coords:struct<x:int,y:int,w:int,h:int>,text:string>>, thumbnails array<string>, "
    "metadata struct<width:int,height:int,frames:int>"
)
PREDEFINED = ("name string, embedding array<float>")
TERM = ("embedding array<float>, image string, text string, predefined_embedding string, weight double")
RATING = ("meme1 string, meme2 string, rating string, iteration string, ip string")
TELEMETRY = ("correlationId string, data string, event string, instanceId string, page string")
TRAINING_LOG = ("loss double, step long, time double, val_loss map<string,double>")
PACKED_NODE = (
    "id long, embedding array<float>, neighbours array<long>, timestamp long, scores array<double>, url string, shards array<int>, dead boolean"
)
