"""Schemas of the tables of a search index."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LONG, INT, STRING, BOOL, DOUBLE, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.TimestampType()

PAGE = _struct(page_id=LONG, url=STRING, crawled_time=TIME, indexed_time=TIME, title=STRING, description=STRING, page_rank=DOUBLE)
PAGE_TEXT = _struct(page_id=LONG, url=STRING, title=STRING, description=STRING, tokens=T.ArrayType(STRING))
FRONTIER = _struct(id=LONG, url=STRING)
EDGES = _struct(src=LONG, dst=LONG)
POSTINGS = _struct(word=STRING, page_id=LONG, count=LONG, important=BOOL, positions=T.ArrayType(INT))
DOCUMENT_FREQUENCY = _struct(word=STRING, pages_count=LONG)
IMAGES = _struct(image_id=LONG, url=STRING, description=STRING)
IMAGE_POSTINGS = _struct(word=STRING, image_id=LONG)
IMAGE_FREQUENCY = _struct(word=STRING, images_count=LONG)
USERS = _struct(user=INT)
HISTORY = _struct(user=INT, page_id=LONG, times=INT)
QUERIES = _struct(text=STRING)
RESULTS = _struct(page_id=LONG, url=STRING, title=STRING, snippet=STRING, relevance=DOUBLE, score=DOUBLE, important=LONG, is_phrase=LONG, visited=BOOL)
IMAGE_RESULTS = _struct(image_id=LONG, url=STRING, matched=LONG)
