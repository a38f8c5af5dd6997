"""HTTP dates, as the Last-Modified header has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_http_date(text: Column) -> Column:
    """The weekday is skipped, as it carries nothing; null if it is no date. The session's time zone should be UTC."""
    return F.try_to_timestamp(F.substring(text, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z"))


def format_http_date(time: Column) -> Column:
    return F.date_format(time, "E, dd MMM yyyy HH:mm:ss 'GMT'")
