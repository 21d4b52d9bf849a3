"""Times as stores write them; what can't be read is null, never the present time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats: the two patterns below.


def utc_time(text: Column) -> Column:
    """yyyy-MM-dd'T'HH:mm:ss'Z'"""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def offset_time(text: Column) -> Column:
    """yyyy-MM-dd'T'HH:mm:ss.SSSXXX"""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))


def utc_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
