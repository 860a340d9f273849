"""Counts over windows of time, of streams or tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages_by_window(pages: DataFrame, time: str, key: str, length: str = "1 day", slide: str | None = None, late: str = "3 days", gap: str | None = None) -> DataFrame:
    """start, key, n: rows in each window of event time: tumbling, sliding with ``slide``, or sessions that end after ``gap``.

    On a stream rows later than ``late`` behind the latest time are dropped, and windows are given out and their state freed once they can get no more rows;
    the watermark does nothing to a table. Rows without a time are in no window; a null key is a key of its own.
    """
    if pages.isStreaming:  # a watermark wants a time with a zone: the session's
        pages = pages.withColumn(time, F.col(time).cast("timestamp"))
    window = F.session_window(time, gap) if gap else F.window(time, length, slide) if slide else F.window(time, length)
    rows = pages.filter(F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if pages.isStreaming else rows
    return rows.groupBy(window.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_deliveries(pages: DataFrame, time: str, key: str, late: str = "3 days") -> DataFrame:
    """The rows of a stream whose key has not been seen within ``late``: repeated deliveries are dropped with bounded state. Of a table, one row of each key."""
    return pages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if pages.isStreaming else pages.dropDuplicates([key])
