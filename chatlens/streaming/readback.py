"""Read-time side of T1/T2: spine, gap fill and top-k over stored buckets.

Stored buckets hold every window the watermark has closed. Given the
messages table as well, the newest still-open windows (and, for tools, the
partial hour at the start of the 7-day window) are counted from messages
with literal time bounds, so the answer is exactly the batch report's while
reading only the sink plus a short tail of messages.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions.predicates import between_times, since
from chatlens.functions.timefns import (DAY, HOUR, day_bucket, hour_bucket, ntz,
                                        resolve_as_of, truncate_day, truncate_hour)
from chatlens.operators.ranking import top_k
from chatlens.operators.spine import gap_fill, time_spine
from chatlens.sources.tables import ChatTables


def _closed_until(buckets: DataFrame, width: dt.timedelta) -> dt.datetime | None:
    """End of the newest stored bucket (one scalar from the sink)."""
    newest = buckets.agg(F.max("bucket").alias("b")).first().b
    return None if newest is None else newest + width


STREAM_BUCKET = HOUR  # width of the T1/T2 windows the sinks hold


def _open_messages(buckets: DataFrame, tables: ChatTables) -> DataFrame:
    """The messages that no stored bucket covers (all, while none is stored)."""
    closed = _closed_until(buckets, STREAM_BUCKET)
    if closed is None:
        return tables.messages.filter(F.col("timestamp").isNotNull())
    return tables.messages.filter(since("timestamp", closed,
                                        date_partition=tables.messages_date_partitioned))


def _bucketed() -> F.Column:
    return hour_bucket(F.col("timestamp")).alias("bucket")


def all_activity_buckets(buckets: DataFrame, tables: ChatTables) -> DataFrame:
    """T1 without a gap at the end: the stored buckets and those still open."""
    rest = (_open_messages(buckets, tables).groupBy(_bucketed())
            .agg(F.count(F.lit(1)).alias("messages"),
                 F.count_if(F.col("error").isNotNull()).alias("errors")))
    return buckets.select(*rest.columns).unionByName(rest)


def all_tool_buckets(buckets: DataFrame, tables: ChatTables) -> DataFrame:
    """T2 without a gap at the end. A window counts as closed when any tool's
    bucket at or after it is stored."""
    rest = (_open_messages(buckets, tables).filter(F.col("tools_used").isNotNull())
            .select(_bucketed(), F.explode("tools_used").alias("tool"))
            .groupBy("bucket", "tool").agg(F.count(F.lit(1)).alias("count")))
    return buckets.select(*rest.columns).unionByName(rest)


def activity_from_buckets(spark: SparkSession, buckets: DataFrame,
                          as_of: dt.datetime | None = None, hourly: bool = True,
                          tables: ChatTables | None = None) -> DataFrame:
    """R2 (hourly) or R3 (daily) from stored hourly T1 buckets.

    Hourly buckets are summed into the report's buckets. Without ``tables``
    the still-open newest windows are missing; with them, those windows are
    counted from messages and the result equals the batch report.
    """
    now = resolve_as_of(as_of)
    if hourly:
        step, bucket_fn = "1 HOUR", hour_bucket
        first, last, end = truncate_hour(now - 23 * HOUR), truncate_hour(now), truncate_hour(now) + HOUR
    else:
        step, bucket_fn = "1 DAY", day_bucket
        first, last, end = truncate_day(now - 13 * DAY), truncate_day(now), truncate_day(now) + DAY
    stored = buckets.filter((F.col("bucket") >= ntz(first)) & (F.col("bucket") < ntz(end)))
    parts = stored.select("bucket", "messages", "errors")
    if tables is not None:
        closed = _closed_until(buckets, STREAM_BUCKET) or first
        if closed < end:
            lower = max(closed, first)
            parts = parts.filter(F.col("bucket") < ntz(lower)).unionByName(
                tables.messages.filter(between_times(
                    "timestamp", lower, end, date_partition=tables.messages_date_partitioned))
                .groupBy(hour_bucket(F.col("timestamp")).alias("bucket"))
                .agg(F.count(F.lit(1)).alias("messages"),
                     F.count_if(F.col("error").isNotNull()).alias("errors")))
    rows = parts.select(bucket_fn(F.col("bucket")).alias("bucket"), "messages", "errors")
    return gap_fill(time_spine(spark, first, last, step), rows, "bucket",
                    ("messages", "errors"))


def top_tools_from_buckets(buckets: DataFrame, as_of: dt.datetime | None = None,
                           limit: int = 8, days: int = 7,
                           tables: ChatTables | None = None) -> DataFrame:
    """R4 from stored hourly T2 buckets.

    Without ``tables`` it is bucket-edge approximate: the oldest hour is taken
    whole and open windows are missing. With them, the partial first hour and
    the open tail are counted from messages and the result is exact.
    """
    now = resolve_as_of(as_of)
    start = now - days * DAY
    order = [F.col("count").desc(), F.col("tool").asc_nulls_last()]
    if tables is None:
        counts = (buckets.filter(F.col("bucket") >= ntz(truncate_hour(start)))
                  .groupBy("tool").agg(F.sum("count").cast("long").alias("count")))
        return top_k(counts, order, limit)
    full_from = truncate_hour(start) if truncate_hour(start) == start \
        else truncate_hour(start) + HOUR
    closed = _closed_until(buckets, STREAM_BUCKET) or full_from
    part = tables.messages_date_partitioned
    stored = (buckets.filter((F.col("bucket") >= ntz(full_from)) & (F.col("bucket") < ntz(closed)))
              .select("tool", "count"))
    m = tables.messages.filter(F.col("tools_used").isNotNull())
    edge = m.filter(between_times("timestamp", start, max(full_from, start), date_partition=part)
                    if full_from > start else F.lit(False))
    tail = m.filter(since("timestamp", max(closed, full_from), date_partition=part))
    live = (edge.unionByName(tail).select(F.explode("tools_used").alias("tool"))
            .groupBy("tool").agg(F.count(F.lit(1)).alias("count")))
    counts = (stored.unionByName(live).groupBy("tool")
              .agg(F.sum("count").cast("long").alias("count")))
    return top_k(counts, order, limit)
