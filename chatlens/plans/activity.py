"""Gap-filled message and error counts per hour (24) and day (14).

The reference counts messages since ``as_of - 24 h`` (``- 14 d``) and then
keeps only the buckets of a spine that starts at ``trunc(as_of - 23 h)``
(``- 13 d``) and ends at ``trunc(as_of)``: rows of the oldest partial bucket
and of buckets after ``as_of`` are counted and then dropped by the join.
Here the row filter is narrowed to exactly the spine's range (the same rows
survive, less is read) and the spine's zero rows are summed in with them in
one aggregation (``operators.spine.gap_fill``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions.predicates import between_times
from chatlens.functions.timefns import (DAY, HOUR, day_bucket, hour_bucket,
                                        resolve_as_of, truncate_day,
                                        truncate_hour)
from chatlens.operators.spine import gap_fill, time_spine
from chatlens.sources.tables import ChatTables

# Spine lengths of the two charts.
HOURLY_BUCKETS = 24
DAILY_BUCKETS = 14


def _activity(spark: SparkSession, tables: ChatTables, first: dt.datetime,
              last: dt.datetime, step: dt.timedelta, step_sql: str,
              bucket_fn) -> DataFrame:
    window = between_times("timestamp", first, last + step,
                           date_partition=tables.messages_date_partitioned)
    rows = tables.messages.filter(window).select(
        bucket_fn(F.col("timestamp")).alias("bucket"),
        F.lit(1).alias("messages"),
        F.col("error").isNotNull().cast("int").alias("errors"))
    spine = time_spine(spark, first, last, step_sql)
    return gap_fill(spine, rows, "bucket", ("messages", "errors"))


def activity_hourly(spark: SparkSession, tables: ChatTables,
                    as_of: dt.datetime | None = None) -> DataFrame:
    """R2: 24 rows ``bucket, messages, errors`` ending at ``trunc_hour(as_of)``."""
    now = resolve_as_of(as_of)
    last = truncate_hour(now)
    first = truncate_hour(now - (HOURLY_BUCKETS - 1) * HOUR)
    return _activity(spark, tables, first, last, HOUR, "1 HOUR", hour_bucket)


def activity_daily(spark: SparkSession, tables: ChatTables,
                   as_of: dt.datetime | None = None) -> DataFrame:
    """14 rows ``bucket, messages, errors`` ending at ``trunc_day(as_of)``."""
    now = resolve_as_of(as_of)
    last = truncate_day(now)
    first = truncate_day(now - (DAILY_BUCKETS - 1) * DAY)
    return _activity(spark, tables, first, last, DAY, "1 DAY", day_bucket)
