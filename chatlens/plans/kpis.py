"""R1 (dashboard KPIs) and R11 (table health) as small aggregates side by side.

Each figure is read from the least that holds it: totals and the newest time
from the day counts, where the tables carry them, or else from the time
column alone; everything windowed from a slice bounded by the longest of its
windows, which prunes day folders; the latencies from a histogram of the
7-day sample (one row for each distinct latency, however many messages).
Every branch ends in one row after a distributed aggregation, and the rows
are merged by a union, so there is no join and no cross join.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.coercion import to_int
from chatlens.functions.predicates import assistant_latency_sample, between_times, since
from chatlens.functions.timefns import DAY, HOUR, ntz, resolve_as_of, truncate_day
from chatlens.sources.tables import ChatTables


def _one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row results as one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _since(tables: ChatTables, start: dt.datetime, strict: bool = False) -> DataFrame:
    return tables.messages.filter(since(
        "timestamp", start, strict=strict, date_partition=tables.messages_date_partitioned))


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def latency_histogram(tables: ChatTables, since_ts: dt.datetime) -> DataFrame:
    """``response_time_ms, weight`` over the assistant latency sample.

    From the stored histograms of whole hours, where the tables carry them, and the part of the
    first hour from messages; else from messages alone."""
    if tables.latency_hours is not None:
        hour = since_ts.replace(minute=0, second=0, microsecond=0)
        whole = hour if hour == since_ts else hour + HOUR
        stored = tables.latency_hours.filter(since("hour", whole, date_partition=True))
        part = tables.messages.filter(between_times("timestamp", since_ts, whole, date_partition=tables.messages_date_partitioned)
                                      & assistant_latency_sample()) if whole > since_ts else None
        rows = stored.select("response_time_ms", "weight")
        if part is not None:
            rows = rows.unionByName(part.select("response_time_ms", F.lit(1).cast("long").alias("weight")))
        return rows.groupBy("response_time_ms").agg(F.sum("weight").alias("weight"))
    sample = _since(tables, since_ts).filter(assistant_latency_sample())
    return sample.groupBy("response_time_ms").agg(F.count(F.lit(1)).alias("weight"))


def _all_messages(tables: ChatTables) -> DataFrame:
    """``messages`` and ``last_timestamp`` over all history."""
    if tables.message_days is not None:
        return tables.message_days.agg(
            F.coalesce(F.sum("messages"), F.lit(0)).cast("long").alias("messages"),
            F.max("last_timestamp").alias("last_timestamp"))
    return tables.messages.agg(F.count(F.lit(1)).alias("messages"),
                               F.max("timestamp").alias("last_timestamp"))


def _all_errors(tables: ChatTables) -> DataFrame:
    if tables.message_days is not None:
        return tables.message_days.agg(
            F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"))
    return _rows(tables.messages.filter(F.col("error").isNotNull()), "errors")


def _active_users(tables: ChatTables, today: dt.datetime) -> DataFrame:
    """A3: users with a conversation active since midnight, from the days' bitmaps where the tables carry them."""
    if tables.active_days is not None:
        merged = (tables.active_days.filter(F.col("day") >= F.lit(today.date()))
                  .groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n")))
        return merged.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("active_users_today"))
    return _rows(tables.conversations.filter((F.col("last_message_at") >= ntz(today))
                                             & F.col("user_id").isNotNull())
                 .select("user_id").distinct(), "active_users_today")


def kpi_stats(tables: ChatTables, as_of: dt.datetime | None = None) -> DataFrame:
    """One row of twelve KPIs plus ``generated_at`` (= as_of)."""
    now = resolve_as_of(as_of)
    today = truncate_day(now)
    lat, weight = F.col("response_time_ms"), F.col("weight")
    merged = _one_row(
        _rows(tables.users, "total_users"),
        _rows(tables.conversations, "total_conversations"),
        _all_messages(tables).withColumnsRenamed(
            {"messages": "total_messages", "last_timestamp": "last_message_at"}),
        # midnight is never before the start of the last 24 hours
        _since(tables, now - 24 * HOUR).agg(
            _count_if(F.col("timestamp") >= ntz(today), "messages_today"),
            F.count(F.lit(1)).alias("messages_24h"),
            _count_if(F.col("error").isNotNull(), "errors_24h"),
            _count_if(F.col("role") == "assistant", "assistant_messages_24h")),
        _active_users(tables, today),
        latency_histogram(tables, now - 7 * DAY).agg(
            F.round(F.sum(lat.cast("long") * weight) / F.sum(weight), 0).cast("long").alias("_mean"),
            F.percentile(lat, F.lit(0.5), weight).alias("_p50"),
            F.percentile(lat, F.lit(0.95), weight).alias("_p95")))
    return merged.select(
        ntz(now).alias("generated_at"),
        "total_users", "total_conversations", "total_messages",
        "messages_today", "messages_24h", "errors_24h",
        "assistant_messages_24h", "active_users_today", "last_message_at",
        to_int("_mean").alias("avg_response_time_ms_7d"),
        to_int("_p50").alias("p50_response_time_ms_7d"),
        to_int("_p95").alias("p95_response_time_ms_7d"),
    )


def table_health(tables: ChatTables, as_of: dt.datetime | None = None) -> DataFrame:
    """Row totals, messages in the last hour (strict ``>``), all errors."""
    now = resolve_as_of(as_of)
    return _one_row(
        _rows(tables.users, "users"), _rows(tables.conversations, "conversations"),
        _all_messages(tables).select("messages"),
        _rows(_since(tables, now - HOUR, strict=True), "messages_last_hour"),
        _all_errors(tables),
    ).select(ntz(now).alias("server_time"), "users", "conversations",
             "messages", "messages_last_hour", "errors")
