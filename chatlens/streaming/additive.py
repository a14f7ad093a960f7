"""T1-T3 with late rows and without state: partial states of each micro-batch, merged when read.

A watermark drops rows that come too late, and running totals keep a state row for each
key for ever. Here each micro-batch is aggregated on its own and its partial states (counts,
sums, least and greatest times) are written under its batch id. Nothing is kept
between batches, no row is too late, and a batch that is run again replaces its own folder. Readers merge the
batches; ``compact_states`` folds them into a snapshot, so that reading doesn't grow
with the stream's age.

    path/batches/batch_id=N     states of one micro-batch
    path/snapshots/upto=N       all batches up to N, merged

A folder counts once it is complete (``_SUCCESS``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatlens.functions.predicates import between_times
from chatlens.functions.timefns import DAY, HOUR, day_bucket, hour_bucket, ntz, resolve_as_of, truncate_day, truncate_hour
from chatlens.operators.ranking import top_k
from chatlens.operators.rollups import ROLLUP_MERGE, finish_rollup, rollup_states
from chatlens.operators.spine import gap_fill, time_spine
from chatlens.session import checkpoint_root
from chatlens.sources.tables import ChatTables


@dataclass(frozen=True)
class StateSpec:
    """States by ``keys``: how rows become states, and how states are merged."""

    keys: tuple[str, ...]
    merge: dict[str, str]
    states: Callable[[DataFrame], DataFrame]
    schema: str

    def merged(self, frames: list[DataFrame]) -> DataFrame:
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        return reduce(DataFrame.unionByName, frames).groupBy(*self.keys).agg(*[how[m](c).alias(c) for c, m in self.merge.items()])


def _hour():
    return hour_bucket(F.col("timestamp")).alias("bucket")


def _activity(messages: DataFrame) -> DataFrame:
    return (messages.filter(F.col("timestamp").isNotNull()).groupBy(_hour())
            .agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("error").isNotNull()).alias("errors")))


def _tools(messages: DataFrame) -> DataFrame:
    return (messages.filter(F.col("timestamp").isNotNull() & F.col("tools_used").isNotNull())
            .select(_hour(), F.explode("tools_used").alias("tool")).groupBy("bucket", "tool").agg(F.count(F.lit(1)).alias("count")))


ACTIVITY = StateSpec(("bucket",), {"messages": "sum", "errors": "sum"}, _activity, "bucket timestamp_ntz, messages long, errors long")
TOOLS = StateSpec(("bucket", "tool"), {"count": "sum"}, _tools, "bucket timestamp_ntz, tool string, count long")
ROLLUP = StateSpec(
    ("conversation_id",), ROLLUP_MERGE, rollup_states,
    "conversation_id long, total_messages long, user_messages long, assistant_messages long, error_count long, latency_sum long, "
    "latency_count long, first_message_at timestamp_ntz, last_message_at timestamp_ntz, last_error_at timestamp_ntz")


def start_states(messages: DataFrame, spec: StateSpec, path: str, name: str, checkpoint: str | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Write the states of each micro-batch of a message stream below ``path``."""
    spark = messages.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spec.states(batch).write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")

    where = checkpoint or f"{checkpoint_root(spark)}/streams/{name}"
    writer = messages.writeStream.foreachBatch(write_batch).option("checkpointLocation", where)
    return writer.trigger(**(trigger or {"availableNow": True})).queryName(name).start()


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete folders ``<label>=<number>`` below ``folder``, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.split("=")[1]) for n in names if "=" in n and fs.exists(done(f"{folder}/{n}/_SUCCESS")))


def _frames(spark: SparkSession, spec: StateSpec, path: str) -> tuple[int, list[int], list[DataFrame]]:
    """The newest snapshot's number (-1: none), the batches after it, and the states of all of them."""
    upto = max(_complete(spark, f"{path}/snapshots"), default=-1)
    after = [n for n in _complete(spark, f"{path}/batches") if n > upto]
    folders = [f"{path}/snapshots/upto={upto}"] * (upto >= 0) + [f"{path}/batches/batch_id={n}" for n in after]
    return upto, after, [spark.read.schema(spec.schema).parquet(f) for f in folders]


def read_states(spark: SparkSession, spec: StateSpec, path: str) -> DataFrame:
    """The merged states of everything that has arrived; no rows before the first batch."""
    _, _, frames = _frames(spark, spec, path)
    return spec.merged(frames or [spark.createDataFrame([], spec.schema)])


def compact_states(spark: SparkSession, spec: StateSpec, path: str) -> int:
    """Fold the newest snapshot and the batches after it into a new snapshot; returns the newest batch it holds.

    Folders that it covers may be dropped by the operator. Readers at work go on with the old ones."""
    upto, after, frames = _frames(spark, spec, path)
    if after:
        upto = after[-1]
        spec.merged(frames).write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
    return upto


def activity_from_states(spark: SparkSession, states: DataFrame, as_of: dt.datetime | None = None, hourly: bool = True) -> DataFrame:
    """R2 (hourly) or R3 (daily) from the merged T1 states: late rows are in their buckets."""
    now = resolve_as_of(as_of)
    if hourly:
        step, bucket, first, last, end = "1 HOUR", hour_bucket, truncate_hour(now - 23 * HOUR), truncate_hour(now), truncate_hour(now) + HOUR
    else:
        step, bucket, first, last, end = "1 DAY", day_bucket, truncate_day(now - 13 * DAY), truncate_day(now), truncate_day(now) + DAY
    inside = states.filter((F.col("bucket") >= ntz(first)) & (F.col("bucket") < ntz(end)))
    rows = inside.select(bucket(F.col("bucket")).alias("bucket"), "messages", "errors")
    return gap_fill(time_spine(spark, first, last, step), rows, "bucket", ("messages", "errors"))


def top_tools_from_states(states: DataFrame, tables: ChatTables, as_of: dt.datetime | None = None, limit: int = 8, days: int = 7) -> DataFrame:
    """R4 from the merged T2 states; the part hour at the window's start comes from messages."""
    start = resolve_as_of(as_of) - days * DAY
    whole = truncate_hour(start) if truncate_hour(start) == start else truncate_hour(start) + HOUR
    rows = states.filter(F.col("bucket") >= ntz(whole)).select("tool", "count")
    if whole > start:
        edge = tables.messages.filter(F.col("tools_used").isNotNull() & between_times(
            "timestamp", start, whole, date_partition=tables.messages_date_partitioned))
        rows = rows.unionByName(edge.select(F.explode("tools_used").alias("tool"), F.lit(1).cast("long").alias("count")))
    counts = rows.groupBy("tool").agg(F.sum("count").cast("long").alias("count"))
    return top_k(counts, [F.col("count").desc(), F.col("tool").asc_nulls_last()], limit)


def rollup_from_states(states: DataFrame) -> DataFrame:
    """A10 from the merged T3 states."""
    return finish_rollup(states).drop("latency_sum", "latency_count")
