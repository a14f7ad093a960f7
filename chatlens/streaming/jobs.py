"""Keep activity, tool counts and conversation rollups current.

Instead of queries run again on a timer, arriving messages (files
landing in a folder, or any streaming source with the messages schema) feed
incremental aggregations:

* T4 ``dedup_messages``: drop repeated message ids within the watermark.
* T1 ``activity_buckets``: tumbling-window message/error counts, append mode
  (a bucket is written once its window closes behind the watermark).
* T2 ``tool_buckets``: per-window counts of each tool name.
* T3 ``rollup_upserts``: per-conversation running totals in update mode; each
  micro-batch's changed rows are written under their batch id and readers take
  the latest version per conversation. Sum and count of latency are kept so
  the mean stays exact.

``withWatermark`` needs a zoned TIMESTAMP, so the NTZ ``timestamp`` is mapped
to an ``event_time`` instant with the same UTC wall clock, and window starts
are mapped back; neither step depends on the session time zone.
Checkpoints go under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatlens import schema as S
from chatlens.functions.timefns import instant_to_ntz, ntz_to_instant
from chatlens.operators.rollups import rollup_states
from chatlens.session import checkpoint_root

EVENT_TIME = "event_time"


def message_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Messages arriving as files under ``path`` (declared schema)."""
    reader = spark.readStream.schema(S.MESSAGES).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_event_time(reader.load(path))


def with_event_time(messages: DataFrame) -> DataFrame:
    return messages.withColumn(EVENT_TIME, ntz_to_instant("timestamp"))


def dedup_messages(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T4: one row per message id; a repeat later than the watermark is late
    data and dropped with it."""
    return (messages.withWatermark(EVENT_TIME, delay)
            .dropDuplicatesWithinWatermark(["id"]))


def _bucket_start(window_col: str = "window") -> F.Column:
    return instant_to_ntz(F.col(f"{window_col}.start"))


def activity_buckets(messages: DataFrame, width: str = "1 hour",
                     delay: str = "1 hour", watermarked: bool = False) -> DataFrame:
    """``bucket, messages, errors`` per tumbling window of ``width``."""
    src = messages if watermarked else messages.withWatermark(EVENT_TIME, delay)
    return (src.groupBy(F.window(EVENT_TIME, width))
            .agg(F.count(F.lit(1)).alias("messages"),
                 F.count_if(F.col("error").isNotNull()).alias("errors"))
            .select(_bucket_start().alias("bucket"), "messages", "errors"))


def tool_buckets(messages: DataFrame, width: str = "1 hour",
                 delay: str = "1 hour", watermarked: bool = False) -> DataFrame:
    """``bucket, tool, count`` per tumbling window (NULL tool kept)."""
    src = messages if watermarked else messages.withWatermark(EVENT_TIME, delay)
    return (src.filter(F.col("tools_used").isNotNull())
            .select(EVENT_TIME, F.explode("tools_used").alias("tool"))
            .groupBy(F.window(EVENT_TIME, width), "tool")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(_bucket_start().alias("bucket"), "tool", "count"))


def rollup_upserts(messages: DataFrame) -> DataFrame:
    """Running per-conversation totals (emit in update mode)."""
    return rollup_states(messages)


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    return checkpoint or f"{checkpoint_root(spark)}/streams/{name}"


def start_bucket_sink(buckets: DataFrame, path: str, name: str,
                      checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append closed buckets to a parquet folder (exactly-once file sink)."""
    spark = buckets.sparkSession
    writer = (buckets.writeStream.outputMode("append").format("parquet")
              .option("path", path)
              .option("checkpointLocation", _checkpoint(spark, name, checkpoint)))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.queryName(name).start()


def start_rollup_sink(upserts: DataFrame, path: str, name: str = "conversation_rollup",
                      checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch's changed rollup rows under ``batch_id=N``.

    A replayed batch overwrites its own folder, so a retry after a lost
    executor or driver leaves exactly one copy.
    """
    spark = upserts.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # the folder name carries the batch id (read back as a partition column)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (upserts.writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", _checkpoint(spark, name, checkpoint)))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.queryName(name).start()


def _latest(versions: DataFrame) -> DataFrame:
    cols = [c for c in versions.columns if c != "conversation_id"]
    return (versions.groupBy("conversation_id")
            .agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("r"))
            .select("conversation_id", "r.*"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _snapshot(spark: SparkSession, snapshot_path: str) -> DataFrame | None:
    """The newest version below ``snapshot_path`` (folders ``upto=<batch>``)."""
    if not _exists(spark, snapshot_path):
        return None
    versions = spark.read.parquet(snapshot_path)
    newest = versions.agg(F.max("upto")).first()[0]
    return versions.filter(F.col("upto") == F.lit(newest)).drop("upto")


def compact_conversation_rollup(spark: SparkSession, path: str, snapshot_path: str) -> int:
    """Write the latest version of every conversation (a snapshot carrying
    ``batch_id``) to a new folder ``upto=<batch>`` below ``snapshot_path``;
    returns the newest batch it covers.

    A snapshot is made from the one before and the newer batch folders, so
    batch folders that a snapshot covers may be dropped by the operator, and
    so may older snapshots. Readers take the newest.
    """
    versions = spark.read.parquet(path)
    before = _snapshot(spark, snapshot_path)
    if before is not None:
        covered = before.agg(F.max("batch_id")).first()[0]
        newer = versions.filter(F.col("batch_id") > F.lit(covered))
        if newer.isEmpty():
            return covered
        versions = before.unionByName(newer)
    upto = versions.agg(F.max("batch_id")).first()[0]
    _latest(versions).write.mode("overwrite").parquet(f"{snapshot_path}/upto={upto}")
    return upto


def latest_conversation_rollup(spark: SparkSession, path: str,
                               snapshot_path: str | None = None) -> DataFrame:
    """The newest version of every conversation's rollup, with the rounded
    mean latency computed from the kept sum and count.

    With ``snapshot_path`` (from ``compact_conversation_rollup``) only batch
    folders newer than the snapshot are read.
    """
    versions = spark.read.parquet(path)
    snap = _snapshot(spark, snapshot_path) if snapshot_path else None
    if snap is not None:  # before the first compaction there are only batches
        covered = snap.agg(F.max("batch_id")).first()[0]
        newer = versions.filter(F.col("batch_id") > F.lit(covered)) if covered is not None \
            else versions
        versions = snap.unionByName(newer.select(*snap.columns))
    latest = _latest(versions).drop("batch_id")
    mean = F.round(F.col("latency_sum") / F.col("latency_count"), 0).cast("long")
    return latest.withColumn("avg_assistant_response_time_ms",
                             F.when(F.col("latency_count") > 0, mean))
