"""Run the streaming jobs over a stream of messages until it has no more.

Each call starts the real incremental operators (watermarks, windows, state,
``foreachBatch``) on a stream with the messages schema, waits until all
available files are taken in and returns what the sink holds. Sinks and
checkpoints go into a fresh folder under the cluster's shared checkpoint
folder; the messages themselves are not copied. Given the tables too, the
windows that the watermark has not closed are counted from messages, so the
answers are whole.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.schema import MESSAGE_COLUMNS
from chatlens.session import checkpoint_root
from chatlens.sources.tables import ChatTables
from chatlens.streaming import additive, jobs, readback


def _workdir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/chatlens-replay/{name}-{uuid.uuid4().hex}"


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream {query.name} failed: {query.exception()}")


def _closed_windows(stream: DataFrame, job, name: str, delay: str) -> DataFrame:
    spark = stream.sparkSession
    work = _workdir(spark, name)
    buckets = job(jobs.with_event_time(stream), "1 hour", delay)
    _run(jobs.start_bucket_sink(buckets, f"{work}/out", f"{name}-{work[-8:]}",
                                checkpoint=f"{work}/ckpt"))
    return spark.read.parquet(f"{work}/out")


def replay_activity_buckets(stream: DataFrame, tables: ChatTables,
                            delay: str = "1 hour") -> DataFrame:
    """Messages and errors of every hour that has any."""
    closed = _closed_windows(stream, jobs.activity_buckets, "t1", delay)
    return readback.all_activity_buckets(closed, tables)


def replay_tool_buckets(stream: DataFrame, tables: ChatTables,
                        delay: str = "1 hour") -> DataFrame:
    """Uses of each tool in every hour that has any."""
    closed = _closed_windows(stream, jobs.tool_buckets, "t2", delay)
    return readback.all_tool_buckets(closed, tables)


def replay_activity(stream: DataFrame, tables: ChatTables, as_of: dt.datetime | None = None,
                    hourly: bool = True, delay: str = "1 hour") -> DataFrame:
    """R2 or R3 from the buckets that T1 keeps and the open windows."""
    closed = _closed_windows(stream, jobs.activity_buckets, "t1", delay)
    return readback.activity_from_buckets(stream.sparkSession, closed, as_of, hourly, tables)


def replay_top_tools(stream: DataFrame, tables: ChatTables, as_of: dt.datetime | None = None,
                     limit: int = 8, delay: str = "1 hour") -> DataFrame:
    """R4 from the buckets that T2 keeps, the open windows and the first part hour."""
    closed = _closed_windows(stream, jobs.tool_buckets, "t2", delay)
    return readback.top_tools_from_buckets(closed, as_of, limit, tables=tables)


def replay_conversation_rollup(stream: DataFrame, tables: ChatTables | None = None) -> DataFrame:
    """The latest rollup of each conversation."""
    spark = stream.sparkSession
    work = _workdir(spark, "t3")
    _run(jobs.start_rollup_sink(jobs.rollup_upserts(jobs.with_event_time(stream)), f"{work}/out",
                                f"t3-{work[-8:]}", checkpoint=f"{work}/ckpt"))
    return jobs.latest_conversation_rollup(spark, f"{work}/out")


def late_waves(tables: ChatTables, waves: int = 4) -> str:
    """The messages landed as files of ``waves`` arrivals, the newest days first: all but the first wave's rows
    are days too late for any watermark. Returns the folder."""
    spark = tables.messages.sparkSession
    inbox = _workdir(spark, "late")
    turn = F.coalesce(F.pmod(-F.dayofmonth("timestamp"), F.lit(waves)), F.lit(0))
    for k in range(waves):
        # later arrivals get later file times, which is the order that a stream of files takes
        (tables.messages.select(MESSAGE_COLUMNS).filter(turn == k).coalesce(1).write.mode("append").parquet(inbox))
    return inbox


def replay_states(tables: ChatTables, spec: additive.StateSpec, name: str, waves: int = 4) -> DataFrame:
    """Merged states of a stream whose rows come late, one wave to a micro-batch."""
    spark = tables.messages.sparkSession
    inbox, work = late_waves(tables, waves), _workdir(spark, name)
    stream = jobs.message_stream(spark, inbox, max_files_per_trigger=1)
    _run(additive.start_states(stream, spec, f"{work}/out", f"{name}-{work[-8:]}", checkpoint=f"{work}/ckpt"))
    return additive.read_states(spark, spec, f"{work}/out")


def replay_dedup(stream: DataFrame, tables: ChatTables | None = None, copies: int = 2,
                 delay: str = "1 hour") -> DataFrame:
    """T4 over the stream arriving ``copies`` times: one row per message id."""
    spark = stream.sparkSession
    work = _workdir(spark, "t4")
    repeated = stream
    for _ in range(copies - 1):
        repeated = repeated.unionAll(stream)
    deduped = jobs.dedup_messages(jobs.with_event_time(repeated), delay).drop(jobs.EVENT_TIME)
    _run(deduped.writeStream.format("parquet").option("path", f"{work}/out")
         .option("checkpointLocation", f"{work}/ckpt").trigger(availableNow=True)
         .queryName(f"t4-{work[-8:]}").start())
    return spark.read.parquet(f"{work}/out")
