"""Streaming results on closed windows equal the batch reports."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from chatlens.functions.timefns import hour_bucket, ntz
from chatlens.operators.rollups import DETAIL_COLUMNS, conversation_rollup
from chatlens.plans import activity
from chatlens.schema import MESSAGE_COLUMNS
from chatlens.sources.fixtures import from_testdata
from chatlens.streaming import (activity_buckets, activity_from_buckets, dedup_messages,
                                latest_conversation_rollup, message_stream,
                                rollup_upserts, start_bucket_sink, start_rollup_sink,
                                tool_buckets, top_tools_from_buckets)
from chatlens.session import checkpoint_root
from tests.conftest import SF_MID

SPLIT = dt.datetime(2024, 1, 15)


@pytest.fixture(scope="module")
def landed(spark, scratch):
    """Messages landing in two waves, plus a wave that repeats some ids."""
    tables = from_testdata(spark, SF_MID)
    inbox = os.path.join(scratch, "inbox")
    m = tables.messages.select(*MESSAGE_COLUMNS)
    # one file per wave, in time order: the second wave is entirely newer
    # than the watermark left by the first, so nothing is late
    m.filter(F.col("timestamp") < ntz(SPLIT)).coalesce(1).write.parquet(inbox)
    m.filter(F.col("timestamp") >= ntz(SPLIT)).coalesce(1).write.mode("append").parquet(inbox)
    return tables, inbox


def _ckpt(spark, name):
    """A fresh checkpoint under the session's shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/chatlens-tests/{uuid.uuid4().hex}/{name}"


def _run(query):
    query.awaitTermination(300)
    assert query.exception() is None


def test_activity_buckets_equal_batch(spark, scratch, landed):
    tables, inbox = landed
    out = os.path.join(scratch, "hourly")
    stream = message_stream(spark, inbox, max_files_per_trigger=1)
    _run(start_bucket_sink(activity_buckets(stream), out, "t1_hourly",
                           checkpoint=_ckpt(spark, "t1")))
    got = {r.bucket: (r.messages, r.errors) for r in spark.read.parquet(out).collect()}
    batch = {r.bucket: (r.messages, r.errors) for r in
             tables.messages.groupBy(hour_bucket("timestamp").alias("bucket"))
             .agg(F.count(F.lit(1)).alias("messages"),
                  F.count_if(F.col("error").isNotNull()).alias("errors")).collect()}
    assert len(got) > 600
    assert all(batch[b] == v for b, v in got.items())
    # every bucket older than the newest emitted one is closed and present
    newest = max(got)
    assert {b for b in batch if b <= newest} == set(got)
    as_of = dt.datetime(2024, 1, 20, 12, 30)
    from_stream = activity_from_buckets(spark, spark.read.parquet(out), as_of).collect()
    from_batch = activity.activity_hourly(spark, tables, as_of).collect()
    assert from_stream == from_batch
    # at the end of the data some windows are still open: exact with the tail
    for as_of in (dt.datetime(2024, 1, 30, 18, 30), dt.datetime(2024, 1, 31, 0, 0)):
        exact = activity_from_buckets(spark, spark.read.parquet(out), as_of, tables=tables)
        assert exact.collect() == activity.activity_hourly(spark, tables, as_of).collect()
        daily = activity_from_buckets(spark, spark.read.parquet(out), as_of, hourly=False,
                                      tables=tables)
        assert daily.collect() == activity.activity_daily(spark, tables, as_of).collect()


def test_tool_buckets_top_k(spark, scratch, landed):
    tables, inbox = landed
    out = os.path.join(scratch, "tools")
    stream = message_stream(spark, inbox, max_files_per_trigger=1)
    _run(start_bucket_sink(tool_buckets(stream), out, "t2_tools",
                           checkpoint=_ckpt(spark, "t2")))
    buckets = spark.read.parquet(out)
    total_stream = buckets.agg(F.sum("count")).first()[0]
    closed = buckets.agg(F.max("bucket")).first()[0]
    total_batch = (tables.messages.filter(F.col("timestamp") <= ntz(closed + dt.timedelta(hours=1)))
                   .filter(F.col("timestamp") < ntz(closed + dt.timedelta(hours=1)))
                   .select(F.explode("tools_used")).count())
    assert total_stream == total_batch
    top = top_tools_from_buckets(buckets, dt.datetime(2024, 1, 20, 0, 0)).collect()
    assert 1 <= len(top) <= 8
    assert [r["count"] for r in top] == sorted((r["count"] for r in top), reverse=True)
    from chatlens.plans import tools
    for as_of in (dt.datetime(2024, 1, 20, 0, 0), dt.datetime(2024, 1, 30, 18, 30)):
        exact = top_tools_from_buckets(buckets, as_of, tables=tables).collect()
        assert exact == tools.top_tools(tables, as_of).collect()


def test_rollup_upserts_latest_equals_batch(spark, scratch, landed):
    tables, inbox = landed
    out = os.path.join(scratch, "rollup")
    stream = message_stream(spark, inbox, max_files_per_trigger=1)
    _run(start_rollup_sink(rollup_upserts(stream), out, "t3_rollup",
                           checkpoint=_ckpt(spark, "t3")))
    latest = latest_conversation_rollup(spark, out)
    cols = ["conversation_id", "total_messages", "user_messages", "assistant_messages",
            "error_count", "avg_assistant_response_time_ms", "first_message_at",
            "last_message_at"]
    got = sorted(tuple(r) for r in latest.select(*cols).collect())
    want = sorted(tuple(r) for r in
                  conversation_rollup(tables.messages, DETAIL_COLUMNS).select(*cols).collect())
    assert len(got) == len(want) and got == want
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1
    # compaction: the snapshot plus newer batches gives the same rollup
    from chatlens.streaming import compact_conversation_rollup
    snap = os.path.join(scratch, "rollup_snapshot")
    covered = compact_conversation_rollup(spark, out, snap)
    assert covered == spark.read.parquet(out).agg(F.max("batch_id")).first()[0]
    again = latest_conversation_rollup(spark, out, snapshot_path=snap)
    assert sorted(tuple(r) for r in again.select(*cols).collect()) == want
    # an older snapshot (first batch only) plus the newer folders, too
    from chatlens.streaming.jobs import _latest
    _latest(spark.read.parquet(out).filter(F.col("batch_id") == 0)) \
        .write.parquet(snap + "_old/upto=0")
    older = latest_conversation_rollup(spark, out, snapshot_path=snap + "_old")
    assert sorted(tuple(r) for r in older.select(*cols).collect()) == want
    # compacting on top of that snapshot, with the covered folder gone
    kept = os.path.join(scratch, "rollup_newer")
    spark.read.parquet(out).filter(F.col("batch_id") > 0).write.partitionBy("batch_id").parquet(kept)
    assert compact_conversation_rollup(spark, kept, snap + "_old") == covered
    assert compact_conversation_rollup(spark, kept, snap + "_old") == covered
    last = latest_conversation_rollup(spark, kept, snapshot_path=snap + "_old")
    assert sorted(tuple(r) for r in last.select(*cols).collect()) == want


def test_dedup_within_watermark(spark, scratch, landed):
    tables, inbox = landed
    dup_inbox = os.path.join(scratch, "inbox_dups")
    m = tables.messages.select(*MESSAGE_COLUMNS)
    m.repartition(2).write.parquet(dup_inbox)
    m.filter(F.col("id") % 3 == 0).repartition(1).write.mode("append").parquet(dup_inbox)
    out = os.path.join(scratch, "dedup")
    stream = message_stream(spark, dup_inbox)
    q = (dedup_messages(stream, "2 days").drop("event_time").writeStream
         .format("parquet").option("path", out)
         .option("checkpointLocation", _ckpt(spark, "t4"))
         .trigger(availableNow=True).start())
    _run(q)
    got = spark.read.parquet(out)
    assert got.count() == got.select("id").distinct().count() == tables.messages.count()


def test_late_rows_and_repeats(spark, scratch):
    """Three waves, one micro-batch each. Spark drops a row as late against
    the watermark of the previous batch, so the late rows and repeats come
    in wave 3: rows older than 11:40 are late, and a repeat of id 2 (not
    late) is removed by the id de-duplication that feeds the windows."""
    from chatlens import schema as S
    T = dt.datetime
    inbox = os.path.join(scratch, "late_inbox")
    waves = [
        [(1, 7, "user", "a", T(2024, 1, 1, 10, 5), None, None, None, None, None),
         (2, 7, "assistant", "b", T(2024, 1, 1, 12, 40), 30, ["sql"], None, None, "x")],
        [(4, 7, "user", "on time", T(2024, 1, 1, 14, 10), None, None, None, None, None)],
        [(3, 7, "user", "late", T(2024, 1, 1, 10, 50), None, None, None, None, None),
         (1, 7, "user", "a", T(2024, 1, 1, 10, 5), None, None, None, None, None),
         (2, 7, "assistant", "b", T(2024, 1, 1, 12, 40), 30, ["sql"], None, None, "x")],
    ]
    for i, wave in enumerate(waves):
        (spark.createDataFrame(wave, S.MESSAGES).coalesce(1).write
         .mode("append" if i else "errorifexists").parquet(inbox))

    def hourly(dedup: bool):
        out = os.path.join(scratch, f"late_hourly_{dedup}")
        stream = message_stream(spark, inbox, max_files_per_trigger=1)
        src = dedup_messages(stream, "1 hour") if dedup else stream
        _run(start_bucket_sink(activity_buckets(src, delay="1 hour", watermarked=dedup), out,
                               f"late_t1_{dedup}", checkpoint=_ckpt(spark, f"late_t1_{dedup}")))
        return {r.bucket: r.messages for r in spark.read.parquet(out).collect()}

    # 10:00 closes after wave 1 with one row; the 10:xx rows of wave 3 are
    # late; 12:00 closes after wave 3; 14:00 is still open
    assert hourly(dedup=True) == {T(2024, 1, 1, 10): 1, T(2024, 1, 1, 12): 1}
    assert hourly(dedup=False) == {T(2024, 1, 1, 10): 1, T(2024, 1, 1, 12): 2}

    out = os.path.join(scratch, "late_dedup")
    stream = message_stream(spark, inbox, max_files_per_trigger=1)
    q = (dedup_messages(stream, "1 hour").drop("event_time").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", _ckpt(spark, "late_t4"))
         .trigger(availableNow=True).start())
    _run(q)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 4]
