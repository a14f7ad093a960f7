"""Streams kept as partial states: rows older than any watermark, replayed batches, compaction, and no state between batches."""

import datetime as dt
import os

import pytest

from chatlens.operators.rollups import SHARED_COLUMNS, conversation_rollup
from chatlens.plans import activity, tools
from chatlens.sources import FIXTURE_AS_OF, from_testdata
from chatlens.streaming import (ACTIVITY, ROLLUP, TOOLS, activity_from_states, compact_states, message_stream, read_states,
                                rollup_from_states, start_states, top_tools_from_states)
from chatlens.streaming.replay import late_waves
from tests.conftest import SF_SMALL
from tests.handmade import AS_OF, make_tables


@pytest.fixture(scope="module")
def tables(spark):
    return from_testdata(spark, SF_SMALL)


@pytest.fixture(scope="module")
def inbox(tables):
    return late_waves(tables, waves=5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(spark, spec, inbox, out, name):
    query = start_states(message_stream(spark, inbox, max_files_per_trigger=1), spec, out, name, checkpoint=f"{out}_ckpt")
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_late_rows_are_in_the_answers(spark, scratch, tables, inbox):
    out = f"{scratch}/late"
    query = run(spark, ACTIVITY, inbox, f"{out}/t1", "add_t1")
    # five waves are five batches, and nothing is kept between them however many days they span
    assert len(os.listdir(f"{out}/t1/batches")) == 5
    assert all(not p["stateOperators"] for p in query.recentProgress)
    states = read_states(spark, ACTIVITY, f"{out}/t1")
    for hourly, report in ((True, activity.activity_hourly), (False, activity.activity_daily)):
        for as_of in (FIXTURE_AS_OF, dt.datetime(2024, 1, 12, 6, 59)):
            assert activity_from_states(spark, states, as_of, hourly).collect() == report(spark, tables, as_of).collect()
    run(spark, TOOLS, inbox, f"{out}/t2", "add_t2")
    for as_of in (FIXTURE_AS_OF, dt.datetime(2024, 1, 20)):
        got = top_tools_from_states(read_states(spark, TOOLS, f"{out}/t2"), tables, as_of)
        assert got.collect() == tools.top_tools(tables, as_of).collect()


def test_rollup_equals_batch_through_compaction_and_replay(spark, scratch, tables, inbox):
    out = f"{scratch}/late_t3"
    assert read_states(spark, ROLLUP, out).count() == 0 and compact_states(spark, ROLLUP, out) == -1
    run(spark, ROLLUP, inbox, out, "add_t3")
    columns = ["conversation_id", *SHARED_COLUMNS]
    want = rows(conversation_rollup(tables.messages, SHARED_COLUMNS).select(columns))
    now = lambda: rows(rollup_from_states(read_states(spark, ROLLUP, out)).select(columns))
    assert now() == want
    # a batch that is run again leaves one copy; one that broke off doesn't count until it is run again
    again = ROLLUP.states(tables.messages.limit(0))
    last = f"{out}/batches/batch_id=4"
    kept = spark.createDataFrame(spark.read.parquet(last).collect(), ROLLUP.schema)
    kept.write.mode("overwrite").parquet(last)
    assert now() == want
    again.write.parquet(f"{out}/batches/batch_id=5")
    os.unlink(f"{out}/batches/batch_id=5/_SUCCESS")
    assert now() == want
    # compaction, rows that arrive after it, compaction on top of it
    assert compact_states(spark, ROLLUP, out) == compact_states(spark, ROLLUP, out) == 4
    assert now() == want
    tables.messages.filter("id % 9 = 0").select(*tables.messages.columns).coalesce(1).write.mode("append").parquet(inbox)
    run(spark, ROLLUP, inbox, out, "add_t3")
    twice = rows(conversation_rollup(tables.messages.unionAll(tables.messages.filter("id % 9 = 0")), SHARED_COLUMNS).select(columns))
    assert now() == twice and compact_states(spark, ROLLUP, out) == 5 and now() == twice


def test_null_times_and_keys(spark, scratch):
    tables = make_tables(spark)
    inbox, out = f"{scratch}/hand_inbox", f"{scratch}/hand"
    tables.messages.coalesce(1).write.parquet(inbox)
    for spec in (ACTIVITY, TOOLS, ROLLUP):
        run(spark, spec, inbox, f"{out}/{spec.keys[-1]}", f"hand_{spec.keys[-1]}")
    states = read_states(spark, ACTIVITY, f"{out}/bucket")
    assert activity_from_states(spark, states, AS_OF).collect() == activity.activity_hourly(spark, tables, AS_OF).collect()
    got = top_tools_from_states(read_states(spark, TOOLS, f"{out}/tool"), tables, AS_OF)
    assert got.collect() == tools.top_tools(tables, AS_OF).collect()
    assert rows(rollup_from_states(read_states(spark, ROLLUP, f"{out}/conversation_id")).select("conversation_id", *SHARED_COLUMNS)) == rows(
        conversation_rollup(tables.messages, SHARED_COLUMNS))


def test_snapshot_path_without_a_snapshot(spark, scratch, tables):
    from chatlens.streaming import latest_conversation_rollup
    out = f"{scratch}/no_snapshot"
    ROLLUP.states(tables.messages).write.parquet(f"{out}/batch_id=0")
    got = latest_conversation_rollup(spark, out, snapshot_path=f"{out}_none").select("conversation_id", *SHARED_COLUMNS)
    assert rows(got) == rows(conversation_rollup(tables.messages, SHARED_COLUMNS))
