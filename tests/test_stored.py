"""The stored layout kept current: appends, files nobody announced, gone files, failed refreshes, compaction, pages at any offset."""

import datetime as dt
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlens import schema as S
from chatlens.operators import ranked
from chatlens.plans import conversations, kpis, messages, users
from chatlens.sources import FIXTURE_AS_OF, append_messages, from_testdata, load_tables, refresh, write_tables
from chatlens.sources.summaries import newest_version
from chatlens.sources.tables import _write_messages
from tests.conftest import SF_SMALL

REPORTS = [
    (kpis.kpi_stats, {"as_of": FIXTURE_AS_OF}), (kpis.table_health, {"as_of": FIXTURE_AS_OF}),
    (kpis.kpi_stats, {"as_of": dt.datetime(2024, 1, 20, 7, 0)}),
    (users.users_list, {"limit": 30, "offset": 3}), (users.user_detail, {"user_id": 7}), (users.user_conversations, {"user_id": 7, "offset": 2}),
    (conversations.conversations_list, {"limit": 40, "offset": 55}), (conversations.conversations_list, {"user_id": 7}),
    (conversations.conversations_list, {"has_error": True, "limit": 200}),
    (messages.messages_list, {"limit": 60, "offset": 400}), (messages.errors_list, {"limit": 200}),
]


FEW = [REPORTS[k] for k in (0, 3, 9)]


def answers(tables, reports=FEW):
    return [sorted(map(tuple, f(tables, **how).collect()), key=repr) for f, how in reports]


def detail(tables):
    return sorted(map(tuple, conversations.conversation_detail(tables).collect()), key=repr)


@pytest.fixture(scope="module")
def whole(spark):
    return from_testdata(spark, SF_SMALL)


def test_answers_follow_the_tables(spark, whole, scratch):
    """Every step gives the answers of the batch reports over the same messages."""
    from dataclasses import replace
    root, wave, all_ = f"{scratch}/kept current", F.col("id") % 10, whole.messages
    write_tables(replace(whole, messages=all_.filter(wave < 5)), root, slice_rows=40)
    first = newest_version(spark, root)
    assert answers(load_tables(spark, root, summaries=True)) == answers(replace(whole, messages=all_.filter(wave < 5)))

    append_messages(spark, root, all_.filter(wave.between(5, 7)))
    now = newest_version(spark, root)
    assert now.loads["conversation_rollup"] == [first.number, now.number] and now.loads["user_rollup"] == [first.number]
    some = replace(whole, messages=all_.filter(wave < 8))
    assert answers(load_tables(spark, root, summaries=True)) == answers(some)

    # files that came another way: summarised on the spot, and a strict reader is told
    _write_messages(all_.filter(wave >= 8), root, "append", 5_000_000, 3)
    with pytest.raises(ValueError, match="messages: [1-9][0-9]* new, 0 gone"):
        load_tables(spark, root, summaries=True)
    want = answers(whole)
    stored = load_tables(spark, root)
    assert answers(stored, REPORTS) == answers(whole, REPORTS) and detail(stored) == detail(whole)
    assert kpis.table_health(load_tables(spark, root, summaries=False), FIXTURE_AS_OF).collect() == kpis.table_health(whole, FIXTURE_AS_OF).collect()

    # a refresh that failed: loads without a version, and a version without its end
    spark.range(3).write.parquet(f"{root}/summaries/message_days/load=50")
    spark.range(3).write.parquet(f"{root}/summaries/versions/version=60")
    os.unlink(f"{root}/summaries/versions/version=60/_SUCCESS")
    assert answers(load_tables(spark, root)) == want
    assert refresh(spark, root) == 61 and refresh(spark, root) == 61
    assert answers(load_tables(spark, root, summaries=True)) == want

    refresh(spark, root, compact=True, slice_rows=60)
    done = newest_version(spark, root)
    assert all(len(n) == 1 for n in done.loads.values())
    stored = load_tables(spark, root, summaries=True)
    assert answers(stored, REPORTS) == answers(whole, REPORTS)

    # messages taken away: the summaries that hold them are left aside, then made anew
    gone = sorted(stored.messages.inputFiles())[0]
    day, name = gone.split("/")[-2].removeprefix("msg_date="), os.path.basename(gone)
    left = stored.messages.filter(~((F.col("_metadata.file_name") == name) & (F.col("msg_date") == F.lit(day).cast("date")))).select(*S.MESSAGE_COLUMNS)
    left = spark.createDataFrame(left.collect(), S.MESSAGES)
    os.unlink(gone.removeprefix("file://").replace("%20", " "))
    with pytest.raises(ValueError, match="gone"):
        load_tables(spark, root, summaries=True)
    fewer = replace(whole, messages=left)
    assert answers(load_tables(spark, root)) == answers(fewer)
    refresh(spark, root)
    assert answers(load_tables(spark, root, summaries=True)) == answers(fewer)


def test_new_conversations_and_users(spark, whole, scratch):
    from dataclasses import replace
    root = f"{scratch}/grown"
    own = F.col("id") % 3
    write_tables(replace(whole, conversations=whole.conversations.filter(own != 0), users=whole.users.filter(own != 1)), root, slice_rows=40)
    for name, df in (("conversations", whole.conversations.filter(own == 0)), ("users", whole.users.filter(own == 1))):
        df.write.mode("append").parquet(f"{root}/{name}")
    want = answers(whole)
    assert answers(load_tables(spark, root)) == want
    refresh(spark, root)
    assert answers(load_tables(spark, root, summaries=True)) == want


def test_no_messages_at_all(spark, whole, scratch):
    from dataclasses import replace
    root, none = f"{scratch}/nothing", replace(whole, messages=whole.messages.limit(0))
    write_tables(none, root)
    assert answers(load_tables(spark, root)) == answers(none)
    append_messages(spark, root, whole.messages)
    assert answers(load_tables(spark, root, summaries=True)) == answers(whole)


def people(spark, n, missing=3):
    """Users of whom every ``missing``-th has no time, many with equal ones."""
    at = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7919 % (n // 5 + 1)).cast("int"))
    return spark.range(n).select("id", F.when(F.col("id") % missing != 0, F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + at).alias("last_active"))


def in_order(rows):
    return sorted(((r["id"], r["last_active"]) for r in rows), key=lambda r: ((0, 0) if r[1] is None else (1, -(r[1] - dt.datetime(1970, 1, 1)).total_seconds()), r[0]))


def test_pages_at_any_offset_over_several_runs(spark, scratch):
    rng = random.Random(5)
    rows = people(spark, 3000)
    want = in_order(rows.collect())
    paths, share = [], F.pmod(F.xxhash64("id"), F.lit(10))
    for k, part in enumerate((rows.filter(share < 5), rows.filter(share.between(5, 7)), rows.filter(share == 8))):
        paths.append(f"{scratch}/runs/{k}")
        ranked.write_run(part, "last_active", None, (), paths[-1], slice_rows=(64, 16, 7)[k])
    order = ranked.RankedOrder(spark, paths, "last_active", live=rows.filter(share == 9))
    for offset in [0, 1, 999, 1000, 1001, 2990, 2999, 3000, 9000, *(rng.randrange(3000) for _ in range(4))]:
        assert [(r["id"], r["last_active"]) for r in order.page(20, offset)] == want[offset:offset + 20], offset
    only = ranked.RankedOrder(spark, [], "last_active", live=rows)
    assert [r["id"] for r in only.page(5, 70)] == [i for i, _ in want[70:75]]
    assert ranked.RankedOrder(spark, [], "last_active").page(5, 0) == []


def rows_scanned(spark, frame) -> int:
    """Rows that the scan gave, from Spark's own metric."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = frame.select("*")
        frame.collect()
        leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_read_stay_the_same_as_the_table_grows(spark, scratch, monkeypatch):
    frames = []
    rows_of = ranked.RankedOrder._rows
    monkeypatch.setattr(ranked.RankedOrder, "_rows", lambda self, spans: frames.append(rows_of(self, spans)) or frames[-1])
    read = {}
    for n in (4_000, 400_000):
        path = f"{scratch}/grows/{n}"
        ranked.write_run(people(spark, n), "last_active", None, (), path, slice_rows=500)
        order = ranked.RankedOrder(spark, [path], "last_active")
        for offset in (0, n // 3 - 20, n // 2, n - 60):
            assert len(order.page(50, offset)) == 50
            read[n, offset] = sum(rows_scanned(spark, f) for f in frames.pop())
    assert max(v for (n, _), v in read.items()) <= 2_000, read
    assert max(v for (n, _), v in read.items() if n == 400_000) <= 2 * max(v for (n, _), v in read.items() if n == 4_000), read


def test_a_users_conversations_are_one_slice(spark, scratch):
    """One user owns a third of all conversations; another has a few."""
    convs = spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 100 + F.col("id") % 5000).cast("long").alias("user_id"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 1000).cast("int"))).alias("last_message_at"))
    path = f"{scratch}/by user"
    ranked.write_run(convs, "last_message_at", "user_id", (), path, slice_rows=500)
    order = ranked.RankedOrder(spark, [path], "last_message_at", "user_id")
    for user, offset in ((1, 0), (1, 12_345), (1, 19_990), (1, 20_000), (101, 0), (101, 3), (50, 0), (9_999_999, 0)):
        want = [r["id"] for r in convs.filter(F.col("user_id") == user).orderBy(F.desc("last_message_at"), "id").offset(offset).limit(25).collect()]
        assert [r["id"] for r in order.page(25, offset, prefix=user)] == want, (user, offset)
    assert rows_scanned(spark, order.keys().filter("user_id = 101")) <= 2_000


nodes = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 3)), min_size=1, max_size=40, unique=True)


@settings(deadline=None, max_examples=200)
@given(st.lists(nodes, min_size=1, max_size=3), st.integers(1, 6), st.integers(0, 60), st.integers(1, 10))
def test_descent_holds_the_ranks(runs, size, low, n):
    """The keys found enclose the ranks, whatever the runs and slices."""
    # a number in each key tells the runs' rows apart, as ids do
    runs = [sorted((a, b, r) for a, b in run) for r, run in enumerate(runs)]
    levels = [ranked._level([(i, len(run[i:i + size]), run[i]) for i in range(0, len(run), size)]) for run in runs]
    start, end = ranked.narrowed(levels, low, low + n)
    rows = sorted(k for run in runs for k in run)
    assert all(start <= k and (end is None or k < end) for k in rows[low:low + n])
    for level, run in zip(levels, runs):
        i, j = level.span(start, end)
        held = run[i * size:j * size]
        assert all(k in held for k in rows[low:low + n] if k in run)
