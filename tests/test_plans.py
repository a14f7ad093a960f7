"""Scale shape: what the physical plans must (not) contain."""

import datetime as dt
from dataclasses import replace

import pytest

from chatlens.operators import lookup
from chatlens.plans import activity, conversations, kpis, messages, tools, users
from chatlens.sources.fixtures import FIXTURE_AS_OF, from_testdata
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return from_testdata(spark, SF_SMALL)


@pytest.fixture(scope="module")
def stored(spark, tables, scratch):
    """The same tables in the stored layout (real key columns in parquet)."""
    from chatlens.sources.tables import load_tables, write_tables
    root = f"{scratch}/stored_plans"
    write_tables(tables, root)
    return load_tables(spark, root)


def _no_python(text):
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                 "MapInPandas"):
        assert node not in text


def test_time_windows_reach_the_scan(spark, tables):
    p = plan(activity.activity_hourly(spark, tables, FIXTURE_AS_OF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-29T19:00)" in p
    assert "LessThan(ts,2024-01-30T19:00)" in p
    p = plan(tools.top_tools(tables, FIXTURE_AS_OF))
    assert "GreaterThanOrEqual(ts,2024-01-23T18:30)" in p


def scans(df, table: str) -> list[str]:
    return [x for x in plan(df).splitlines() if "FileScan parquet" in x and table in x]


def test_kpis_read_bounded_slices_without_joins(tables):
    df = kpis.kpi_stats(tables, FIXTURE_AS_OF)
    bounded = [x for x in scans(df, "events.parquet") if "GreaterThanOrEqual(ts," in x]
    assert any("2024-01-29T18:30" in x for x in bounded)      # counts of 24 hours
    assert any("2024-01-23T18:30" in x for x in bounded)      # latencies of 7 days
    for x in scans(df, "events.parquet"):
        if x not in bounded:                                  # totals: no error, role or latency
            assert "event_type" not in x.split("ReadSchema")[1]
            assert "value" not in x.split("ReadSchema")[1]
    assert len(scans(df, "customer.parquet")) == 1
    assert "Join" not in plan(df) and "CartesianProduct" not in plan(df)
    _no_python(plan(df))


def test_stored_totals_come_from_the_day_counts(stored, tables):
    for report in (kpis.kpi_stats, kpis.table_health):
        df = report(stored, FIXTURE_AS_OF)
        for x in scans(df, "/messages"):
            assert "PartitionFilters: [isnotnull(msg_date" in x
        assert df.collect() == report(tables, FIXTURE_AS_OF).collect()


def rows_read(spark, df, table: str) -> int:
    """Rows that the scans of ``table`` handed on when ``df`` ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        leaves = again._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value()
                   for i in range(leaves.size()) if table in leaves.apply(i).toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_newest_page_reads_the_newest_days_only(spark, stored, tables, monkeypatch):
    reads = []

    def counted(df, order, limit, offset, columns):
        reads.append(rows_read(spark, df.select(*columns), "messages"))
        return lookup.collect_page_keys(df, order, limit, offset, columns)

    monkeypatch.setattr(messages, "collect_page_keys", counted)
    everything = tables.messages.count()
    # the plain list has a stored order of its own (tests/test_stored.py); without it, the day counts serve it too
    whole, stored = stored, replace(stored, orders=None)
    first = messages.messages_list(whole, limit=20).collect()
    assert not reads and first == messages.messages_list(tables, limit=20).collect()
    for params in ({"limit": 20}, {"limit": 10, "offset": 15, "has_error": True},
                   {"limit": 20, "date_to": dt.date(2024, 1, 20)}):
        reads.clear()
        got = messages.messages_list(stored, **params).collect()
        assert len(reads) == 1 and reads[0] < everything / 4
        assert got == messages.messages_list(tables, **params).collect()
    # a rare text: the bound goes back until the page is full, then falls away
    reads.clear()
    rare = {"limit": 20, "search": "click {\"k\": 7"}
    assert messages.messages_list(stored, **rare).collect() == \
        messages.messages_list(tables, **rare).collect()
    assert len(reads) > 1


def test_pages_do_not_read_the_fact_table_for_their_figures(spark, stored):
    for df in (conversations.conversations_list(stored), users.users_list(stored),
               users.user_conversations(stored)):
        assert not scans(df, "/messages")


def test_one_conversation_takes_its_user_without_a_shuffle_of_users(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(conversations.conversation_detail(stored, 709))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    users_part = p[p.index("BroadcastHashJoin"):]
    assert "LeftSemi, BuildRight" in users_part
    assert "Exchange hashpartitioning(id" not in p and "hashpartitioning(_uid" not in p


def test_page_keys_come_from_a_top_k(tables):
    from chatlens.operators.paging import newest_first, page
    p = plan(page(tables.messages.select("id", "timestamp", "conversation_id"),
                  newest_first("timestamp"), 100, 20))
    assert "TakeOrderedAndProject" in p
    assert "Exchange rangepartitioning" not in p


def test_page_rows_are_read_through_key_literals(stored):
    cases = {
        "messages": (messages.messages_list(stored), ["In(id,", "PartitionFilters: [msg_date"]),
        "users": (users.users_list(stored), ["In(id,", "In(user_id,"]),
        "conversations": (conversations.conversations_list(stored),
                          ["In(id,", "In(conversation_id,"]),
        "conversations_err": (conversations.conversations_list(stored, has_error=True),
                              ["In(id,", "In(conversation_id,"]),
        "user_conversations": (users.user_conversations(stored), ["In(id,", "In(conversation_id,"]),
    }
    for name, (df, pushed) in cases.items():
        p = plan(df)
        assert "Exchange rangepartitioning" not in p, name   # page sorted in one partition
        assert "SortMergeJoin" not in p, name
        for f in pushed:
            assert f in p, (name, f)
        _no_python(p)
    p = plan(messages.messages_list(stored))
    assert "LeftSemi, BuildRight" in p               # users via the page's conversations


def test_rollups_aggregate_before_joining(tables):
    text = optimized(users.user_detail(tables))
    # the per-conversation aggregate sits below the join to conversations
    assert text.index("Aggregate [conversation_id") > text.index("Join LeftOuter")
    _no_python(plan(users.user_detail(tables)))


def test_stored_layout_prunes_day_folders(spark, tables, scratch):
    from chatlens.sources.tables import load_tables, write_tables
    root = f"{scratch}/stored"
    write_tables(tables, root)
    stored = load_tables(spark, root)
    df = messages.messages_total(stored, date_from=dt.date(2024, 1, 10),
                                 date_to=dt.date(2024, 1, 12))
    p = plan(df)
    assert "PartitionFilters: [isnotnull(msg_date" in p
    assert df.first().total == messages.messages_total(
        tables, date_from=dt.date(2024, 1, 10), date_to=dt.date(2024, 1, 12)).first().total
    hourly = activity.activity_hourly(spark, stored, FIXTURE_AS_OF)
    assert "msg_date" in plan(hourly)
    assert hourly.collect() == activity.activity_hourly(spark, tables, FIXTURE_AS_OF).collect()
    assert kpis.kpi_stats(stored, FIXTURE_AS_OF).collect() == \
        kpis.kpi_stats(tables, FIXTURE_AS_OF).collect()
