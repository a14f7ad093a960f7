"""Semantic traps on tiny hand-made tables (FIXTURES.md §3)."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chatlens.functions.coercion import to_int
from chatlens.functions.labels import (duration_label, latency_label,
                                       relative_time_label)
from chatlens.functions.patterns import contains_pattern, normalize_like
from chatlens.operators import integrity
from chatlens.operators.paging import USERS_PAGE, check_page
from chatlens.plans import activity, conversations, kpis, messages, tools, users
from tests.handmade import AS_OF, T, make_tables


@pytest.fixture(scope="module")
def tables(spark):
    return make_tables(spark)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rounding_mean_half_up_percentile_half_even(spark):
    a = AS_OF
    msgs = [(1, 10, "assistant", "x", a - dt.timedelta(hours=2), 12, None, None, None, None),
            (2, 10, "assistant", "y", a - dt.timedelta(hours=3), 13, None, None, None, None)]
    r = one(kpis.kpi_stats(make_tables(spark, messages=msgs), AS_OF))
    assert r.avg_response_time_ms_7d == 13
    assert r.p50_response_time_ms_7d == 12
    assert r.p95_response_time_ms_7d == 13  # 12.95 -> 13


def test_kpi_windows_and_error_meanings(tables):
    r = one(kpis.kpi_stats(tables, AS_OF))
    assert (r.total_users, r.total_conversations, r.total_messages) == (4, 4, 9)
    assert r.messages_24h == 7          # a-24h inclusive, rows after as_of count
    assert r.messages_today == 6
    assert r.errors_24h == 3            # '' counts as an error (NOT NULL)
    assert r.assistant_messages_24h == 4
    assert r.active_users_today == 1    # by conversation last_message_at
    assert r.last_message_at == AS_OF + dt.timedelta(hours=1)
    assert r.generated_at == AS_OF


def test_empty_latency_sample_gives_zero(spark):
    r = one(kpis.kpi_stats(make_tables(spark, messages=[]), AS_OF))
    assert (r.avg_response_time_ms_7d, r.p50_response_time_ms_7d,
            r.p95_response_time_ms_7d, r.total_messages) == (0, 0, 0, 0)
    assert r.last_message_at is None


def test_health_hour_is_strict(tables):
    r = one(kpis.table_health(tables, AS_OF))
    assert r.messages_last_hour == 2
    assert r.errors == 4


def test_hourly_spine_drops_edge_buckets(spark, tables):
    rows = activity.activity_hourly(spark, tables, AS_OF).collect()
    assert len(rows) == 24
    assert rows[0].bucket == T(2024, 5, 9, 13) and rows[-1].bucket == T(2024, 5, 10, 12)
    assert sum(r.messages for r in rows) == 5   # a-24h row and the later row drop
    by = {r.bucket: (r.messages, r.errors) for r in rows}
    assert by[T(2024, 5, 10, 11)] == (2, 0)
    assert by[T(2024, 5, 10, 0)] == (1, 0)
    assert by[T(2024, 5, 10, 10)] == (1, 1)


def test_daily_spine_has_14_days(spark, tables):
    rows = activity.activity_daily(spark, tables, AS_OF).collect()
    assert len(rows) == 14
    assert rows[-1].bucket == T(2024, 5, 10)
    assert rows[-1].messages == 6


def test_tools_explode_nulls_and_ties(tables):
    rows = tools.top_tools_ranked(tables, AS_OF).collect()
    assert [(r.tool, r["count"], r["rank"]) for r in rows] == [
        ("chart", 2, 1), ("search", 2, 2), ("sql", 2, 3), (None, 1, 4)]
    assert [r.share_pct for r in rows] == [100.0, 100.0, 100.0, 50.0]
    assert len(tools.top_tools(tables, AS_OF, limit=2).collect()) == 2


def test_like_normalization():
    assert normalize_like("a\\%b") == "a\\%b"
    assert normalize_like("a\\xb") == "axb"
    assert normalize_like("a\\\\") == "a\\\\"
    assert normalize_like("\\\\\\x") == "\\\\x"
    assert contains_pattern("abc\\") == "%abc\\%"


def test_user_search_wildcards_and_backslash(tables):
    ids = lambda s: sorted(r.id for r in users.users_list(tables, search=s).collect())
    assert ids("zoë 100") == [4]
    assert ids("100%sure") == [4]          # user's % stays a wildcard
    assert ids("sure\\\\x") == [4]         # escaped backslash matches one
    assert ids("sure\\x") == []            # \x means x
    assert ids("EXAMPLE.COM") == [1, 2, 4]  # email, case-insensitive
    assert one(users.users_total(tables, search="example")).total == 3


def test_users_list_order_and_rollup(tables):
    rows = users.users_list(tables).collect()
    assert [r.id for r in rows] == [2, 1, 3, 4]  # NULL last_active first
    by = {r.id: (r.conversation_count, r.message_count, r.error_count) for r in rows}
    assert by[1] == (2, 6, 3)
    assert by[2] == (1, 0, 0)
    assert by[3] == (0, 0, 0)


def test_user_rollup_equals_a_count_by_hand(tables):
    owner = {c.id: c.user_id for c in tables.conversations.collect() if c.user_id is not None}
    want = {u.id: [0, 0, 0] for u in tables.users.collect()}
    for user in owner.values():
        if user in want:
            want[user][0] += 1
    for m in tables.messages.collect():
        user = owner.get(m.conversation_id)
        if user in want:
            want[user][1] += 1
            want[user][2] += m.error is not None
    ours = {r.id: [r.conversation_count, r.message_count, r.error_count]
            for r in users.user_detail(tables).collect()}
    assert ours == want


def test_inclusive_end_day(tables):
    d = dt.date(2024, 5, 10)
    rows = conversations.conversations_list(tables, date_from=d, date_to=d).collect()
    assert sorted(r.id for r in rows) == [10, 11]
    assert one(conversations.conversations_total(tables, date_from=d, date_to=d)).total == 2


def test_conversation_error_filter_counts_missing_as_zero(tables):
    with_err = {r.id for r in conversations.conversations_list(tables, has_error=True).collect()}
    without = {r.id for r in conversations.conversations_list(tables, has_error=False).collect()}
    assert with_err == {10, 11} and without == {12, 13}
    everything = {r.id for r in conversations.conversations_list(tables).collect()}
    assert with_err | without == everything


def test_conversation_detail_override_and_names(tables):
    rows = {r.id: r for r in conversations.conversation_detail(tables).collect()}
    assert rows[13].last_message_at is None          # no messages -> NULL
    assert rows[10].last_message_at == AS_OF - dt.timedelta(hours=1) + dt.timedelta(seconds=1)
    assert rows[10].total_messages == 4 and rows[10].error_count == 2
    assert rows[10].avg_assistant_response_time_ms == 13  # (12+13)/2 = 12.5 -> 13
    assert conversations.conversation_detail(tables, 404).count() == 0


def test_in_conversation_search_and_highlight(tables):
    rows = conversations.conversation_messages(tables, 10, query="(WORLD).").collect()
    assert [r.id for r in rows] == [1]
    assert rows[0].highlighted == "Hello ==(world).=="
    rows = conversations.conversation_messages(tables, 10, query="äö").collect()
    assert rows[0].highlighted == "Grüße ==ÄÖ==Ü"
    tool_hit = conversations.conversation_messages(tables, 10, query="SQL").collect()
    assert [r.id for r in tool_hit] == [3, 2]   # oldest first
    assert tool_hit[0].tools_text == "sql" and tool_hit[1].tools_text == "search, sql"
    errs = conversations.conversation_messages(tables, 10, errors_only=True).collect()
    assert [r.id for r in errs] == [4]   # '' is not an error on this page


def test_match_counts(tables):
    rows = {r.conversation_id: r for r in
            conversations.conversation_match_counts(tables, query="s", role="assistant").collect()}
    assert (rows[10].matching_messages, rows[10].total_messages, rows[10].error_messages) == (2, 4, 1)


def test_messages_list_nulls_first_and_user_columns(tables):
    rows = messages.messages_list(tables).collect()
    assert rows[0].id == 8                   # NULL timestamp first in DESC
    assert [r.id for r in rows[1:3]] == [5, 2]
    by = {r.id: r for r in rows}
    assert by[2].display_name == "Alice" and by[7].display_name is None
    assert by[9].ms_user_id is None          # dangling conversation id
    assert one(messages.messages_total(tables, search="50%")).total == 1
    assert one(messages.messages_total(tables, search="a_b")).total == 1
    assert one(messages.errors_total(tables)).total == 4
    assert one(messages.messages_total(tables, has_error=False)).total == 5


def test_paging_bounds():
    assert check_page(None, 0, USERS_PAGE) == 50
    for bad in (0, 201):
        with pytest.raises(ValueError):
            check_page(bad, 0, USERS_PAGE)
    with pytest.raises(ValueError):
        check_page(10, -1, USERS_PAGE)


def test_page_offset(tables):
    first = [r.id for r in messages.messages_list(tables, limit=3).collect()]
    second = [r.id for r in messages.messages_list(tables, limit=3, offset=3).collect()]
    every = [r.id for r in messages.messages_list(tables).collect()]
    assert first + second == every[:6]


def test_labels(spark):
    df = spark.createDataFrame(
        [(999, T(2024, 5, 10, 12, 29, 30), T(2024, 5, 10, 12, 0)),
         (1000, T(2024, 5, 10, 11, 0), T(2024, 5, 10, 12, 59)),
         (1450, T(2024, 5, 9, 12, 0), T(2024, 5, 10, 14, 5)),
         (1549, T(2024, 5, 1, 0, 0), T(2024, 5, 10, 12, 0))],
        "ms long, ts timestamp_ntz, end_ts timestamp_ntz")
    rows = df.select(latency_label("ms").alias("l"),
                     relative_time_label("ts", AS_OF).alias("en"),
                     relative_time_label("ts", AS_OF, "de", with_yesterday=False).alias("de"),
                     duration_label("ts", "end_ts").alias("d")).collect()
    assert [r.l for r in rows] == ["999ms", "1.0s", "1.4s", "1.5s"]
    # at a tie in milliseconds the binary value of the seconds decides
    ties = {1050: "1.1s", 1150: "1.1s", 1250: "1.3s", 1350: "1.4s", 2750: "2.8s", 8950: "8.9s", 123456750: "123456.8s"}
    got = spark.createDataFrame([(k,) for k in ties], "ms long").select("ms", latency_label("ms").alias("l")).collect()
    assert {r.ms: r.l for r in got} == ties
    nan = spark.createDataFrame([(float("nan"),), (2.5,), (None,)], "x double").select(to_int("x").alias("i")).collect()
    assert [r.i for r in nan] == [0, 2, 0]
    assert [r.en for r in rows] == ["just now", "1 hours ago", "yesterday", "9 days ago"]
    assert [r.de for r in rows] == ["gerade eben", "vor 1 Stunden", "vor 1 Tagen", "vor 9 Tagen"]
    assert [r.d for r in rows][1:] == ["1h 59m", "26h 5m", "228h 0m"]
    assert rows[0].d == "< 1 min"


def test_integrity(tables, spark):
    summary = {r.foreign_key: r.orphan_rows for r in integrity.orphan_summary(tables).collect()}
    assert summary == {"conversations.user_id": 0, "messages.conversation_id": 1}
    assert [r.id for r in integrity.orphan_messages(tables).collect()] == [9]
    assert integrity.orphan_conversations(tables).count() == 0
    audit = {r.id: (r.count_mismatch, r.last_message_mismatch)
             for r in integrity.counter_audit(tables).collect()}
    assert audit[10] == (True, True) and audit[11] == (True, True) and 13 not in audit
    nulls = integrity.required_nulls(tables).collect()
    assert all(r.null_rows == 0 for r in nulls) and len(nulls) == 7
    dup = make_tables(spark, users=[(1, "a", None, None, None, None),
                                    (1, "a", None, None, None, None)])
    d = {(r.table_name, r.key_column): r.occurrences
         for r in integrity.duplicate_keys(dup).collect()}
    assert d == {("users", "id"): 2, ("users", "ms_user_id"): 2}
    gone = tables.conversations.filter(F.col("id") == 10)
    after = integrity.cascade_delete(tables, gone)
    assert sorted(r.id for r in after.messages.collect()) == [5, 6, 7, 8, 9]
    assert after.conversations.count() == 3


def test_results_do_not_depend_on_session_time_zone(spark, tables):
    from chatlens.functions.timefns import instant_to_ntz, ntz_to_instant
    from chatlens.plans import views

    def snapshot():
        return (activity.activity_hourly(spark, tables, AS_OF).collect(),
                activity.activity_daily(spark, tables, AS_OF).collect(),
                sorted(views.conversations_view(
                    conversations.conversation_detail(tables).withColumn(
                        "last_message_at", F.col("first_message_at")), AS_OF).collect()))

    utc = snapshot()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert snapshot() == utc
        gap = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.5' AS ts")
        back = gap.select(instant_to_ntz(ntz_to_instant("ts")).alias("b")).first().b
        assert back == T(2024, 3, 10, 2, 30, 0, 500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_pages_past_the_end_are_empty_with_schema(tables):
    for df in (messages.messages_list(tables, offset=10_000),
               users.users_list(tables, offset=10_000),
               conversations.conversations_list(tables, offset=10_000),
               conversations.conversations_list(tables, has_error=True, offset=10_000),
               users.user_conversations(tables, offset=10_000)):
        assert df.collect() == []
        assert "id" in df.columns
    assert messages.messages_list(tables, offset=10_000).columns[-3:] == \
        ["display_name", "email", "ms_user_id"]


def test_pages_keep_their_size_when_ids_repeat(tables):
    twice = replace(tables, **{name: getattr(tables, name).unionAll(getattr(tables, name))
                               for name in ("users", "conversations", "messages")})
    for page in (users.users_list(twice, limit=3), users.user_conversations(twice, limit=3),
                 conversations.conversations_list(twice, limit=3),
                 messages.messages_list(twice, limit=3)):
        assert page.count() == 3
