
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlens.functions.patterns import contains_pattern
from chatlens.operators.rollups import DETAIL_COLUMNS, conversation_rollup
from chatlens.plans import conversations, messages, users
from chatlens.sources.fixtures import from_testdata
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def tables(spark):
    return from_testdata(spark, SF_MID)


def total(df):
    return df.first().total


def test_error_filters_partition_the_totals(tables):
    assert total(messages.messages_total(tables, has_error=True)) + \
        total(messages.messages_total(tables, has_error=False)) == \
        total(messages.messages_total(tables))
    assert total(conversations.conversations_total(tables, has_error=True)) + \
        total(conversations.conversations_total(tables, has_error=False)) == \
        total(conversations.conversations_total(tables))


def test_pages_are_within_totals(tables):
    kw = dict(role="assistant", search="view", date_from=dt.date(2024, 1, 2))
    n = total(messages.messages_total(tables, **kw))
    pages = [messages.messages_list(tables, limit=500, offset=o, **kw).collect()
             for o in range(0, n + 500, 500)]
    ids = [r.id for p in pages for r in p]
    assert len(ids) == len(set(ids)) == n
    allowed = {r.id for r in tables.messages.filter(
        (F.col("role") == "assistant") & F.lower("content").contains("view")
        & (F.col("timestamp") >= F.lit("2024-01-02").cast("timestamp_ntz"))).collect()}
    assert set(ids) == allowed


def test_rollup_sums_to_messages_with_conversation(tables):
    roll = conversation_rollup(tables.messages, DETAIL_COLUMNS)
    s = roll.agg(F.sum("total_messages").alias("n"), F.sum("error_count").alias("e")).first()
    m = tables.messages.filter(F.col("conversation_id").isNotNull())
    assert s.n == m.count()
    assert s.e == m.filter(F.col("error").isNotNull()).count()


def test_user_rollup_totals(tables):
    u = users.user_detail(tables).agg(F.sum("conversation_count").alias("c"),
                                      F.sum("message_count").alias("m")).first()
    convs_with_user = tables.conversations.join(
        tables.users.select(F.col("id").alias("uid")), F.col("user_id") == F.col("uid"))
    assert u.c == convs_with_user.count()
    msgs_with_user = tables.messages.join(
        convs_with_user.select(F.col("id").alias("cid")), F.col("conversation_id") == F.col("cid"))
    assert u.m == msgs_with_user.count()


def _pg_like(value: str, pattern: str) -> bool:
    """Reference LIKE: backslash escapes the next character."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    return re.fullmatch("".join(out), value, flags=re.S | re.I) is not None


def test_like_normalization_matches_reference_semantics(spark):
    rng = random.Random(7)
    alphabet = "aB\\%_x"
    cases = []
    for _ in range(400):
        value = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
        search = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
        if search.endswith("\\") and not search.endswith("\\\\"):
            continue  # a lone trailing escape: PostgreSQL escapes the closing '%'
        cases.append((value, search, contains_pattern(search)))
    df = spark.createDataFrame(cases, "value string, search string, pattern string")
    got = df.select("value", "search", F.expr("value ILIKE pattern").alias("m")).collect()
    for r in got:
        assert r.m == _pg_like(r.value, "%" + r.search + "%"), (r.value, r.search)


def test_shared_rollup_gives_the_same_reports(spark, tables):
    from chatlens.operators import integrity
    from chatlens.operators.rollups import share_rollup
    shared = share_rollup(tables)
    d = dict(date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 20))
    calls = [
        lambda t: users.users_list(t),
        lambda t: users.users_list(t, search="machinery 1", offset=3),
        lambda t: users.user_detail(t),
        lambda t: users.user_detail(t, user_id=42),
        lambda t: users.user_conversations(t),
        lambda t: users.user_conversations(t, user_id=7, paged=False),
        lambda t: conversations.conversations_list(t),
        lambda t: conversations.conversations_list(t, has_error=True, search="building", **d),
        lambda t: conversations.conversations_list(t, has_error=False, offset=10, limit=200),
        lambda t: conversations.conversations_total(t, has_error=True, **d),
        lambda t: conversations.conversation_detail(t),
        lambda t: conversations.conversation_detail(t, 4201),
        lambda t: integrity.counter_audit(t),
    ]
    for i, call in enumerate(calls):
        a = sorted(map(tuple, call(tables).collect()), key=repr)
        b = sorted(map(tuple, call(shared).collect()), key=repr)
        assert a == b, i


def test_streamed_rollup_can_serve_the_reports(spark, tables):
    """The T3 output (latest per-conversation rollup) plugs in as the shared
    rollup and gives the batch answers."""
    from dataclasses import replace
    from chatlens.streaming.replay import replay_conversation_rollup
    from chatlens.sources.fixtures import message_events
    streamed = replay_conversation_rollup(message_events(spark, SF_MID))
    t = replace(tables, conversation_rollup=streamed)
    assert sorted(map(tuple, conversations.conversation_detail(t).collect()), key=repr) == \
        sorted(map(tuple, conversations.conversation_detail(tables).collect()), key=repr)
