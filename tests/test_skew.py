"""A hot key holding a third of all rows, and a large NULL group.

Results must stay whole and exact (checked against DuckDB on the same rows),
and the plans must keep partial aggregation below the shuffles.
"""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from chatlens.operators import integrity
from chatlens.operators.rollups import DETAIL_COLUMNS, conversation_rollup
from chatlens.plans import conversations, kpis, users
from chatlens.sources.tables import ChatTables
from chatlens.sources.fixtures import FIXTURE_AS_OF, from_testdata
from tests.conftest import SF_MID

HOT_CONVERSATION = 4201   # user 42, day 1


@pytest.fixture(scope="module")
def skewed(spark):
    t = from_testdata(spark, SF_MID)
    m = t.messages.withColumn(
        "conversation_id",
        F.when(F.col("id") % 3 == 0, F.lit(HOT_CONVERSATION))
        .when(F.col("id") % 3 == 1, F.lit(None).cast("long"))
        .otherwise(F.col("conversation_id")))
    c = t.conversations.withColumn(
        "user_id", F.when(F.col("id") % 3 == 0, F.lit(42)).otherwise(F.col("user_id")))
    return ChatTables(users=t.users, conversations=c, messages=m)


def _duck(df):
    return df.toPandas()


def test_hot_conversation_rollup_is_exact(skewed):
    roll = {r.conversation_id: r for r in
            conversation_rollup(skewed.messages, DETAIL_COLUMNS).collect()}
    pdf = _duck(skewed.messages.select("id", "conversation_id", "error"))
    con = duckdb.connect()
    want = dict(con.execute(
        "SELECT conversation_id, count(*) FROM pdf WHERE conversation_id IS NOT NULL "
        "GROUP BY 1").fetchall())
    assert {k: r.total_messages for k, r in roll.items()} == want
    assert roll[HOT_CONVERSATION].total_messages >= len(pdf) // 3


def test_hot_user_rollup_equals_a_count_by_hand(skewed):
    owner = dict(_duck(skewed.conversations.select("id", "user_id").dropna()).itertuples(index=False))
    conversations_of, messages_of, errors_of = Counter(owner.values()), Counter(), Counter()
    for m in skewed.messages.select("conversation_id", "error").collect():
        user = owner.get(m.conversation_id)
        messages_of[user] += 1
        errors_of[user] += m.error is not None
    for r in users.user_detail(skewed).collect():
        assert (r.conversation_count, r.message_count, r.error_count) == \
            (conversations_of[r.id], messages_of[r.id], errors_of[r.id])


def test_hot_user_page_and_kpis(skewed):
    page = users.users_list(skewed, search="Customer#000000042")
    row = page.collect()[0]
    assert row.id == 42 and row.message_count >= skewed.messages.count() // 3
    k = kpis.kpi_stats(skewed, FIXTURE_AS_OF).first()
    assert k.total_messages == skewed.messages.count()
    audit = integrity.counter_audit(skewed)
    assert audit.filter(F.col("id") == HOT_CONVERSATION).count() == 1


def test_partial_aggregation_below_shuffle(skewed):
    p = conversation_rollup(skewed.messages, DETAIL_COLUMNS)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "partial_count" in p
    assert p.index("Exchange hashpartitioning(conversation_id") < p.index("partial_count")
    p = conversations.conversations_total(skewed, has_error=True)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "partial_count" in p


def test_nullable_key_joins_never_match_null(spark):
    from chatlens.operators.joins import anti_join_nullable, left_join_nullable
    left = spark.createDataFrame([(1, None), (2, 5), (5, None), (6, 7)], "id long, fk long")
    right = spark.createDataFrame([(5, "five"), (1, "one")], "pk long, name string")
    got = sorted(tuple(r) for r in left_join_nullable(left, right, "fk", "id", "pk")
                 .select("id", "name").collect())
    # id 5 / id 1 have NULL fk: their own ids equal right keys but must not match
    assert got == [(1, None), (2, "five"), (5, None), (6, None)]
    kept = sorted(r.id for r in anti_join_nullable(left, right, "fk", "id", "pk").collect())
    assert kept == [1, 5, 6]
    p = left_join_nullable(left, right, "fk", "id", "pk")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert "coalesce(fk" in p


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_key_set_joins_are_exact_however_spark_joins(spark, threshold):
    """Broadcast and shuffled joins give the same rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    from chatlens.operators.lookup import anti_join_keys, semi_join_keys
    big = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 10), (5, 30)],
                                "id long, fk long")
    keys = spark.createDataFrame([(10,), (30,), (None,), (10,)], "k long")
    semi = sorted(r.id for r in semi_join_keys(big, "fk", keys, "k")
                  .collect())
    anti = sorted(r.id for r in anti_join_keys(big, "fk", "id", keys, "k")
                  .collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert semi == [1, 4, 5]
    assert anti == [2, 3]      # the NULL key is kept by the anti-join


def test_stored_layout_splits_a_hot_conversation(spark, skewed, scratch):
    from chatlens.sources.tables import load_tables, write_tables
    root = f"{scratch}/stored_skew"
    write_tables(skewed, root, num_files=8)
    stored = load_tables(spark, root)
    files = (stored.messages.filter(F.col("conversation_id") == HOT_CONVERSATION)
             .select(F.input_file_name().alias("f")).distinct().count())
    assert files > 1
    assert stored.messages.count() == skewed.messages.count()


def test_hot_user_join_is_split_by_aqe(spark, skewed):
    """With broadcasts off and small skew thresholds, the conversations ⟕ users
    join of the whole-table detail runs as a skew-split sort-merge join (one
    user owns a third of the conversations), with unchanged results."""
    want = sorted(map(tuple, conversations.conversation_detail(skewed).collect()), key=repr)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        df = conversations.conversation_detail(skewed)
        got = sorted(map(tuple, df.collect()), key=repr)
        final = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in final
    assert got == want
