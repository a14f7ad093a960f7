"""D1 with a stored registry: appends, repeats across appends, replays, failed batches, compaction, and no shuffle of earlier keys."""

import os
from dataclasses import replace

import pytest

from chatlens.operators import integrity, keys
from chatlens.sources import from_testdata
from chatlens.sources.fixtures import dealt, with_planted_faults
from chatlens.session import materialize
from tests.conftest import SF_SMALL


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("buckets", [3, 8])  # 8: as many as the session's shuffle partitions
def test_appends_equal_the_batch_check(spark, scratch, buckets):
    faulty = with_planted_faults(from_testdata(spark, SF_SMALL))
    tables = replace(faulty, **{t: materialize(getattr(faulty, t)) for t in ("users", "conversations", "messages")})
    want = pairs(integrity.duplicate_keys(tables))
    found = keys.registries(spark, f"{scratch}/registry{buckets}", tables, buckets=buckets)
    for batch in range(3):
        keys.register_batch(found, dealt(tables, batch, 3), batch)
    assert len(want) > 20 and pairs(keys.registered_duplicates(found)) == want
    # what the last append repeats, in itself or from the earlier ones: those of the duplicates that it holds
    last = dealt(tables, 2, 3)
    own = {(t, k, str(r[0])) for t, k in integrity.UNIQUE_KEYS for r in getattr(last, t).select(k).distinct().collect()}
    assert pairs(keys.registered_duplicates(found, 2)) == [w for w in want if w[:3] in own]
    for r in found.values():
        r.compact()
        assert r.batches() == [(0, 2)]
    assert pairs(keys.registered_duplicates(found)) == want
    again = keys.registries(spark, f"{scratch}/registry{buckets}", tables, buckets=9)  # keeps its buckets
    assert pairs(keys.registered_duplicates(again)) == want


def rows(spark, values, of="long"):
    return spark.createDataFrame([(v,) for v in values], f"k {of}")


def test_replay_failure_null_and_empty(spark, scratch):
    registry = keys.KeyRegistry(spark, f"{scratch}/it's one", "string", 3)
    assert registry.batches() == [] and registry.repeated().collect() == []
    registry.add(rows(spark, [], "string"), "k", 0)
    registry.add(rows(spark, ["a", "b", None, None, ""], "string"), "k", 1)
    registry.add(rows(spark, ["x", "x"], "string"), "k", 2)
    registry.add(rows(spark, ["a", "c", "", "c", None], "string"), "k", 2)  # the same batch again replaces it
    assert pairs(registry.repeated_by(2)) == [("", 2), ("a", 2), ("c", 2)] == pairs(registry.repeated())
    registry.add(rows(spark, ["b"], "string"), "k", 3)
    os.unlink(f"{scratch}/it's one/buckets=3/batch=3-3/_SUCCESS")  # a batch that failed is not there
    assert registry.batches() == [(0, 0), (1, 1), (2, 2)] and pairs(registry.repeated()) == [("", 2), ("a", 2), ("c", 2)]
    registry.add(rows(spark, ["b"], "string"), "k", 3)
    registry.compact()
    assert registry.add(rows(spark, ["b"] * 5, "string"), "k", 3) is False
    assert registry.add(rows(spark, ["c", "d"], "string"), "k", 4)
    assert pairs(registry.repeated_by(4)) == [("c", 3)]


def test_earlier_keys_are_not_shuffled(spark, scratch):
    """No exchange where an append meets the earlier keys, whatever the sizes, nor in the check of a compacted registry."""
    registry = keys.KeyRegistry(spark, f"{scratch}/plans", buckets=4)
    for batch in range(3):
        registry.add(spark.range(batch * 900, batch * 900 + 1000).withColumnRenamed("id", "k"), "k", batch)
    met = registry.earlier(2, (1, 1))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2, plan
    assert met.count() == 100 and registry.repeated().count() == 200
    registry.compact()
    whole = registry.repeated()
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString() and whole.count() == 200
