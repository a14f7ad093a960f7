"""Session helpers: profiles, the shared checkpoint folder, materialize."""

import pytest

from chatlens import session


def test_profiles():
    assert session.CLUSTER_CONF["spark.sql.files.maxPartitionBytes"] == "512m"
    with pytest.raises(ValueError):
        session.build_session(profile="huge")


def test_checkpoint_root_reads_the_session(spark):
    root = session.checkpoint_root(spark)
    assert root and not root.endswith("/")
    assert session.ensure_checkpoint_dir(spark, "/nonexistent-should-not-be-used") == root


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).selectExpr("id * 2 AS x")
    m = session.materialize(df)
    assert sorted(r.x for r in m.collect()) == list(range(0, 20, 2))
    assert "FileScan parquet" in m._jdf.queryExecution().executedPlan().toString()
