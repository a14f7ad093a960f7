"""Fixture mapping counts (FIXTURES.md §2) and report export."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chatlens.functions.timefns import HOUR, ntz
from chatlens.plans import kpis, tools
from chatlens.sources import FIXTURE_AS_OF, export, from_testdata
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def tables(spark):
    return from_testdata(spark, SF_MID)


def test_fixture_counts(tables):
    u, c, m = tables.users, tables.conversations, tables.messages
    assert (u.count(), c.count(), m.count()) == (1500, 4006, 10000)
    assert u.filter(F.col("first_seen").isNull()).count() == 1350
    assert u.filter(F.col("last_active").isNull()).count() == 1380
    assert m.filter(F.col("conversation_id").isNull()).count() == 104
    assert c.filter(F.col("user_id").isNull()).count() == 49
    assert c.join(m, c["id"] == m["conversation_id"], "left_anti").count() == 11
    assert m.filter(F.col("error") == "").count() == 45
    assert m.filter(F.col("timestamp") > ntz(FIXTURE_AS_OF)).count() == 81
    assert m.filter(F.col("timestamp") >= ntz(FIXTURE_AS_OF - 24 * HOUR)).count() == 404


def test_fixture_kpis(tables):
    r = kpis.kpi_stats(tables, FIXTURE_AS_OF).first()
    assert (r.messages_today, r.messages_24h) == (329, 404)
    assert (r.avg_response_time_ms_7d, r.p50_response_time_ms_7d,
            r.p95_response_time_ms_7d) == (513, 373, 1450)


def test_export_formats(spark, scratch, tables):
    df = tools.top_tools(tables, FIXTURE_AS_OF)
    for fmt in ("json", "parquet", "csv"):
        export(df, os.path.join(scratch, f"tools_{fmt}"), fmt)
    back = spark.read.parquet(os.path.join(scratch, "tools_parquet"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    lines = []
    folder = os.path.join(scratch, "tools_json")
    for name in os.listdir(folder):
        if name.endswith(".json"):
            lines += [json.loads(x) for x in open(os.path.join(folder, name))]
    assert {x.get("tool") for x in lines} == {r.tool for r in df.collect()}
    with pytest.raises(ValueError):
        export(df, os.path.join(scratch, "bad"), "xml")
    arr = tables.messages.select("id", "tools_used").limit(5)
    export(arr, os.path.join(scratch, "arr_csv"), "csv")
    assert spark.read.option("header", True).csv(os.path.join(scratch, "arr_csv")).count() == 5
