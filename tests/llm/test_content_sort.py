"""Exact groups against plain Python, with common texts in slices and on messy rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chatlens.llm import content_sort
from tests.llm.conftest import messy_rows


def want(rows, keep="max", normal=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        sha, stays = hashlib.sha256(t.encode()).hexdigest(), 1
        for i in ids:
            kept = bool(stays) and i == best
            stays -= kept
            out.append((i, best, len(ids), kept, sha))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in content_sort.exact_groups(df, **how).collect()), key=repr)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_messy_rows(messy, no_rows, keep):
    assert got(messy, keep=keep) == want([(r[0], r[1]) for r in messy_rows()], keep)
    assert got(no_rows, keep=keep) == []


def test_a_text_in_a_third_of_all_rows_is_dealt_into_slices(spark):
    rows = [(i, "the same text" if i % 3 == 0 else "" if i % 3 == 1 and i % 2 else f"own text {i}") for i in range(3000)]
    rows += [(3, "the same text"), (2997, "the same text"), (2997, "the same text"), (None, "the same text"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    common, ranges = content_sort._slices(df.select(F.xxhash64("text").alias("digest"), F.octet_length("text").cast("long").alias("size")), 8)
    assert ranges == 8 and {r["slices"] > 8 for r in common.collect()} == {True, False}
    assert got(df, ranges=8) == want(rows)
    assert sum(r[3] for r in got(df, ranges=8)) == len({t or "" for _, t in rows})


def test_texts_that_share_a_head_and_normalised_texts(spark):
    head = "é" * 200
    rows = [(i, head + str(i % 7)) for i in range(50)] + [(100, "A b"), (101, "a B"), (102, "ß"), (103, "SS")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == want(rows)
    assert got(df, normalise=F.lower) == want(rows, normal=str.lower)


def test_no_python_and_one_exchange_of_texts(spark, messy, monkeypatch):
    plans = []
    keep = content_sort.stored
    monkeypatch.setattr(content_sort, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    content_sort.exact_groups(messy).collect()
    assert not any(w in p for _, p in plans for w in ("Python", "Pandas", "ArrowEval"))
    dealt = dict(plans)["equal-texts"]
    assert "rangepartitioning(head" in dealt and "hashpartitioning(head" not in dealt and "hashpartitioning(bytes" not in dealt
