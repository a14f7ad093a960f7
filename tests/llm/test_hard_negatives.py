"""Hard negatives against all scores, with blocks of a few rows, ties, repeats and odd vectors."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlens.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, block string, key int, low int"


def want(rows, every=3, positives=5, negatives=10, low=30, high=90):
    good = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = sorted({(i, y, tuple(v)) for i, y, v in good if i % every == 0})
    out = []
    for a, y, q in anchors:
        near = [(sum(map(lambda s, t: s * t, q, v)), i, z) for i, z, v in good if len(v) == len(q)]
        best = sorted((-s, i) for s, i, z in near if z == y and i != a)[:positives]
        for p, pid in best:
            hard = sorted((-s, i) for s, i, z in near if z != y and low * -p <= 100 * s <= high * -p)[:negatives]
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows, every=3, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("id") % every == 0, **how).collect())


def vectors(n, dim, labels, seed):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [rng.gauss(c, 0.7) / 4 for c in centre[i % labels]], (i * 7 // 3) % labels) for i in range(n)]


@pytest.mark.parametrize("block_rows", [4, 50])
def test_equals_all_scores(spark, block_rows, monkeypatch):
    monkeypatch.setattr(hn, "MEET", 8)
    rows = vectors(260, 6, 3, 1)
    result = got(spark, rows, every=5, block_rows=block_rows)
    assert result == want(rows, every=5) and len(result) > 1000


def test_messy_vectors(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.25], 2), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (4, [0.5, 0.5], 2),
            (5, [0.5, 0.5], 2), (5, [0.5, 0.5], 2), (6, [-1.0, -1.0], 1), (7, [0.0, 0.0], 3), (8, [0.5, 0.25], 0), (9, None, 1), (10, [None, 1.0], 1),
            (12, [NAN, 1.0], 1), (15, [INF, 1.0], 1), (18, [1.0], 1), (19, [1.0], 1), (20, [0.5], 2), (None, [1.0, 1.0], 1), (21, [1.0, 1.0], None),
            (22, [], 1), (24, [], 1), (25, [], 2), (27, [-1.0, 0.0], 4), (28, [1.0, 0.0], 4), (30, [0.0, 1.0], 5), (31, [1.0, 0.0], 5)]
    result = got(spark, rows, block_rows=3)
    assert result == want(rows)
    assert {r[0] for r in result} >= {0, 18, 24}
    assert got(spark, [], block_rows=3) == [] == got(spark, [r for r in rows if r[0] == 9])


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = vectors(120, 4, 2, 2)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]
    assert got(spark, rows, every=20, block_rows=8) == want(rows, every=20)


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(2 ** 20 + i), float(2 ** 20 - i)], i % 2) for i in range(12)]
    assert got(spark, rows, every=6, block_rows=2, low=0, high=100) == want(rows, every=6, low=0, high=100)


def test_few_blocks_are_read(spark):
    """Labels in tight groups: zones keep most blocks from being read."""
    rng = random.Random(3)
    rows = [(i, [(0.9 if i % 8 == d else 0.05) + rng.random() / 50 for d in range(8)], i % 8) for i in range(1600)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    table = hn.stored(hn.usable(df, "vec_id", F.col("label"), "embedding"), "vectors")
    blocks = hn.Blocks(table, 50)
    asks = (table.filter("id % 100 = 0").withColumn("key", F.col("id"))
            .withColumn("low", F.array(F.lit(hn._LOW))).withColumn("high", F.array(F.lit(hn._HIGH))))
    n = blocks.table.count()
    assert blocks.needs(asks, 1, True, True).count() == 16 * hn.TRIED
    assert blocks.needs(asks, 1, True, False).count() <= 16 * n / 6
    top = asks.withColumn("low", F.array(F.lit(50_000)))
    assert blocks.needs(top, 1, False, False).count() < 16 * n / 10
    assert got(spark, rows, every=400, block_rows=50) == want(rows, every=400)


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 3), st.integers(1, 4))
def test_curve_visits_neighbours(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hn.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys], object))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(deadline=None, max_examples=100)
@given(st.integers(0, 10 ** 6), st.integers(1, 5), st.sampled_from([50, 2 ** 20, 2 ** 30]))
def test_bounds_hold(seed, dim, size):
    rng = np.random.default_rng(seed)
    q, x = rng.integers(-size, size, (4, dim)), rng.integers(-size, size, (9, dim))
    least, most = hn.bounds(q, x.min(0)[None], x.max(0)[None])
    s = hn.scores(q, x)
    assert (least <= s).all() and (s <= most).all()
    assert s.tolist() == [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]
