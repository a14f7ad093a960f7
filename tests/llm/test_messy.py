"""Every operator and stage on nulls, empty and very long texts, repeats, ties, clashing columns, and empty tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chatlens.llm import context_mixing, decontaminate, licences, line_spread, packing, pii, quality, secret_scan, simhash, topk
from tests.llm import brute
from tests.llm.conftest import messy_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = messy_rows()


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_simhash(messy, no_rows):
    got = simhash.simhash_components(messy).collect()
    assert len(got) == len(ROWS)
    fps = [(r[0], brute.fingerprint(r[1])) for r in ROWS]
    want = brute.components(fps)
    assert sorted(map(repr, ((r["doc_id"], r["fingerprint"], r["component_id"], r["n_links"]) for r in got))) == sorted(
        map(repr, ((i, f"{f:016x}", *want[f]) for i, f in fps)))
    assert {r["doc_id"] for r in got if r["fingerprint"] == "0" * 16} >= {1, 2, 3, 12}
    assert simhash.simhash_components(no_rows).count() == 0


def test_keep_one_keeps_null_ids_and_columns(messy):
    kept = simhash.keep_one(messy)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == messy.columns and ids.count(None) == 2 and 9 not in ids and 2 not in ids and 1 in ids


def test_decontaminate(spark, messy, no_rows):
    text = "a text without an id. It has words enough for every shingle."
    bench = items(spark, [(1, text), (2, None), (None, "of two lines"), (3, ""), (3, " ".join(f"word{i} and {i}" for i in range(40))), (1, text)])
    found = decontaminate.overlaps(messy, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(None, 1), (4, 3)}
    assert [r["matched"] for r in found if r["item_id"] == 1] == [12]
    kept = decontaminate.decontaminate(messy, bench)
    assert kept.columns == messy.columns and kept.count() == len(ROWS) - 2
    assert decontaminate.overlaps(no_rows, bench).count() == 0
    assert decontaminate.overlaps(messy, items(spark, [])).count() == 0


def test_lines(spark, messy, no_rows):
    got = line_spread.remove_spread_lines(messy, sites=2)
    rows = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert got.count() == len(ROWS) and got.columns[:-2] == messy.columns
    assert rows[(9, "")]["__n_removed"] == 1 and rows[(8, "tie one two three four")]["__n_removed"] == 0
    assert rows[(1, None)]["__n_lines"] == 0 and rows[(2, "")]["__n_lines"] == 1
    assert line_spread.remove_spread_lines(no_rows).count() == 0


def test_secrets_and_personal_data(messy, no_rows):
    by_text = {r[1]: (brute.secrets(r[1]), brute.personal(r[1])) for r in ROWS}
    joined = lambda df: sorted((str(r["doc_id"]), r["base"]) for r in df.collect())
    assert joined(secret_scan.secret_spans(messy)) == sorted((str(r[0]), ",".join(by_text[r[1]][0])) for r in ROWS)
    assert joined(pii.personal_spans(messy)) == sorted((str(r[0]), ",".join(by_text[r[1]][1])) for r in ROWS)
    assert secret_scan.secret_spans(no_rows).count() == pii.personal_spans(no_rows).count() == 0


def test_packing(messy, no_rows):
    got = packing.pack(messy, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(r[0]), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in ROWS)
    whole = got[got["start"] == 0]
    assert sorted((str(None if i != i else int(i)), n) for i, n in zip(whole["doc_id"], whole["doc_tokens"])) == want
    assert got["length"].sum() == sum(n for _, n in want)
    one = got[got["doc_id"] == 4].sort_values("start")
    ids = np.array([*tokenizer.encode(ROWS[5][1], add_special_tokens=False).ids, 1], "<u4")
    assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(one["start"], one["length"])] == list(one["ids_crc32"])
    assert packing.pack(no_rows, PATH).count() == 0


def test_language_model(messy, no_rows):
    got = context_mixing.lm_scores(messy, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["score"] < 0 and r["score"] == r["score"] and r["base_score"] < 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert context_mixing.lm_scores(no_rows, F.lit(True)).count() == 0
    untrained = context_mixing.lm_scores(messy, F.lit(True)).collect()
    assert len(untrained) == len(ROWS) and {r["train_tokens"] for r in untrained} == {0}


def test_licences(spark, messy, no_rows):
    known = licences.known_licences(spark)
    assert licences.licence_scan(messy, known).count() == licences.licence_scan(no_rows, known).count() == 0
    none = licences.known_licences(spark, [])
    assert licences.licence_scan(messy, none).count() == 0


def test_quality(spark, messy, no_rows):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 12)] + [(None, 1, 0), (3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(messy, quality.fit(messy, labels, F.lit(True)))
    assert got.count() == len(ROWS) and got.columns == [*messy.columns, "__score"]
    assert all(0 <= r["__score"] <= 1 for r in got.collect())
    unfit = quality.fit(messy, labels.limit(0), F.lit(True))
    assert {r["__score"] for r in quality.score(messy, unfit).collect()} == {0.5}
    assert quality.score(no_rows, unfit).count() == 0 and quality.fit(no_rows, labels, F.lit(True)).labels.size == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, [0.25, 1.0]), (2, [0.25, 1.0]), (2, [0.25, 1.0]), (3, None), (4, [None, 1.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, score int")
    got = topk.topk_inner_product(df, F.col("id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()
    # two rows of id 0 are one query, which ties with ids 1, 2 (twice) and 50; id 50 meets both rows
    assert [tuple(r) for r in got] == [(0, 1, 1, 49152), (0, 2, 2, 49152), (0, 3, 2, 49152), (50, 1, 0, 49152), (50, 2, 0, 49152), (50, 3, 1, 40960)]
    assert topk.topk_inner_product(df.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, messy, no_rows, k, tmp_path):
    name, stage = corpus_pipeline.STAGES[k]
    spark.createDataFrame([(i, 1, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, [(1, "a text without an id. It has words enough for every shingle.")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, messy, str(tmp_path))
    assert out.count() > 0
    if k < 4:
        assert out.columns == messy.columns
    assert stage(spark, no_rows, str(tmp_path)).count() == 0
