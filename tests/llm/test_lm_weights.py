"""The first weights of op2's model come from all training texts."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from chatlens.llm import context_mixing
from tests.llm.test_results import code_of, counted, lines, mixer_of


def test_scores_do_not_depend_on_the_ids(spark):
    """A choice of training texts by their ids would show."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = []
    for shift in (0, 7_000_000):
        moved = docs.withColumn("doc_id", F.col("doc_id") + F.lit(shift))
        rows = context_mixing.lm_scores(moved, F.col("doc_id") % 7 == F.lit(shift % 7 + 2)).collect()
        got.append({r.doc_id - shift: (r.held_out, r.score) for r in rows})
    assert len(got[0]) == 120 and got[0] == got[1]


def test_slopes_add_up_and_are_derivatives():
    texts = lines(5, 60, 50)
    counts = counted(texts)
    _, code = code_of(counts)
    mixer = mixer_of(counts, code)
    every = pa.array(texts, pa.large_binary())
    whole = mixer.slopes(every)
    parts = mixer.slopes(every[:17]) + mixer.slopes(every[17:])
    assert np.allclose(whole, parts, rtol=1e-4, atol=1e-2)
    # the sums' first derivatives are differences of the cost of the same predictions
    gram = context_mixing.grams(*context_mixing.joined(every))

    def cost(first):
        own = mixer_of(counts, code, first)
        place = own.places(gram, without=True)
        weights = first[..., None].copy()
        return own._mix((gram & 0xFFFF).astype(np.uint16), place, np.array([len(gram)]), weights, False)[0]

    for unknown, gate, k in ((0, 0, 2), (0, 3, 1), (1, 1, 0), (1, 2, 1)):
        up, down = mixer.first.copy(), mixer.first.copy()
        up[k, unknown, gate] += 0.02
        down[k, unknown, gate] -= 0.02
        want = (cost(up) - cost(down)) / 0.04
        assert abs(whole[unknown, gate, k, 0] - want) < 0.02 * abs(want) + 0.5, (unknown, gate, k)


def test_slopes_come_from_the_answers(monkeypatch):
    """The fit reads no texts: each bucket's answers have its own n-grams, also where a bucket sends a part several rows."""
    monkeypatch.setattr(context_mixing, "HELD", 300)
    monkeypatch.setattr(context_mixing, "FITTED", 40)
    texts = [t for seed in (1, 2, 3) for t in lines(seed, 20, 30)]
    held, bucket = [i % 7 == 2 for i in range(60)], [i // 25 for i in range(60)]
    rows = pa.record_batch([pa.array([t.decode() for t in texts]), pa.array(held), pa.array(bucket)], ["text", "held_out", "bucket"])
    shares = pa.Table.from_batches(list(context_mixing._statistics(3)([rows[i:i + 5] for i in range(0, 60, 5)])))
    assert any(n > 1 for n in shares.group_by(["part", "bucket", "ord"]).aggregate([([], "count_all")])["count_all"].to_pylist())
    answers = pa.concat_tables([context_mixing._answers(shares.filter(pc.equal(shares["part"], p))) for p in range(3)])
    learnt = [[t for t, h, b in zip(texts, held, bucket) if b == own and not h] for own in range(3)]
    counts = counted([t for own in learnt for t in own])
    _, code = code_of(counts)
    mixer, value = mixer_of(counts, code), type("Sent", (), {"value": code})
    for own in range(3):
        got = context_mixing._fit(value)((own,), answers.filter(pc.and_(pc.equal(answers["bucket"], own), pc.greater(answers["ord"], 0))))
        want = mixer.slopes(pa.array(learnt[own], pa.large_binary())).ravel()
        assert got["place"].to_pylist() == list(range(len(want))) and np.allclose(got["slope"], want, rtol=1e-4, atol=1e-2)


def test_a_bucket_without_training_texts_adds_nothing():
    rows = pa.record_batch([pa.array(["abc abc", None]), pa.array([True, True]), pa.array([0, 0])], ["text", "held_out", "bucket"])
    answers = context_mixing._answers(pa.Table.from_batches(list(context_mixing._statistics(1)([rows]))))
    _, code = code_of({})
    got = context_mixing._fit(type("Sent", (), {"value": code}))((0,), answers.filter(pc.and_(pc.equal(answers["bucket"], 0), pc.greater(answers["ord"], 0))))
    assert not any(got["slope"].to_pylist())


def test_bundles_hold_all_rows_in_fewer_bytes(monkeypatch):
    monkeypatch.setattr(context_mixing.parts_of, "__defaults__", (5000,))
    texts = [None, "", *(t.decode() for t in lines(4, 100, 40))]
    rows = pa.table({"doc_id": pa.array([None, *range(1, len(texts))], pa.int64()), "text": texts, "held_out": [i % 7 == 2 for i in range(len(texts))]})
    bucket = pa.array([i // 40 for i in range(len(texts))])
    got = list(context_mixing._bundled(rows.append_column("bucket", bucket).combine_chunks().to_batches()))
    assert len(got) > 3
    back = [(b["bucket"][0].as_py(), r) for b in got for r in pa.ipc.open_stream(b["texts"][0].as_buffer()).read_all().to_pylist()]
    assert back == list(zip(bucket.to_pylist(), rows.to_pylist()))
    assert sum(len(b["texts"][0].as_py()) for b in got) < 0.7 * sum(len(t or "") for t in texts)
