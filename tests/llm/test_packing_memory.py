"""What a packing task holds follows from the bytes encoded at a time, not from a batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from chatlens.llm import packing


def test_a_large_batch_is_encoded_in_small_pieces(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(2000)])
    texts = [" ".join(rng.choice(words, 3000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])
    path = public_tokenizers.path("word_bpe_49k.json")
    packing.encoder_of(path).encode(pa.array(texts[:1]))
    run = packing._pack(path, 1, 2048, 32, 8)
    tracemalloc.start()
    tokens = sum(sum(out.column(2).to_pylist()) for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids, ends = packing.WordEncoder(path).encode(pa.array(texts))
    assert tokens == len(ids) + len(texts) and len(ends) == len(texts) + 1
    assert peak < 40 << 20, peak >> 20
