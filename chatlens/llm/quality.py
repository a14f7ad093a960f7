"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed byte trigrams, trigrams of character classes and a few
shares that tell how words repeat. Their scaled frequencies are
projected on the leading singular vectors of a bounded sample of labelled texts. The sample's
vectors are broadcast; every document is compared with all of them in blocks,
and its nearest neighbours vote, weighted by cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample (the bound of what is fitted and broadcast), latent dimensions, voters.
SAMPLE, DIMENSIONS, VOTERS = 4096, 48, 15
#: Byte trigram buckets, and trigrams of the eight character classes.
BYTES, CLASSES = 512, 512
SHARES = 8
WIDTH = BYTES + CLASSES + SHARES
#: Bytes whose terms are counted at a time, and documents compared at a time.
CHUNK, BLOCK = 1 << 21, 512
THRESHOLD = 0.7

_CLASS = np.full(256, 7, np.uint16)  # not ASCII
_CLASS[:128] = 6  # symbols and controls
for _chars, _code in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:!?'\"-()", 5)):
    _CLASS[list(_chars)] = _code
_MIX = np.random.default_rng(7).integers(0, BYTES, 256, dtype=np.uint16)


def _trigram_counts(data: np.ndarray, owner_start: np.ndarray, n: int) -> np.ndarray:
    """Counts of both kinds of trigram within each text; texts lie one after another in ``data``."""
    out = np.zeros((n, BYTES + CLASSES), np.float32)
    for a in range(0, len(data), CHUNK):
        part = data[a:a + CHUNK + 2]
        if len(part) < 3:
            break
        at = np.arange(a, a + len(part) - 2)
        owner = np.searchsorted(owner_start, at, "right") - 1
        inside = at + 3 <= owner_start[owner + 1]
        low, high = owner[0], owner[-1] + 1
        m, c = _MIX[part], _CLASS[part]
        h = (m[:-2] ^ (m[1:-1] << 1) ^ (m[2:] << 2)) & (BYTES - 1)
        k = (c[:-2] << 6) | (c[1:-1] << 3) | c[2:]
        base = ((owner - low) * (BYTES + CLASSES))[inside]
        size = (high - low) * (BYTES + CLASSES)
        counts = np.bincount(base + h[inside], minlength=size) + np.bincount(base + BYTES + k[inside], minlength=size)
        out[low:high] += counts.reshape(high - low, -1)
    return out


def _shares(texts: pa.Array) -> np.ndarray:
    """How the words of each text repeat, and how long words and lines are."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    offsets = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    n = len(texts)
    at = np.asarray(words.dictionary_encode().indices, np.int64)
    length = np.asarray(pc.binary_length(words), np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count = np.maximum(np.diff(offsets), 1).astype(float)

    def per(x, k=None):
        return np.bincount(owner if k is None else owner[k:], x, n)

    again = np.r_[0, at[1:] == at[:-1]] * np.r_[0, owner[1:] == owner[:-1]] if len(at) else np.zeros(0)
    pairs = np.unique(owner * (at.max(initial=0) + 1) + at)
    different = np.bincount(pairs // (at.max(initial=0) + 1), minlength=n) if len(pairs) else np.zeros(n)
    real = np.diff(offsets) > 0
    lines = np.asarray(pc.count_substring(texts, "\n"), float) + 1
    return np.stack([per(again) / count, np.where(real, different / count, 1), per(length == 1) / count, per(length == 2) / count,
                     per(length >= 12) / count, np.log1p(np.diff(offsets)) / 10, np.log1p(count / lines) / 5, real], 1)


def terms(texts: pa.Array) -> np.ndarray:
    """Matrix of term weights: square roots of shares, so that a text's length doesn't matter."""
    texts = texts.fill_null("").cast(pa.large_binary()).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    counts = _trigram_counts(data, offsets - offsets[0], len(texts))
    for a, b in ((0, BYTES), (BYTES, BYTES + CLASSES)):
        part = counts[:, a:b]
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    return np.hstack([np.sqrt(counts), _shares(texts)]).astype(np.float32)


class Voters:
    """The fitted projection and the sample's unit vectors and labels."""

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, voters: int = VOTERS):
        self.k, self.labels = voters, labels.astype(np.float32)
        if not len(labels):
            return
        self.mean = matrix.mean(0)
        self.scale = 1 / np.sqrt(matrix.var(0) + 1e-4)
        z = (matrix - self.mean) * self.scale
        _, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32)
        self.vectors = self._unit(z @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, matrix: np.ndarray) -> np.ndarray:
        """Share of the neighbours' weight that votes 1; a half where nothing is labelled."""
        if not len(self.labels):
            return np.full(len(matrix), 0.5)
        out = np.empty(len(matrix))
        k = min(self.k, len(self.labels))
        for i in range(0, len(matrix), BLOCK):
            x = self._unit(((matrix[i:i + BLOCK] - self.mean) * self.scale) @ self.axes)
            cosine = x @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) + 1e-6
            out[i:i + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, sample: int) -> DataFrame:
    """At most ``sample`` labelled texts, chosen by a hash of the id; ``learn`` is a condition on ``labels``."""
    chosen = (labels.filter(learn).filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__other"))
              .filter("__label = __other").orderBy(F.xxhash64("__id"), "__id").limit(sample).drop("__other"))
    texts = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select("__id", docs[text_col].alias("__text"), "__label")
    return texts.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))


def _sample_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            m = terms(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in m], pa.binary())], ["id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Voters:
    """Voters from at most ``sample`` labelled rows. The driver gets their term weights (4 KB a row), no text.

    Ids with a null or contradicting label are left out; a repeated id counts once.
    """
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, learn, sample)
    kind = rows.schema["__id"].dataType.simpleString()
    got = sorted(rows.select("__id", F.col("__label").cast("int"), "__text").mapInArrow(_sample_terms, f"id {kind}, label int, terms binary").collect(), key=lambda r: r["id"])
    matrix = np.stack([np.frombuffer(r["terms"], np.float32) for r in got]) if got else np.zeros((0, WIDTH), np.float32)
    return Voters(matrix, np.array([r["label"] for r in got], np.float32))


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and ``__score`` (double): a text alone decides its score.

    Null texts count as empty, and empty ones are scored like any other by the
    terms they lack. Nothing is shuffled; repeated rows and null ids stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                values = shared.value.score(terms(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], [*(f"c{k}" for k in range(part.num_columns)), "__score"])

    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType([*(StructField(f"c{k}", f.dataType, True) for k, f in enumerate(docs.schema)), StructField("__score", DoubleType())])
    return docs.mapInArrow(run, schema).toDF(*docs.columns, "__score")
