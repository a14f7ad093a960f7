"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers cut the same bytes, so each gives a sorted list of end offsets. The
merge of the two lists is divided by diagonals: a binary search on each finds
where the merge crosses it, so that all pieces have the same number of ends, however long or
short the documents are. Each piece is worked on alone: it emits the offsets where tokens of both
end. Stitched together, these cut the tokens into groups: what is open at a
piece's edge is closed by the next cut.

Links (pairs of tokens in one group) are counted corpus-wide. Documents are gathered in
blocks. A block sends each distinct pair once, with its number
of documents, and gets the pair's total back.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Ends of a piece, pairs expanded at a time, bytes of text tokenized at a time, and bytes of text of a block.
PIECE, LINKS, BYTES, BLOCK = 1 << 16, 1 << 20, 1 << 20, 1 << 24


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write for them: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE given by its JSON file and the pattern that cuts a text into words.

    Token ids are the merge ranks in such vocabularies, so the file's vocabulary is all that is needed.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, special = _byte_of(), {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i in range(self.size) for p in [self.model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple, tuple] = {}


def tokenizers_of(byte_path: str, pattern: str, piece_path: str) -> tuple:
    """This process's tokenizers, with the lengths and the decimal ids of their tokens."""
    key = (byte_path, pattern, piece_path)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sides = []
        for side, last in ((ByteLevel(byte_path, pattern), "|"), (Pieces(piece_path), ";")):
            side.length = np.array([len(b) for b in side.bytes], np.int64)
            # an id followed by a comma, and by the mark that ends its side of a group
            side.names = np.array([f"{i}," for i in range(side.size)] + [f"{i}{last}" for i in range(side.size)], object)
            sides.append(side)
        _LOADED[key] = tuple(sides)
    return _LOADED[key]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of sorted ``a`` and ``b`` is at each multiple of ``piece``: how many of each lie before.

    Equal values aren't parted: then the second one still belongs to the piece before.
    """
    d = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    i, j = low, d - low
    tie = (i > 0) & (j < len(b))
    tie[tie] = a[i[tie] - 1] == b[j[tie]]
    return np.r_[i, len(a)], np.r_[j + tie, len(b)]


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of either side up to each end that both have; ``a`` and ``b`` rise strictly."""
    i, j = diagonals(a, b, piece)
    cuts = []
    for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:]):
        if i0 < i1 and j0 < j1:
            at = np.searchsorted(b[j0:j1], a[i0:i1])
            both = np.flatnonzero(b[j0:j1][np.minimum(at, j1 - j0 - 1)] == a[i0:i1])
            cuts.append((i0 + both + 1, j0 + at[both] + 1))
    if not cuts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side).astype(np.int64) for side in zip(*cuts))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def link_counts(a_ids, b_ids, cut_a, cut_b, doc, a_size: int, b_size: int, links: int = LINKS):
    """Distinct ``(doc * a_size + a) * b_size + b`` over all links, with how often each occurs.

    Groups are expanded so many links at a time. A group that has more is counted by its
    distinct ids instead, block by block.
    """
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    n = n_a * n_b
    keys, counts = [], []
    small = np.flatnonzero(n <= links)
    edge = np.cumsum(n[small]) // links
    for part in np.split(small, np.flatnonzero(np.diff(edge)) + 1) if len(small) else []:
        of = np.repeat(part, n[part])
        k = np.arange(len(of)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        a = a_ids[(cut_a - n_a)[of] + k // n_b[of]]
        b = b_ids[(cut_b - n_b)[of] + k % n_b[of]]
        key, count = np.unique((doc[of] * a_size + a) * b_size + b, return_counts=True)
        keys.append(key)
        counts.append(count)
    for g in np.flatnonzero(n > links):
        a, many_a = np.unique(a_ids[cut_a[g] - n_a[g]:cut_a[g]], return_counts=True)
        b, many_b = np.unique(b_ids[cut_b[g] - n_b[g]:cut_b[g]], return_counts=True)
        step = max(1, links // len(b))
        for s in range(0, len(a), step):
            keys.append(((doc[g] * a_size + a[s:s + step, None]) * b_size + b).ravel())
            counts.append((many_a[s:s + step, None] * many_b).ravel())
    return _summed(keys, counts)


def group_texts(a_ids, b_ids, cut_a, cut_b, doc_ends, a_names, b_names) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document; ``doc_ends`` counts groups."""
    a_of = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=0))
    b_of = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=0))
    last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    last_a[cut_a - 1], last_b[cut_b - 1] = len(a_names) // 2, len(b_names) // 2
    out = np.empty(len(a_ids) + len(b_ids), object)
    out[np.arange(len(a_ids)) + np.r_[0, cut_b][a_of]] = a_names[a_ids + last_a]
    out[np.arange(len(b_ids)) + cut_a[b_of]] = b_names[b_ids + last_b]
    ends = np.r_[0, (cut_a + cut_b)[doc_ends - 1]]
    return ["".join(out[s:e].tolist())[:-1] for s, e in zip(ends, ends[1:])]


_FACTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
_ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _FACTS[1:5]), ("groups", pa.string()),
                   ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pair", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
_ROWS_DDL = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
             "at array<int>, times array<long>, pair array<long>, docs array<long>")


def _merged(texts: list[str], a_side, b_side, digest: bool) -> tuple[dict, list[str], np.ndarray, np.ndarray]:
    """Facts and groups of each text; and documents (by position), pairs and times of all links."""
    a_each, b_each = a_side.encode(texts), b_side.encode(texts)
    good = [k for k, t in enumerate(texts) if t and (raw := b" " + t.encode()) == b"".join(map(a_side.bytes.__getitem__, a_each[k]))
            and raw == b"".join(map(b_side.bytes.__getitem__, b_each[k]))]
    facts, groups = {c: np.zeros(len(texts), np.int64) for c in _FACTS[1:5]}, [""] * len(texts)
    if not good:
        return facts, groups, np.zeros(0, np.int64), np.zeros(0, np.int64)
    facts["n_a"][good], facts["n_b"][good] = [len(a_each[k]) for k in good], [len(b_each[k]) for k in good]
    flat = [np.fromiter((i for k in good for i in each[k]), np.int64) for each in (a_each, b_each)]
    del a_each, b_each
    # a document's end is an end of both, so that documents one after another are one merge
    cut_a, cut_b = common_ends(np.cumsum(a_side.length[flat[0]]), np.cumsum(b_side.length[flat[1]]))
    ends = np.searchsorted(cut_a, np.cumsum(facts["n_a"][good])) + 1
    many = np.diff(ends, prepend=0)
    facts["n_groups"][good] = many
    facts["n_links"][good] = np.add.reduceat(np.diff(cut_a, prepend=0) * np.diff(cut_b, prepend=0), ends - many)
    for k, text in zip(good, group_texts(*flat, cut_a, cut_b, ends, a_side.names, b_side.names)):
        groups[k] = hashlib.sha256(text.encode()).hexdigest() if digest else text
    doc = np.repeat(np.array(good, np.int64), many)
    return facts, groups, *link_counts(*flat, cut_a, cut_b, doc, a_side.size, b_side.size)


def _block(ids: pa.Array, texts: pa.Array, block: int, a_side, b_side, digest: bool) -> pa.RecordBatch:
    """One row for each document, and a last one with the block's distinct pairs."""
    n, span = len(ids), a_side.size * b_side.size
    parts = []
    for s, e in _parts(texts, BYTES):
        facts, groups, key, times = _merged([t or "" for t in texts.slice(s, e - s).to_pylist()], a_side, b_side, digest)
        parts.append((facts, groups, key // span + s, key % span, times))
    of, pair, times = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    pair, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
    starts, none = np.searchsorted(of, np.arange(n + 1)), np.zeros(n + 1, np.int64)

    def lists(values, type_, offsets, of_block):
        offsets = np.r_[offsets, offsets[-1] + (len(values) if of_block else 0)]
        gone = np.r_[np.full(n, of_block), not of_block]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, type_), mask=pa.array(gone))

    facts = [pa.array([*np.concatenate([p[0][c] for p in parts]).tolist(), None], pa.int64()) for c in _FACTS[1:5]]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n + 1, block)), pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), *facts,
         pa.array([*(g for p in parts for g in p[1]), None], pa.string()), lists(at, pa.int32(), starts, False), lists(times, pa.int64(), starts, False),
         lists(pair, pa.int64(), none, True), lists(docs, pa.int64(), none, True)], schema=_ROWS)


def _parts(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Runs of rows that hold about ``size`` bytes of text, or one longer text."""
    end = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64)) // size
    edges = np.r_[0, np.flatnonzero(np.diff(end)) + 1, len(texts)]
    return [(s, e) for s, e in zip(edges.tolist(), edges[1:].tolist()) if s < e]


def _align(paths: tuple, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, block = tokenizers_of(*paths), TaskContext.get().partitionId() << 32
        for batch in batches:
            for s, e in _parts(batch.column(1), BLOCK):
                yield _block(batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), block, *sides, digest)
                block += 1
    return run


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _FACTS[1:5]), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


def _answered(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Sums over each document's pairs, from what its block's pairs count."""
    of = np.asarray(found.column("at").combine_chunks(), np.int64)
    n, best = np.zeros((2, int(of.max(initial=-1)) + 1), np.int64)
    n[of], best[of] = np.asarray(found.column("n").combine_chunks()), np.asarray(found.column("best").combine_chunks()).astype(np.int64)
    at, times = rows.column("at").combine_chunks(), rows.column("times").combine_chunks()
    ends, where = np.asarray(at.offsets, np.int64), np.asarray(at.flatten())
    times = np.asarray(times.flatten())
    ends = ends - ends[0]
    sums = [np.r_[0, np.cumsum(times * x[where])] for x in (best, n)]
    sums = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
    return pa.Table.from_arrays([*(rows.column(c).combine_chunks() for c in _FACTS[:5]), *sums, rows.column("groups").combine_chunks()], schema=_OUT)


class Alignment:
    """Alignment of all rows of ``docs``: ``documents()`` and the corpus-wide ``pairs()``.

    A is the byte-level BPE in the JSON file ``byte_path``, whose words ``pattern`` cuts, over a space and the text. B is the
    sentencepiece model at ``piece_path`` over the text, to which it adds the space. Names of special
    tokens in a text are plain text. Documents that are null or empty, or whose joined
    tokens of A or B aren't the space and the text, have no tokens: zeros, and an empty ``groups``.
    Each row is a document: repeated rows and null ids count each on their own. An
    empty table gives no rows. Other columns are ignored. Ids are cast to long.

    ``digest``: ``groups`` holds the SHA-256 of the groups' text instead of the text itself.

    Texts are read and tokenized once, ``BYTES`` of text or one longer document at a time, and stored as ids of
    pairs. A block holds the pairs of ``BLOCK`` bytes of text or of one longer document. A pair crosses the network once for each block that has it, however many documents do.
    """

    def __init__(self, docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id",
                 text_col: str = "text", digest: bool = False):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.rows = stored(rows.mapInArrow(_align((byte_path, pattern, piece_path), digest), _ROWS_DDL), "aligned")
        self.b_size = self._pieces(piece_path)

    @staticmethod
    def _pieces(piece_path: str) -> int:
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()

    def _block_pairs(self) -> DataFrame:
        whole = self.rows.filter("pair IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "p"))
        return whole.select("block", "at", F.col("p.pair").alias("pair"), F.col("p.docs").alias("docs"))

    def _counted(self) -> DataFrame:
        """``pair, n, best``. A partition of the window is one id of A: at most as many rows as B has ids."""
        of_a = F.expr(f"pair div {self.b_size}")
        sums = self._block_pairs().groupBy("pair").agg(F.sum("docs").alias("n"))
        return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(of_a)))

    def pairs(self) -> DataFrame:
        """``a_id, b_id, n_docs, is_best``: each linked pair of ids, in how many documents, and whether no
        other partner of A's id is in more."""
        return self._counted().select(F.expr(f"pair div {self.b_size}").alias("a_id"), F.expr(f"pair % {self.b_size}").alias("b_id"),
                                      F.col("n").alias("n_docs"), F.col("best").alias("is_best"))

    def documents(self) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: one row for each row of ``docs``."""
        found = self._block_pairs().join(self._counted(), "pair").select("block", "at", "n", "best")
        docs = self.rows.filter("pair IS NULL").select(F.col("block").alias("of_block"), *_FACTS, "at", "times")
        return docs.groupBy("of_block").cogroup(found.groupBy("block")).applyInArrow(
            _answered, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
