"""Bounded-space online packing of tokenized documents into windows.

Each partition reads its documents once, in order, and keeps a fixed number of
open windows. A piece goes to the window that it fits best. When none fits, the
fullest window is topped up with the head of the piece and emitted. The windows that
are open when a partition ends are merged by placing their pieces again.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words whose ids a Python worker remembers (about 150 bytes each), and bytes of text encoded at a time.
REMEMBERED, BYTES = 500_000, 1 << 21
#: Partitions whose open windows are merged together.
MERGED = 64


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[list(b".,;:!?|%$#*&")] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xC4, 0xC5]] = True  # first byte of U+00C0 to U+017F: letters but for two signs, C3 97 and C3 B7


class WordEncoder:
    """Ids of texts by way of their words, for tokenizers that join nothing across white
    space, put letters in lower case, and cut between letters and marks.

    A text's ids are then those of its words one after another. A-Z are lowered and
    marks parted from letters first, so that there are fewer distinct words, and
    each distinct word is encoded once. Words of letters only are encoded many at a time: if as many
    tokens have the end-of-word suffix as there are words, each ends one of them.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        length = np.zeros(len(words), np.int64)
        ids: list = [None, None]
        for k, of in enumerate((np.flatnonzero(plain), np.flatnonzero(~plain))):
            found = []
            for i in range(0, len(of), 5000):
                part = of[i:i + 5000]
                own = [words[j] for j in part]
                if k == 0:
                    got = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, np.uint32)
                    stop = np.flatnonzero(self.ends[got]) + 1
                    if len(stop) == len(own):
                        length[part] = np.diff(stop, prepend=0)
                        found.append(got)
                        continue
                each = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                length[part] = [len(e) for e in each]
                found.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
            ids[k] = np.concatenate(found) if found else np.zeros(0, np.uint32)
        of_plain = np.repeat(plain, length)
        out = np.empty(len(of_plain), np.uint32)
        out[of_plain], out[~of_plain] = ids
        return out, length

    def _numbers(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(self.number) + len(new) > REMEMBERED:
            self._forget()
            new = np.arange(len(words))
        if len(new):
            own = [words[i] for i in new]
            ids, length = self._ids(own)
            at[new] = np.arange(len(self.length), len(self.length) + len(new))
            self.number.update(zip(own, at[new].tolist()))
            self.flat, self.length = np.r_[self.flat, ids], np.r_[self.length, length]
        return at

    @staticmethod
    def _parted(texts: pa.Array) -> pa.Array:
        """Texts with A-Z lowered and spaces between letters and marks after them. Texts
        that might hold a special token's name are left as they are."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        if ((data[:-1] == 60) & (data[1:] == 124)).any():
            return texts
        offsets = offsets - offsets[0]
        data = _LOWER[data]
        letter = _LETTER[data]
        letter[1:] |= _LEAD[data[:-1]] & (data[1:] & 0xC0 == 0x80) & ~((data[:-1] == 0xC3) & (data[1:] & 0x9F == 0x97))
        at = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(at, offsets)), pa.py_buffer(np.insert(data, at, 32)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where each text's begin, with the end as the last."""
        split = pc.ascii_split_whitespace(self._parted(texts))
        coded = split.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
        of = self.length[at]
        ends = np.r_[0, np.cumsum(of)]
        begin = (np.cumsum(self.length) - self.length)[at]
        place = np.repeat((begin - ends[:-1]).astype(np.int32), of)  # what is held is far below 2^31
        place += np.arange(ends[-1], dtype=np.int32)
        out = self.flat[place]
        offsets = np.asarray(split.offsets, np.int64)
        return out, ends[offsets - offsets[0]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This process's encoder, so that a worker that is used again still knows the words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Windows:
    """The open windows of one partition."""

    def __init__(self, size: int, n_open: int, max_pad: int):
        self.size, self.n_open, self.max_pad = size, n_open, max_pad
        self.open: list[list] = []  # [fill, pieces]
        self.done = 0

    def add(self, doc, ids: np.ndarray, out: list) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._emit([0, []], self._piece(doc, ids, start, self.size, total), out)
            start += self.size
        while start < total:
            rest = total - start
            fits = [w for w in self.open if self.size - w[0] >= rest]
            if fits:
                window, take = max(fits, key=lambda w: w[0]), rest
            elif len(self.open) < self.n_open:
                window, take = [0, []], rest
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                self.open.remove(window)
                take = self.size - window[0]
                if take <= self.max_pad:
                    self._emit(window, None, out)
                    continue
                self._emit(window, self._piece(doc, ids, start, take, total), out)
                start += take
                continue
            window[1].append(self._piece(doc, ids, start, take, total))
            window[0] += take
            start += take
            if window[0] == self.size:
                self.open.remove(window)
                self._emit(window, None, out)

    @staticmethod
    def _piece(doc, ids, start, length, total):
        return doc, start, length, zlib.crc32(ids[start:start + length].astype("<u4").tobytes()), total

    def _emit(self, window: list, last, out: list, is_open: bool = False) -> None:
        offset = 0
        for piece in window[1] + ([last] if last else []):
            out.append((*piece, self.done, offset, is_open))
            offset += piece[2]
        self.done += 1

    def close(self, out: list) -> None:
        for window in self.open:
            self._emit(window, None, out, True)
        self.open = []


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                   + [("is_open", pa.bool_()), ("part", pa.int64())])


def _pack(path: str, end_id: int, size: int, n_open: int, max_pad: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = encoder_of(path), Windows(size, n_open, max_pad)
        part = TaskContext.get().partitionId()

        def rows(out: list) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 8
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _ARROW)), pa.array([part] * len(out), pa.int64())], schema=_ARROW)

        for batch in batches:
            end = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0), np.int64)) // BYTES
            edges = np.r_[0, np.flatnonzero(np.diff(end)) + 1, batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                piece = batch.slice(a, b - a)
                ids, bounds = encoder.encode(piece.column(1))
                out: list = []
                for doc, a, b in zip(piece.column(0).to_pylist(), bounds, bounds[1:]):
                    windows.add(doc, np.r_[ids[a:b], np.uint32(end_id)], out)
                yield rows(out)
        out = []
        windows.close(out)
        yield rows(out)
        pa.default_memory_pool().release_unused()
    return run


def place_again(pieces: pd.DataFrame, size: int) -> pd.DataFrame:
    """``sequence_id`` and ``offset`` of pieces by best fit, the longest first."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "part", "sequence_id", "offset"],
                                ascending=[False, True, True, True, True, True], ignore_index=True)
    free: list[tuple[int, int]] = []  # (room, window), sorted
    ids, offsets, made = [], [], 0
    for length in pieces["length"]:
        k = bisect.bisect_left(free, (length, -1))
        if k < len(free):
            room, window = free.pop(k)
        else:
            room, window = size, made
            made += 1
        ids.append(window)
        offsets.append(size - room)
        if room > length:
            bisect.insort(free, (room - length, window))
    return pieces.assign(sequence_id=np.array(ids, np.int64), offset=np.array(offsets, np.int64))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         size: int = 2048, n_open: int = 32, max_pad: int = 8) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all rows of ``docs``.

    A document's ids are the tokenizer's for its text, then ``end_id``; null and
    empty texts have that one id. Each id lies in exactly one piece. A document
    of ``size`` ids or more fills windows of its own first. Windows are emitted
    with at most ``max_pad`` ids of room, but for those that are left when a
    partition ends: their pieces are placed again, ``MERGED`` partitions at a time, so a
    group's size depends on ``n_open`` and not on the data. Repeated rows and
    null ids are documents of their own. Other columns are ignored.

    The texts are read and tokenized once; what is stored and merged has no ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = stored(rows.mapInArrow(_pack(tokenizer_path, end_id, size, n_open, max_pad), PIECE + ", is_open boolean, part long"), "pieces")
    names = [f.split()[0] for f in PIECE.split(", ")]
    done = (placed.filter("NOT is_open")
            .withColumn("sequence_id", F.shiftleft("part", 32) + F.col("sequence_id")).select(names))
    left = placed.filter("is_open").withColumn("group", F.floor(F.col("part") / MERGED))

    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        out = place_again(pieces, size)
        out["sequence_id"] += (1 << 62) + (int(key[0]) << 32)
        return out[names]

    return done.unionByName(left.groupBy("group").applyInPandas(merge, PIECE))
