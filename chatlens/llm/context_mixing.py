"""Language-model scores by online logistic context mixing.

A text's bytes (A-Z in lower case, then an end mark) are coded bit by bit along a
Huffman tree that depends on the byte before. For each of several context lengths, the next
bit is predicted from what training texts had after the same bytes. The
predictions are combined in the logistic domain by weights that a gate selects (how
deep the bit lies in the tree, and whether the longest context is known). Each text begins
with the same weights, fitted to training texts, which follow the gradient of its coding cost from block
to block. The cost in bits over the bytes is its bits per byte.

Counts come from all training texts. Texts are dealt into buckets of bounded size, and
hashed contexts (and words) into as many parts. A task counts the n-grams of its buckets and sends each part
its share as one row of packed numbers; a part adds up what it got and answers each bucket with the counts of
the contexts that it has, under their own keys. So what is learnt grows with the corpus, no two
contexts share a count, and a task holds one bucket or one part at a time. Word counts, for the unigram
baseline, go the same way.

The first weights are fitted before the texts are scored, to all training texts: each bucket adds up the first and second
derivatives of their coding cost, with every occurrence left out of its own counts, and the sums over all buckets give
one Newton step. For this a bucket needs no texts: its answers say how often each n-gram occurs in its training texts.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Lengths of the contexts in bytes; the n-grams counted are one longer than the last.
ORDERS = (2, 3, 5)
GRAM = 6
#: Weights before they are fitted, by order of length, where the longest context is known and where it isn't.
KNOWN, UNKNOWN = (0.1, 0.3, 0.7), (0.2, 0.9, 0.0)
#: Counts added to either side; rate of the weights, and bits to which a block's bits are added before it is divided by them; units of a stored prediction.
PRIOR, RATE, PULL, UNIT = 0.15, 0.5, 32, 1 / 2048
#: Depths in the tree that have weights of their own.
GATES = 8
#: What is added to a second derivative, in bits, and the longest step of a weight.
RIDGE, STEP = 32.0, 0.5
#: Bytes of text in a bucket, up to the end of the text that fills it, and partitions at most.
BUCKET, PARTITIONS = 32 << 20, 20_000
END = 255  # no byte of UTF-8
#: Bytes counted and scored at a time, distinct n-grams or words kept before they are passed on, distinct n-grams fitted at a time, and bytes between updates of a text's weights: from, to.
CHUNK, SCORED, HELD, FITTED = 1 << 20, 4 << 20, 1 << 20, 1 << 19
#: Numbers in a packed row: Spark reads thousands of rows at a time.
ROW = 1024
UPDATE = (512, 8192)


def lowered(text: pa.Array) -> pa.Array:
    """Texts as binary with A-Z in lower case; null as empty."""
    return pc.ascii_lower(text.fill_null("").cast(pa.large_string())).cast(pa.large_binary())


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``GRAM - 1`` zeros and followed by ``END``, and where each begins."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    start = np.r_[0, np.cumsum(size + GRAM)]
    out = np.zeros(start[-1], np.uint8)
    for a, n, to in zip(offsets, size, start):
        out[to + GRAM - 1:to + GRAM - 1 + n] = data[a:a + n]
        out[to + GRAM - 1 + n] = END
    return out, start


def grams(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte of each text, in order."""
    wide = data.astype(np.int64)
    out = wide[GRAM - 1:].copy()
    for k in range(1, GRAM):
        out |= wide[GRAM - 1 - k:len(wide) - k] << (8 * k)
    keep = np.ones(len(out), bool)
    for at in start[1:-1]:
        keep[at - GRAM + 1:at] = False
    return out[keep]


def parts_of(texts: pa.Array, size: int = CHUNK) -> Iterator[slice]:
    """Runs of texts of about ``size`` bytes."""
    n = np.asarray(pc.binary_length(texts), np.int64) + GRAM
    group = np.cumsum(n) // size
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(n)] if len(n) else [0]
    for a, b in zip(edges, edges[1:]):
        yield slice(a, b)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word of the texts, and the text that it is in.

    The key is a polynomial in a fixed odd number whose coefficients are fixed random
    numbers of the bytes, mixed with the length; a long word's is its XXH64.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]  # a text ends its last word
    begins[first] = ~space[first]
    start = np.flatnonzero(begins)
    stops = space
    stops[first] = True
    stop = np.flatnonzero(stops)
    stop = np.r_[stop, len(data)][np.searchsorted(stop, start, "right")]
    size = stop - start
    key = size.astype(np.uint64)
    at, of = start.copy(), np.arange(len(start))
    value = key.copy()
    for k in range(LONG):
        value = value * _BASE + _COEFFICIENT[data[at]]
        more = size[of] > k + 1
        key[of[~more]] = value[~more]
        at, of, value = at[more] + 1, of[more], value[more]
        if not len(of):
            break
    for i in of:
        key[i] = xxhash.xxh64_intdigest(data[start[i]:stop[i]].tobytes(), 1)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    return key.view(np.int64), np.searchsorted(offsets, start, "right") - 1


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COEFFICIENT = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
LONG = 64


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in pairs])
    counts = np.concatenate([c for _, c in pairs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts


class _Sums:
    """Counts by key, added up whenever enough have gathered."""

    def __init__(self):
        self.pairs: list = []
        self.rows = 0

    def add(self, keys, counts):
        self.pairs.append((keys, counts))
        self.rows += len(keys)
        if self.rows > HELD:
            self.pairs = [_added(self.pairs)]
            self.rows = len(self.pairs[0][0])

    def take(self):
        out = _added(self.pairs) if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.pairs, self.rows = [], 0
        return out


def _bucketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their size and the number of their bucket: the task's, then that of the run of ``BUCKET`` bytes within it."""
    base, full = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(1).fill_null("")), np.int64)
        ends = full + np.cumsum(size + GRAM)
        bucket = base + (ends - size - GRAM) // BUCKET
        full = int(ends[-1]) if len(ends) else full
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(bucket)], ["doc_id", "text", "held_out", "size", "bucket"])


def _bundled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, texts``: for each run of about ``CHUNK`` bytes of a bucket's texts, its rows as one compressed Arrow stream.
    In a shuffle this takes about two thirds of what the texts do, each in a row of its own."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for bucket in pc.unique(table["bucket"]).to_pylist():
            own = table.filter(pc.equal(table["bucket"], bucket)).drop_columns("bucket")
            for s in parts_of(own["text"].combine_chunks().fill_null("")):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_table(own[s.start:s.stop])
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "texts"])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _pressed(numbers: np.ndarray) -> bytes:
    """Differences of 64-bit numbers, the first bytes of all, then the second ones and so on, compressed."""
    return _PRESS.compress(np.diff(numbers, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpressed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPRESS.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


_PRESS, _UNPRESS = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _packed(rows: list[tuple], names: list[str], arrays: int = 2) -> pa.Table:
    """Rows whose last columns are arrays of 64-bit numbers, or none after the first one, at most ``ROW`` of them in a row."""
    rows = [(*r[:-arrays], *(x if x is None else _pressed(x[a:a + ROW].astype(np.int64, copy=False)) for x in r[-arrays:]))
            for r in rows for a in range(0, len(r[-arrays]), ROW)]
    kinds = [pa.int64()] * (len(names) - arrays) + [pa.binary()] * arrays
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _numbers(column, rows) -> list[np.ndarray]:
    return [_unpressed(column[int(i)].as_py()) for i in rows]


SHARES = "part long, bucket long, ord long, keys binary, counts binary"


def _statistics(parts: int):
    """``SHARES`` rows: the words (order 0) and n-grams of each bucket with their counts, dealt to parts by word or
    context. What held-out texts alone have counts 0. A bucket may send a part more than one row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(bucket, order, keys, counts):
            part = _part_of(keys >> 8 if order else keys, parts)
            turn = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            edges = np.searchsorted(part[turn], np.arange(parts + 1))
            return [(p, bucket, order, keys[turn[a:b]], counts[turn[a:b]]) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]

        def passed(bucket, words, found):
            rows = dealt(bucket, 0, *words.take())
            keys, counts = found.take()
            for o in reversed(ORDERS):
                keys, counts = _added([(keys & ((1 << 8 * (o + 1)) - 1), counts)])
                rows += dealt(bucket, o, keys, counts)
            return _packed(rows, ["part", "bucket", "ord", "keys", "counts"]).to_batches()

        at, words, found = None, _Sums(), _Sums()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for bucket in pc.unique(table["bucket"]).to_pylist():
                own = table.filter(pc.equal(table["bucket"], bucket))
                texts, held = lowered(own["text"].combine_chunks()), np.asarray(own["held_out"].combine_chunks())
                if bucket != at and at is not None:
                    yield from passed(at, words, found)
                at = bucket
                for s in parts_of(texts):
                    part, out = texts[s.start:s.stop], held[s]
                    keys, owner = word_keys(part)
                    learnt = ~out[owner]
                    words.add(*np.unique(keys[learnt], return_counts=True))
                    other = np.unique(keys[~learnt])
                    words.add(other, np.zeros(len(other), np.int64))
                    if not out.all():
                        found.add(*np.unique(grams(*joined(part.filter(pa.array(~out)))), return_counts=True))
                    if out.any():
                        other = np.unique(grams(*joined(part.filter(pa.array(out)))))
                        found.add(other, np.zeros(len(other), np.int64))
                    if found.rows > 3 * HELD // 4 and len(found.pairs) == 1:
                        yield from passed(at, words, found)
        if at is not None:
            yield from passed(at, words, found)
        pa.default_memory_pool().release_unused()
    return run


ANSWERS = "bucket long, ord long, keys binary, counts binary, times binary, own binary"


def _answers(shares: pa.Table) -> pa.Table:
    """``ANSWERS`` rows of one part: for each bucket, its words with their counts, and all n-grams of its contexts with theirs;
    for the longest contexts also how many ``times`` each n-gram is in the bucket's own training texts.

    A row of bucket -1 has, in ``own``, what the part adds to the tokens, to the distinct words and to each pair of bytes.
    """
    order, bucket = shares["ord"].to_numpy(), shares["bucket"].to_numpy()
    key_column, count_column = shares["keys"], shares["counts"]
    rows, tokens, types, pairs = [], 0, 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for o in (0, *ORDERS):
        here = np.flatnonzero(order == o)
        if not len(here):
            continue
        here = here[np.argsort(bucket[here], kind="stable")]
        keys = _numbers(key_column, here)
        counts = _numbers(count_column, here)
        total, sums = _added(list(zip(keys, counts)))
        if o:
            total, sums = total[sums > 0], sums[sums > 0]
            context = total >> 8
        else:
            tokens, types = int(sums.sum()), int((sums > 0).sum())
        if o == ORDERS[0]:
            pairs = _added([(total & 0xFFFF, sums)])
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[here]) != 0, True])
        for a, b in zip(edges, edges[1:]):
            own, times = np.concatenate(keys[a:b]), None
            if o:
                asked = np.unique(own >> 8)
                low, high = np.searchsorted(context, asked), np.searchsorted(context, asked + 1)
                size = high - low
                at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            else:
                at = np.searchsorted(total, np.unique(own))
            if o == ORDERS[-1]:
                learnt, n = _added(list(zip(keys[a:b], counts[a:b])))
                times = np.zeros(len(at), np.int64)
                times[np.searchsorted(total[at], learnt[n > 0])] = n[n > 0]
            rows.append((bucket[here[a]], o, total[at], sums[at], times))
    out = _packed(rows, ["bucket", "ord", "keys", "counts", "times"], 3)
    out = out.append_column("own", pa.nulls(len(out), pa.binary()))
    own = _pressed(np.r_[tokens, types, pairs[0], pairs[1]].astype(np.int64))
    pa.default_memory_pool().release_unused()
    return pa.concat_tables([out, pa.table([pa.array([-1]), pa.array([0]), pa.array([b""]), pa.array([b""]), pa.nulls(1, pa.binary()), pa.array([own], pa.binary())], names=out.column_names)])


def _part_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): sums of what the parts have in ``own``; pair -2 is for the tokens, -1 for the distinct words."""
    sums = np.zeros(2 + (1 << 16), np.int64)
    for batch in batches:
        for own in _numbers(batch.column(0), range(batch.num_rows)):
            half = len(own) // 2 - 1
            sums[:2] += own[:2]
            sums[own[2:2 + half] + 2] += own[2 + half:]
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some - 2), pa.array(sums[some])], ["pair", "n"])


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each of 256 values, its path of (node, bit) from the root."""
    heap = [(int(c) * 64 + 1, v) for v, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict = {}
    for node in range(256, 511):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node - 255, 0), (node - 255, 1)
        heapq.heappush(heap, (a + b, node))
    paths = []
    for v in range(256):
        path, at = [], v
        while at in parent:
            path.append(parent[at])
            at = parent[at][0] + 255
        paths.append(path[::-1])
    return paths


class Code:
    """A Huffman code of byte values for each byte before: length, place among the tree's leaves from left to right,
    and per depth the bit's sign and the first leaf on the node's right.

    All are found by the two bytes as one number.
    """

    def __init__(self, counts: np.ndarray):
        plain = None
        paths, rank, right = [], [], []
        for own in counts:
            tree = huffman(own) if own.any() else (plain := plain or huffman(own))
            leaves = sorted(range(256), key=lambda v: [bit for _, bit in tree[v]])
            first: dict[int, int] = {}
            for r, v in enumerate(leaves):
                for n, bit in tree[v]:
                    if bit:
                        first.setdefault(n, r)
            paths += tree
            rank.append(np.argsort(leaves))
            right += [first] * 256
        self.rank = np.concatenate(rank).astype(np.int64)
        self.length = np.array([len(p) for p in paths], np.uint8)
        depth = int(self.length.max())
        self.sign = np.zeros((depth, 1 << 16), np.float32)
        self.split = np.zeros((depth, 1 << 16), np.uint8)
        for v, path in enumerate(paths):
            for d, (n, bit) in enumerate(path):
                self.sign[d, v], self.split[d, v] = 2 * bit - 1, right[v][n]


def _ranks(numbers: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of numbers below 2^24 among those that occur, and how many these are."""
    there = np.zeros(1 << 24, bool)
    there[numbers] = True
    values = np.flatnonzero(there)
    rank = np.empty(1 << 24, np.int32)
    rank[values] = np.arange(len(values), dtype=np.int32)
    return rank[numbers], len(values)


def distinct(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, those that are equal in their last bytes next to each other, and the place of each of ``gram`` among them."""
    head = gram >> 24
    low, n_low = _ranks(gram & 0xFFFFFF)
    high, n_high = _ranks((head & 0xFF) << 16 | head & 0xFF00 | head >> 16)
    bits, width = n_high.bit_length(), len(gram).bit_length()
    key = low.astype(np.int64) << bits | high
    if n_low.bit_length() + bits + width > 63:
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        return gram[first], at.astype(np.int32)
    # one sort of n-gram and place together is faster than a sort of places
    key = key << width | np.arange(len(gram))
    key.sort()
    place = key & ((1 << width) - 1)
    key >>= width
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.empty(len(gram), np.int32)
    at[place] = np.cumsum(first, dtype=np.int32) - 1
    return gram[place[first]], at


def first_weights(known=KNOWN, unknown=UNKNOWN) -> np.ndarray:
    """Weights by order, known or not, and gate."""
    return np.array([[known, unknown]] * GATES, np.float32).transpose(2, 1, 0).copy()


class Mixer:
    """Scores texts with counts: for each order, n-grams as context, then leaf of the last byte, in order, and sums of
    what is before each. Nothing of one text reaches another.
    """

    def __init__(self, code: Code, counts: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray | None = None, orders=ORDERS, rate: float = RATE):
        self.code, self.orders, self.rate = code, orders, rate
        self.first = first_weights() if first is None else first
        self.tables: list[np.ndarray] = []
        self.counts = []
        for keys, n in counts:
            keys = keys & ~0xFF | code.rank[keys & 0xFFFF]
            order = np.argsort(keys)
            self.counts.append((keys[order], np.r_[0, np.cumsum(n[order])]))

    def places(self, gram: np.ndarray, without: bool = False) -> list[np.ndarray]:
        """For each order, where ``odds`` finds the predictions for each n-gram's last byte; ``without`` one occurrence of it."""
        return self._places(*distinct(gram), without)

    def _places(self, own: np.ndarray, at: np.ndarray, without: bool) -> list[np.ndarray]:
        self.tables, out = [], []
        for k, o in enumerate(self.orders):
            short = own & ((1 << 8 * (o + 1)) - 1)
            first = np.r_[True, short[1:] != short[:-1]] if len(short) else np.zeros(0, bool)
            short = short[first]
            # searched in the order of the counts, so that one search ends near the next
            order = np.argsort(short & ~0xFF | self.code.rank[short & 0xFFFF])
            self.tables.append(self.paths(k, short[order], without))
            place = np.empty(len(short), np.int32)
            place[order] = np.arange(len(short), dtype=np.int32)
            out.append(place[np.cumsum(first) - 1][at])
        return out

    def paths(self, k: int, gram: np.ndarray, without: bool = False) -> np.ndarray:
        """For each depth, the predictions on the ways to the last bytes of some n-grams."""
        keys, sums = self.counts[k]
        out = np.zeros((len(self.code.sign), len(gram)), np.int16)
        base, pair = gram & ~0xFF, gram & 0xFFFF
        low, high = np.searchsorted(keys, base), np.searchsorted(keys, base + 256)
        live = np.arange(len(gram))
        for d in range(len(out)):
            more = (high > low) & (self.code.length[pair] > d)
            if not more.all():
                live, base, pair, low, high = (x[more] for x in (live, base, pair, low, high))
            if not len(live):
                break
            edge = base + self.code.split[d, pair]
            middle = low + (keys[low] < edge)
            far = np.flatnonzero((high - low > 1) & (middle > low))
            middle[far] = np.searchsorted(keys, edge[far])
            ones, zeros = sums[high] - sums[middle], sums[middle] - sums[low]
            one = self.code.sign[d, pair] > 0
            if without:
                ones, zeros = np.maximum(ones - one, 0), np.maximum(zeros - ~one, 0)
            odds = np.clip(np.round(np.log((ones + PRIOR) / (zeros + PRIOR)) / UNIT), -32767, 32767)
            odds[odds == 0] = 1  # 0 is for what is not known
            if without:
                odds[ones + zeros == 0] = 0
            out[d, live] = odds
            low, high = np.where(one, middle, low), np.where(one, high, middle)
        return out

    def odds(self, k: int, d: int, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Predictions of the ``k``-th order at depth ``d``, in units; 0 where nothing is known."""
        return self.tables[k][d][place]

    def cost(self, texts: pa.Array) -> np.ndarray:
        """Natural logarithm of each text's probability, negative."""
        data, start = joined(texts)
        gram = grams(data, start)
        symbol, place = (gram & 0xFFFF).astype(np.uint16), self.places(gram)
        size = np.diff(start) - GRAM + 1
        begin = np.r_[0, np.cumsum(size)]
        weights = np.repeat(self.first[..., None], len(size), axis=3)
        total = np.zeros(len(size))
        done, step = np.zeros(len(size), np.int64), UPDATE[0]
        while (left := np.flatnonzero(done < size)).size:
            ends = size[left] - done[left] <= step
            for these, learn in ((left[~ends], True), (left[ends], False)):  # weights that no later byte needs aren't learnt
                if not len(these):
                    continue
                take = np.minimum(size[these] - done[these], step)
                at = np.repeat(begin[these] + done[these] - np.r_[0, np.cumsum(take)[:-1]], take) + np.arange(take.sum())
                own = weights[..., these]
                total[these] += self._mix(symbol[at], [p[at] for p in place], take, own, learn)
                weights[..., these] = own
                done[these] += take
            step = min(2 * step, UPDATE[1])
        return total

    def _mix(self, symbol, where, take, weights, learn: bool = True) -> np.ndarray:
        """Cost of the next bytes of some texts, whose weights follow if they ``learn``; ``take`` bytes of each, one text after another."""
        n, last = len(take), len(self.orders) - 1
        owner = np.repeat(np.arange(n, dtype=np.int32), take)
        cost, length = np.zeros(n), self.code.length[symbol]
        gradient, seen = np.zeros(weights.shape), np.zeros(weights.shape[1:])
        for d in range(len(self.code.sign)):
            longer = length > d
            if not longer.all():
                keep = np.flatnonzero(longer)
                symbol, owner, length = symbol[keep], owner[keep], length[keep]
                where = [w[keep] for w in where]
            if not len(symbol):
                break
            count = np.bincount(owner, minlength=n)
            texts = np.flatnonzero(count)
            edge = (np.cumsum(count) - count)[texts]
            gate = min(d, GATES - 1)
            odds = [self.odds(k, d, w, symbol).astype(np.float32) for k, w in enumerate(where)]
            new = np.flatnonzero(odds[last] == 0)
            mixed = np.zeros(len(symbol), np.float32)
            for k in range(last + 1):
                mixed += np.repeat(weights[k, 0, gate, texts] * np.float32(UNIT), count[texts]) * odds[k]
            new_owner = owner[new]
            mixed[new] = sum((weights[k, 1, gate] * np.float32(UNIT))[new_owner] * odds[k][new] for k in range(last))
            # the sign makes the coded bit the one that is asked for
            sign = self.code.sign[d][symbol]
            e = np.exp(np.clip(mixed * -sign, -15, 15))
            cost[texts] += np.add.reduceat(np.log1p(e) if len(e) < 64 else np.log(1 + e), edge, dtype=np.float64)
            if not learn:
                continue
            error = e / (1 + e) * sign
            times = np.bincount(new_owner, minlength=n)
            seen[1, gate] += times
            seen[0, gate] += count - times
            for k in range(last + 1):
                pull = error * odds[k]
                if k < last and len(new):
                    gradient[k, 1, gate] += np.bincount(new_owner, pull[new], n)
                    pull[new] = 0
                gradient[k, 0, gate, texts] += np.add.reduceat(pull, edge)
        if learn:
            weights += (self.rate * UNIT * gradient / (seen + PULL)).astype(np.float32)
        return -cost

    def slopes(self, texts: pa.Array) -> np.ndarray:
        """``gram_slopes`` of some training texts."""
        own, at = distinct(grams(*joined(texts)))
        return self.gram_slopes(own, np.bincount(at, minlength=len(own)))

    def gram_slopes(self, own: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sums over all bits of training texts that have some distinct n-grams so many times, each occurrence left out of
        its own counts, by whether the longest context is known and gate: for each order, the derivative of the negative
        cost by its weight, then the second derivatives of the cost. Equal n-grams give equal terms, so each is looked at once."""
        symbol, where = (own & 0xFFFF).astype(np.uint16), self._places(own, np.arange(len(own), dtype=np.int32), True)
        times = times.astype(np.float32)
        length, n = self.code.length[symbol], len(self.orders)
        out = np.zeros((2, GATES, n, 1 + n))
        for d in range(len(self.code.sign)):
            keep = np.flatnonzero(length > d)
            if not len(keep):
                break
            if len(keep) < len(symbol):
                symbol, length, times, where = symbol[keep], length[keep], times[keep], [w[keep] for w in where]
            odds = np.stack([self.odds(k, d, w, symbol) for k, w in enumerate(where)])
            new = odds[-1] == 0
            gate = min(d, GATES - 1)
            for unknown, these in ((0, np.flatnonzero(~new)), (1, np.flatnonzero(new))):
                if not len(these):
                    continue
                x = odds[:, these] * np.float32(UNIT)
                sign = self.code.sign[d][symbol[these]]
                e = np.exp(np.clip((self.first[:, unknown, gate] @ x) * -sign, -15, 15))
                e /= 1 + e
                by = times[these] * e
                out[unknown, gate, :, 0] += x @ (by * sign)
                out[unknown, gate, :, 1:] += (x * (by * (1 - e))) @ x.T
        return out

    def fitted(self, texts: pa.Array) -> np.ndarray:
        """First weights that suit some training texts, each occurrence left out of its own counts."""
        return stepped(self.first, self.slopes(texts))


def stepped(first: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Weights one Newton step from ``first``, by the sums of ``Mixer.slopes``."""
    out = first.copy()
    for unknown in range(2):
        for gate in range(GATES):
            own = slopes[unknown, gate]
            step = np.linalg.solve(own[:, 1:] + RIDGE * np.eye(len(own)), own[:, 0])
            out[:, unknown, gate] += np.round(np.clip(step, -STEP, STEP), 4)
    return out


def _known(rows: pa.Table, order: int, column: str = "counts") -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts that a bucket got for one order."""
    here = np.flatnonzero(rows["ord"].to_numpy() == order)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(_numbers(rows["keys"], here) or none), np.concatenate(_numbers(rows[column], here) or none)


def _fit(code):
    """``place, slope``: what the n-grams of a bucket's training texts add to ``Mixer.gram_slopes``."""
    def run(key: tuple, known: pa.Table) -> pa.Table:
        gram, times = _known(known, ORDERS[-1], "times")
        gram, times = gram[times > 0], times[times > 0]
        # in the order of ``distinct``: those that are equal in their last bytes next to each other
        turn = np.argsort((gram & 0xFFFFFF) << 24 | (gram >> 24 & 0xFF) << 16 | (gram >> 32 & 0xFF) << 8 | gram >> 40)
        gram, times = gram[turn], times[turn]
        mixer = Mixer(code.value, [_known(known, o) for o in ORDERS])
        sums = np.sum([mixer.gram_slopes(gram[a:a + FITTED], times[a:a + FITTED]) for a in range(0, len(gram), FITTED)], axis=0).ravel() if len(gram) else np.zeros(0)
        pa.default_memory_pool().release_unused()
        return pa.table({"place": pa.array(np.arange(len(sums))), "slope": pa.array(sums)})
    return run


def _score(code, first: np.ndarray, train_tokens: int, types: int, ends: int):
    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = _known(known, 0)
        turn = np.argsort(keys)
        keys, counts = keys[turn], counts[turn]
        mixer = Mixer(code.value, [_known(known, o) for o in ORDERS], first)
        texts = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for c in texts["texts"].chunks for b in c])
        every = lowered(texts["text"].combine_chunks())
        n_words, n_known, base, cost = [], [], [], []
        for s in parts_of(every, SCORED):
            part = every[s.start:s.stop]
            words_of, owner = word_keys(part)
            own, at = np.unique(words_of, return_inverse=True)
            place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            c = np.where(keys[place] == own, counts[place], 0) if len(keys) else np.zeros(len(own), np.int64)
            n = len(part)
            n_words.append(np.bincount(owner, minlength=n))
            n_known.append(np.bincount(owner, (c > 0)[at], n).astype(np.int64) + (ends > 0))
            base.append(np.bincount(owner, np.log10(c + 1.0)[at], n))
            cost.append(mixer.cost(part))
        tokens = np.concatenate(n_words).astype(np.int64) + 1
        score = np.concatenate(cost) / np.log(10)
        size = np.asarray(pc.binary_length(every), np.int64)
        pa.default_memory_pool().release_unused()
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(tokens),
            "n_known": pa.array(np.concatenate(n_known)), "train_tokens": pa.array(np.full(len(tokens), train_tokens, np.int64)),
            "base_score": pa.array(np.concatenate(base) + np.log10(ends + 1) - tokens * np.log10(train_tokens + types + 1)),
            "score": pa.array(score), "bits_per_byte": pa.array(-score * np.log2(10) / np.maximum(size, 1))})
    return run


def model(texts: DataFrame) -> tuple[Code, DataFrame, int, int]:
    """The code, ``ANSWERS`` for each bucket of ``texts`` (from ``_bucketed``), training tokens without the texts' ends, and distinct words.

    The driver gets the sums for at most 65,536 pairs of bytes, whatever the corpus; the contexts stay in Spark.
    """
    parts = max(1, -(-(texts.agg(F.sum("size")).first()[0] or 0) // BUCKET))
    shares = texts.select("text", "held_out", "bucket").mapInArrow(_statistics(parts), SHARES)
    answers = stored(shares.repartition(min(parts, PARTITIONS), "part").groupBy("part").applyInArrow(_answers, ANSWERS), "answers")
    sums = answers.filter("own IS NOT NULL").select("own").mapInArrow(_part_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(2 + (1 << 16), np.int64)
    for r in sums.collect():
        counts[r["pair"] + 2] = r["n"]
    return Code(counts[2:].reshape(256, 256)), answers.filter("bucket >= 0").drop("own"), int(counts[0]), int(counts[1])


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    ``held_out`` is a condition on ``docs``; null counts as held out. The model, its first weights and
    the word counts learn from the other rows. ``score`` is the log10 probability of the whole
    text and its end; ``base_score`` that of its words and end under add-one unigrams.
    Null texts count as empty: the end alone. Without training rows all predictions are even. Repeated rows and null ids
    stay rows of their own. Other columns are ignored.

    The texts are stored once with their buckets. Words are told apart by a 64-bit key, contexts by their bytes; each bucket is sent the
    counts of its own words and contexts, so no task holds the vocabulary or the model.
    """
    held = F.coalesce(held_out, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    rows = stored(rows.mapInArrow(_bucketed, "doc_id long, text string, held_out boolean, size long, bucket long"), "texts", "zstd")
    code, answers, tokens, types = model(rows)
    code = rows.sparkSession.sparkContext.broadcast(code)
    buckets, ends = rows.agg(F.count_distinct("bucket"), F.count_if(~F.col("held_out"))).first()
    partitions = max(1, min(buckets, PARTITIONS))

    def by_bucket(part: DataFrame):
        return part.repartition(partitions, "bucket").groupBy("bucket")

    slopes = np.zeros((2, GATES, len(ORDERS), 1 + len(ORDERS)))
    fitted = by_bucket(answers.filter(F.col("ord") > 0)).applyInArrow(_fit(code), "place long, slope double")
    for r in fitted.groupBy("place").agg(F.sum("slope").alias("slope")).collect():
        slopes.flat[r["place"]] = r["slope"]
    first = stepped(first_weights(), slopes)
    texts = rows.select("doc_id", "text", "held_out", "bucket").mapInArrow(_bundled, "bucket long, texts binary")
    return (by_bucket(texts).cogroup(by_bucket(answers.drop("times")))
            .applyInArrow(_score(code, first, tokens + ends, types + (ends > 0), ends),
                          "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"))
