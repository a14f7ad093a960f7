"""Hard negatives by zone maps over Hilbert-ordered blocks.

All vectors are put in the order of a Hilbert curve (within their label) and cut into blocks,
stored as Parquet: one row a block, with its least and greatest value in each dimension, its zone. For an
anchor, interval arithmetic on a zone bounds the inner product with every
vector of the block. Blocks whose bounds miss all windows of scores that the anchor asks
for aren't read for it.

An anchor first asks for its positives, then for the rows in the windows that the
positives' scores set. Each time, it reads the most promising blocks first; the scores
found there narrow the windows for the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a block, zones or anchors that meet at a time, bits of a dimension on the curve, blocks that are
#: tried first for each window, and rows that a task gathers before it merges them.
ROWS, MEET, BITS, TRIED, GATHERED = 512, 256, 3, 4, 1 << 18
_LOW, _HIGH = -(1 << 62), 1 << 62
_NONE = np.iinfo(np.int64).min


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve, as rows of bytes, of points whose coordinates have ``bits`` bits.

    The transposed form of the index: reflections and exchanges from the highest bit down, then a Gray code.
    """
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    # the index has the highest bits of all dimensions first
    spread = np.stack([(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(dims)], axis=1)
    return np.packbits(spread.astype(np.uint8), axis=1)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.int64).reshape(-1, width)


def _with_key(spans: dict[int, tuple[np.ndarray, np.ndarray]], schema: pa.Schema):
    """Adds each vector's place on the curve; ``spans`` has each dimension's least and greatest value."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            keys = np.full(len(dims), b"", object)
            for dim in np.unique(dims[dims > 0]).tolist():
                of = np.flatnonzero(dims == dim)
                low, high = spans[dim]
                v = _matrix(batch.column("v").take(pa.array(of)), dim).astype(float)
                cell = np.floor((v - low) / np.maximum(high - low, 1) * ((1 << BITS) - 1e-9))
                keys[of] = [k.tobytes() for k in hilbert_keys(np.clip(cell, 0, (1 << BITS) - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())], schema=schema)
    return run


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("label_low", pa.int64()), ("label_high", pa.int64()),
                    ("low", _LONGS), ("high", _LONGS), ("ids", _LONGS), ("labels", _LONGS), ("data", _LONGS)])
_BLOCK_DDL = ("block long, dim int, label_low long, label_high long, low array<long>, high array<long>, "
              "ids array<long>, labels array<long>, data array<long>")


def _cut(rows: int):
    """Blocks of sorted rows. A block has one length of vectors; it ends at a new label if it is half full."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None

        def blocks(table: pa.Table, last: bool):
            """Whole blocks of ``table``, and what is left for the next batch."""
            nonlocal number
            dim, label = (np.asarray(table.column(c)) for c in ("dim", "label"))
            new_dim, new_label = np.diff(dim) != 0, np.diff(label) != 0
            start, out = 0, []
            while start < len(dim):
                stop = min(start + rows, len(dim))
                inside = np.flatnonzero(new_dim[start:stop - 1])
                if len(inside):
                    stop = start + int(inside[0]) + 1
                half = np.flatnonzero(new_label[start:stop - 1])
                half = half[half + 1 >= rows // 2]
                if len(half):
                    stop = start + int(half[0]) + 1
                if stop - start < rows and not last and stop == len(dim):
                    break
                part, width = table.slice(start, stop - start).combine_chunks(), int(dim[start])
                v = _matrix(part.column("v").combine_chunks(), width) if width else np.zeros((stop - start, 0), np.int64)
                ids = np.asarray(part.column("id"))
                order = np.argsort(ids, kind="stable")
                labels = label[start:stop][order]
                out.append((number, width, int(labels.min()), int(labels.max()), v.min(0).tolist(), v.max(0).tolist(),
                            ids[order].tolist(), labels.tolist(), v[order].ravel()))
                number, start = number + 1, stop
            return out, table.slice(start)

        def batch_of(out):
            cols = list(zip(*out)) or [()] * len(_BLOCK)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, held = blocks(table if held is None else pa.concat_tables([held, table]), False)
            yield batch_of(out)
        if held is not None and len(held):
            yield batch_of(blocks(held, True)[0])
    return run


def write_blocks(rows: DataFrame, block_rows: int = ROWS) -> DataFrame:
    """``rows`` (``id, label, dim, v``) in Hilbert-ordered blocks with their zones, stored."""
    spans: dict[int, dict[int, tuple]] = {}
    for r in rows.select("dim", F.posexplode("v")).groupBy("dim", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).collect():
        spans.setdefault(r["dim"], {})[r["pos"]] = (r["low"], r["high"])
    ends = {d: tuple(np.array([s[p][k] for p in range(d)], float) for k in (0, 1)) for d, s in spans.items()}
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", _LONGS), ("key", pa.binary())])
    order = ["dim", "label", "key", "id"]
    keyed = rows.select("id", "label", "dim", "v").mapInArrow(_with_key(ends, schema), "id long, label long, dim int, v array<long>, key binary")
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.mapInArrow(_cut(block_rows), _BLOCK_DDL), "blocks")


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``q`` with any vector of each zone."""
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    # sums beyond 2^53 are rounded: the bounds give way by more than that
    slack = 1e-9 * (np.abs(q).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T)
    slack[slack < 1e-9 * 2 ** 52] = 0
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where no sum can reach 2^53."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if size < 2 ** 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def best_in_windows(s: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(row, window, column, score) of the ``k`` highest allowed scores from ``low`` to ``high``; ties by column."""
    s = np.where(allowed, s, _NONE)
    order = np.argsort(-s.astype(float) if np.abs(s[allowed]).max(initial=0) < 2 ** 53 else _descending(s), axis=1, kind="stable")
    s = np.take_along_axis(s, order, 1)
    valid = s != _NONE
    first = ((s[:, None, :] > high[:, :, None]) & valid[:, None, :]).sum(2)
    last = ((s[:, None, :] >= low[:, :, None]) & valid[:, None, :]).sum(2)
    at = first[:, :, None] + np.arange(min(k, s.shape[1]))
    row, window, nth = np.nonzero(at < last[:, :, None])
    place = at[row, window, nth]
    return row, window, order[row, place], s[row, place]


def _descending(s: np.ndarray) -> np.ndarray:
    """Keys whose ascending order is the descending one of 64-bit integers."""
    return ~s


# an anchor that asks: `key` is its number, [low, high] are its windows (arrays of equal length)
_ASK = "struct<key:bigint,id:bigint,label:bigint,v:array<bigint>,low:array<bigint>,high:array<bigint>>"
_NEED = f"block bigint, key bigint, window int, gain double, ask {_ASK}"


def _asks(lists: pa.ListArray, row: int, width: int) -> dict:
    part = lists.slice(row, 1).flatten()
    out = {c: np.asarray(part.field(c), np.int64) for c in ("key", "id", "label")}
    out["v"] = _matrix(part.field("v"), width) if width else np.zeros((len(part), 0), np.int64)
    windows = len(part.field("low").flatten()) // len(part)
    return out | {"low": _matrix(part.field("low"), windows), "high": _matrix(part.field("high"), windows)}


def _choose(same: bool, first: bool):
    """(anchor, block) pairs to read: those whose bounds meet a window, or only the most promising of each window."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, asks, zones = batch.column("dim")[r].as_py(), batch.column("asks"), batch.column("zones").slice(r, 1).flatten()
                ask = _asks(asks, r, width)
                block, *ends = (np.asarray(zones.field(c), np.int64) for c in ("block", "label_low", "label_high"))
                low, high = (_matrix(zones.field(c), width) if width else np.zeros((len(block), 0), np.int64) for c in ("low", "high"))
                least, most = bounds(ask["v"], low, high)
                label = ask["label"][:, None]
                fits = (ends[0] <= label) & (label <= ends[1]) if same else (ends[0] != label) | (ends[1] != label)
                meets = fits[:, None] & (most[:, None] >= ask["low"][:, :, None]) & (least[:, None] <= ask["high"][:, :, None])
                if first:
                    # the middle nearest to the top of the window; the greatest bound where the window has no top
                    top = ask["high"][:, :, None].astype(float)
                    gain = np.where(top >= _HIGH, most[:, None], -np.abs((least + most)[:, None] / 2 - top))
                    gain = np.where(meets, gain, -np.inf)
                    order = np.argsort(-gain, axis=2, kind="stable")[:, :, :TRIED]
                    row, window, nth = np.nonzero(np.take_along_axis(meets, order, 2))
                    col = order[row, window, nth]
                    gain = gain[row, window, col]
                else:
                    row, col = np.nonzero(meets.any(1))
                    window, gain = np.zeros(len(row), np.int64), np.zeros(len(row))
                of = asks.slice(r, 1).flatten().take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(block[col]), pa.array(ask["key"][row]), pa.array(window.astype(np.int32)), pa.array(gain), of],
                                                 names=["block", "key", "window", "gain", "ask"])
    return run


_FOUND = pa.schema([("key", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _read(same: bool, k: int):
    """The best rows of a task's blocks in each window of the anchors that need them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("dim")[r].as_py()
                ids, labels, data = (np.asarray(batch.column(c).slice(r, 1).flatten(), np.int64) for c in ("ids", "labels", "data"))
                ask = _asks(batch.column("asks"), r, width)
                match = labels == ask["label"][:, None]
                allowed = match & (ids != ask["id"][:, None]) if same else ~match
                row, window, col, score = best_in_windows(scores(ask["v"], data.reshape(len(ids), width)), allowed, ask["low"], ask["high"], k)
                held.append((ask["key"][row], window.astype(np.int32), ids[col], score))
                if sum(len(h[0]) for h in held) > GATHERED:
                    held = [best_of(held, k)]
                    if len(held[0][0]) > GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], schema=_FOUND)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best_of(held, k)], schema=_FOUND)
    return run


def best_of(found: list[tuple], k: int) -> tuple:
    """The ``k`` best of each key and window among rows of several blocks."""
    key, window, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, _descending(score), window, key))
    key, window, ids, score = (c[order] for c in (key, window, ids, score))
    first = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(window) != 0)]) if len(key) else np.zeros(0, int)
    keep = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)])) < k
    return key[keep], window[keep], ids[keep], score[keep]


class Blocks:
    """Stored blocks, and the search of windows of scores in them."""

    def __init__(self, rows: DataFrame, block_rows: int = ROWS):
        self.table = write_blocks(rows, block_rows)
        chunks = max(1, -(-self.table.count() // MEET))
        zone = F.struct("block", "label_low", "label_high", "low", "high")
        self.chunks = chunks
        self.zones = (self.table.groupBy("dim", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"))
                      .agg(F.collect_list(zone).alias("zones")))

    def needs(self, asks: DataFrame, packs: int, same: bool, first: bool) -> DataFrame:
        """``block, key, window, gain, ask``: which anchors must read which blocks."""
        ask = F.struct("key", "id", "label", "v", "low", "high")
        packed = (asks.groupBy("dim", F.pmod(F.xxhash64("key"), F.lit(packs)).cast("int").alias("pack")).agg(F.collect_list(ask).alias("asks"))
                  .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1)))))
        pairs = (packed.join(self.zones, ["dim", "chunk"]).select("dim", "asks", "zones")
                 .mapInArrow(_choose(same, first), _NEED))
        if first:
            order = Window.partitionBy("key", "window").orderBy(F.desc("gain"), "block")
            pairs = pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= TRIED).dropDuplicates(["block", "key"])
        return pairs.select("block", "key", "ask")

    def found(self, asks: DataFrame, packs: int, same: bool, k: int, first: bool) -> DataFrame:
        """``key, window, id, score, rank``: the ``k`` best rows of each window, from the blocks read."""
        packed = (self.needs(asks, packs, same, first)
                  .groupBy("block", F.pmod(F.xxhash64("key"), F.lit(packs)).cast("int").alias("pack")).agg(F.collect_list("ask").alias("asks")))
        rows = (packed.select("block", "asks").join(self.table.select("block", "dim", "ids", "labels", "data"), "block")
                .mapInArrow(_read(same, k), "key long, window int, id long, score long"))
        order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def search(self, asks: DataFrame, packs: int, same: bool, k: int) -> DataFrame:
        """As ``found``, exactly: what the most promising blocks hold raises the lower ends of the windows first."""
        tried = self.found(asks, packs, same, k, True).filter(F.col("rank") == k)
        raised = tried.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        narrowed = asks.join(raised, "key", "left").withColumn(
            "low", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i), x)))).drop("kth")
        return stored(self.found(stored(narrowed, "asks"), packs, same, k, False), "found")


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``id, label, dim, v``: rows with an id, a label and a vector of finite components, each floor(256 x)."""
    v = F.col(vector_col)
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return (vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.size(v).alias("dim"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the column ``id``; ``label`` an integer column expression over ``vectors``
    (default: the column ``label``). An anchor's positives are the ``positives`` best other
    rows of its label by integer inner product; for each, the ``negatives`` best rows of other labels whose
    score is between ``low`` and ``high`` percent of the positive's. Ties go to the smaller id. A positive
    score below zero leaves no window. All are returned where there are fewer.

    Rows without id or label, null vectors and those that hold a null or a component that isn't finite take no part. Vectors
    meet only vectors of the same length. A row that has the anchor's own id isn't "other".
    A repeated row counts each time, as positive and as negative; equal anchors (id, label and
    vector) are one. Scores must fit a 64-bit integer. An empty table gives no rows. Other columns are ignored.

    Anchors meet zones in chunks of ``MEET`` by ``MEET``, and a block goes with ``MEET`` of the anchors that need it, on
    average, to one call; a block has at most ``block_rows`` vectors.
    """
    rows = stored(usable(vectors, id_col, F.col("label") if label is None else label, vector_col), "vectors")
    blocks = Blocks(rows, block_rows)
    anchors = stored(rows.filter(is_anchor).dropDuplicates(["id", "label", "v"]).withColumn("key", F.monotonically_increasing_id()), "anchors")
    packs = max(1, -(-anchors.count() // MEET))
    everything = anchors.withColumn("low", F.array(F.lit(_LOW))).withColumn("high", F.array(F.lit(_HIGH)))
    near = blocks.search(everything, packs, True, positives).select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    # whole numbers from low % to high % of the score, in two steps that can't overflow; scores below zero have no window
    share = "positive_score div 100 * {0} + (positive_score % 100 * {0} + {1}) div 100"
    window = F.struct("rank", F.expr(share.format(low, 99)).alias("low"), F.expr(share.format(high, 0)).alias("high"))
    windows = (near.filter(score >= 0).groupBy("key").agg(F.array_sort(F.collect_list(window)).alias("w")))
    filled = F.sequence(F.lit(1), F.lit(positives))
    asks = (anchors.join(windows, "key")
            .withColumn("low", F.transform(filled, lambda i: F.coalesce(F.get("w", i - 1)["low"], F.lit(1))))
            .withColumn("high", F.transform(filled, lambda i: F.coalesce(F.get("w", i - 1)["high"], F.lit(0)))).drop("w"))
    hard = blocks.search(stored(asks, "asks"), packs, False, negatives)
    return (hard.select("key", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(near.withColumnRenamed("rank", "place"), ["key", "place"])
            .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
