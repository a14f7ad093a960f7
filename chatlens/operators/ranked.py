"""L1-L3 at any offset: a count tree over keys stored in list order.

A *run* holds the keys of some rows, range-partitioned and sorted in the order of a list (newest
first, missing times before all others, then the id) and cut into slices. Its count tree
has two levels above the rows: parts (the partitions) and slices, each with its number of
rows and its first key. A page at rank ``offset`` descends the tree: counts say between
which first keys the rank must lie, whatever the runs, so only the slices there are
read. Ties don't matter: the id is part of the key, and a third of all rows without a
time fill as many slices as they need.

Several runs (appended loads) and rows that are in no run yet are merged in the descent: in a run that
holds a first key of another one somewhere inside a slice, that slice counts as not known.
"""

from __future__ import annotations

import bisect
import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slice, and slices of a part at most (parts are ranges from a sample, so they differ).
SLICE_ROWS, PART_SLICES = 16_384, 64
_PART = 32   # bits of a slice's number within its part
_EPOCH = dt.datetime(1970, 1, 1)
_FIRST = ()  # before every key


def _order(sort: str, prefix: str | None) -> list[Column]:
    own = [F.col(sort).desc_nulls_first(), F.col("id").asc()]
    return own if prefix is None else [F.col(prefix).asc(), *own]


def _key(prefix, time: dt.datetime | None, id_) -> tuple:
    """A key that sorts as the list does."""
    newest = (0, 0) if time is None else (1, -((time - _EPOCH) // dt.timedelta(microseconds=1)))
    return (prefix, newest, id_)


def write_run(rows: DataFrame, sort: str, prefix: str | None, extra: tuple[str, ...], path: str,
              slice_rows: int = SLICE_ROWS) -> None:
    """Store the keys of ``rows`` in order under ``path/keys``, and the two levels of counts.

    Rows without a ``prefix`` value are in no list and are left out. Row groups and pages are small, so that
    a slice is found by their statistics."""
    keys = rows.select(*([prefix] if prefix else []), F.col(sort), "id", *extra)
    if prefix:
        keys = keys.filter(F.col(prefix).isNotNull())
    parts = max(1, -(-keys.count() // (slice_rows * PART_SLICES)))
    placed = keys.repartitionByRange(parts, *_order(sort, prefix)).sortWithinPartitions(*_order(sort, prefix))
    at = F.monotonically_increasing_id()  # partition number, and place within the sorted partition
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    number = F.shiftleft(F.shiftright(at, 33), _PART) + F.floor(place / F.lit(slice_rows))
    (placed.select("*", number.alias("slice"), place.alias("place"))
     .write.option("parquet.block.size", 1 << 20).option("parquet.page.row.count.limit", slice_rows).parquet(f"{path}/keys"))
    spark = rows.sparkSession
    first = F.struct(*([F.col(prefix)] if prefix else [F.lit(None).cast("long").alias("prefix")]), F.col(sort), F.col("id"))
    slices = (spark.read.parquet(f"{path}/keys").groupBy("slice")
              .agg(F.count(F.lit(1)).alias("n"), F.min_by(first, "place").alias("first")))
    slices.select("slice", "n", "first.*").toDF("slice", "n", "prefix", "time", "id").sort("slice").write.parquet(f"{path}/slices")
    stored = spark.read.parquet(f"{path}/slices")
    (stored.groupBy(F.shiftright("slice", _PART).alias("part"))
     .agg(F.sum("n").alias("n"), F.min_by(F.struct("prefix", "time", "id"), "slice").alias("first"))
     .select("part", "n", "first.*").coalesce(1).write.parquet(f"{path}/parts"))


@dataclass
class _Level:
    """One run's nodes of one level, in order: numbers, first keys, and the rows before each."""

    numbers: list
    keys: list
    before: list  # one longer than the others

    def at(self, key: tuple) -> tuple[int, int]:
        """Least and greatest number of rows before ``key``."""
        i = bisect.bisect_right(self.keys, key) - 1
        if i < 0:
            return self.before[0], self.before[0]
        return self.before[i], self.before[i] if self.keys[i] == key else self.before[i + 1]

    def span(self, start: tuple, end: tuple | None) -> tuple[int, int]:
        """The nodes that hold rows from ``start`` to ``end``."""
        low = max(0, bisect.bisect_right(self.keys, start) - 1)
        high = len(self.keys) if end is None else bisect.bisect_left(self.keys, end)
        return low, max(low, high)


def _level(nodes: list[tuple], before: int = 0) -> _Level:
    nodes = sorted(nodes)
    sums = [before]
    for _, n, _ in nodes:
        sums.append(sums[-1] + n)
    return _Level([x[0] for x in nodes], [x[2] for x in nodes], sums)


def narrowed(levels: list[_Level], low: int, high: int, start: tuple = _FIRST, end: tuple | None = None) -> tuple[tuple, tuple | None]:
    """The narrowest first keys between which ranks ``low`` (inclusive) to ``high`` (exclusive) lie."""
    keys = sorted({k for level in levels for k in level.keys if k > start and (end is None or k < end)})
    total = lambda key, side: sum(level.at(key)[side] for level in levels)
    # both totals rise with the key: the last key that has at most `low` rows before it, the first that has `high` or more
    i = bisect.bisect_right(keys, low, key=lambda k: total(k, 1))
    j = bisect.bisect_left(keys, high, key=lambda k: total(k, 0))
    return keys[i - 1] if i else start, keys[j] if j < len(keys) else end


class RankedOrder:
    """Pages of a list at any rank, from its runs and the rows in no run (``live``)."""

    def __init__(self, spark: SparkSession, runs: list[str], sort: str, prefix: str | None = None, extra: tuple[str, ...] = (),
                 live: DataFrame | None = None):
        self.spark, self.runs, self.sort, self.prefix, self.extra = spark, runs, sort, prefix, extra
        self.columns = [*([prefix] if prefix else []), sort, "id", *extra]
        self.live = None if live is None else live.select(*self.columns)
        if prefix and self.live is not None:
            self.live = self.live.filter(F.col(prefix).isNotNull())

    def keys(self) -> DataFrame:
        """All keys, in no order."""
        frames = [self.spark.read.parquet(f"{r}/keys").select(*self.columns) for r in self.runs]
        frames += [] if self.live is None else [self.live]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _nodes(self, run: str, level: str, name: str, between: tuple | None = None) -> list[tuple]:
        rows = self.spark.read.parquet(f"{run}/{level}")
        if between is not None:
            rows = rows.filter(F.col(name).between(*between))
        return [(r[name], r["n"], _key(r["prefix"], r["time"], r["id"])) for r in rows.select(name, "n", "prefix", "time", "id").collect()]

    def _descend(self, low: int, high: int, tops: list[_Level], live: _Level | None):
        """(slices of each run, rows of all runs before those slices)."""
        beside = [] if live is None else [live]
        start, end = narrowed([*tops, *beside], low, high)
        slices = []
        for run, top in zip(self.runs, tops):
            i, j = top.span(start, end)
            between = (top.numbers[i] << _PART, ((top.numbers[j - 1] + 1) << _PART) - 1) if i < j else (0, -1)
            slices.append(_level(self._nodes(run, "slices", "slice", between) if i < j else [], top.before[i]))
        start, end = narrowed([*slices, *beside], low, high, start, end)
        spans, before = [], 0
        for level in slices:
            i, j = level.span(start, end)
            before += level.before[i]
            spans.append((level.numbers[i], level.numbers[j - 1]) if i < j else None)
        return spans, before

    def _rows(self, spans: list) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{run}/keys").filter(F.col("slice").between(*span)).select(*self.columns)
                for run, span in zip(self.runs, spans) if span is not None]

    def _before(self, prefix, tops: list[_Level], live: _Level | None) -> int:
        """How many rows have a smaller prefix: the slices in question are read, in every run."""
        key, count = (prefix,), 0
        for run, top in zip(self.runs, tops):
            if not top.keys:
                continue
            i = max(0, bisect.bisect_right(top.keys, key) - 1)
            level = _level(self._nodes(run, "slices", "slice", (top.numbers[i] << _PART, ((top.numbers[i] + 1) << _PART) - 1)), top.before[i])
            s = max(0, bisect.bisect_right(level.keys, key) - 1)
            inside = self.spark.read.parquet(f"{run}/keys").filter((F.col("slice") == level.numbers[s]) & (F.col(self.prefix) < F.lit(prefix)))
            count += level.before[s] + inside.count()
        return count + (0 if live is None else self.live.filter(F.col(self.prefix) < F.lit(prefix)).count())

    def page(self, limit: int, offset: int, prefix=None) -> list:
        """The keys (``columns``) of ranks ``offset`` to ``offset + limit``, in order; with ``prefix``, of its own rows only.

        Reads the parts' counts, the slices' counts of a few parts, and a few slices. What a task sends
        is bounded by the slices read, whatever the offset."""
        tops = [_level(self._nodes(run, "parts", "part")) for run in self.runs]
        live = None if self.live is None else _level([(0, self.live.count(), _FIRST)])
        low = offset + (0 if prefix is None else self._before(prefix, tops, live))
        spans, before = self._descend(low, low + limit, tops, live)
        frames = self._rows(spans) + ([] if self.live is None else [self.live])
        if not frames:
            return []
        rows = reduce(DataFrame.unionByName, frames).orderBy(*_order(self.sort, self.prefix))
        if low > before:
            rows = rows.offset(low - before)
        found = rows.limit(limit).collect()
        return found if prefix is None else [r for r in found if r[self.prefix] == prefix]
