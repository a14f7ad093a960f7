"""D1 on tables that grow: a stored registry of the keys that each batch brought.

A batch is kept as one row for each distinct key with the number of its rows,
bucketed by the key. An append aggregates its own rows (a hot key is one row per task before the shuffle) and meets
every earlier batch bucket by bucket: earlier keys are read, but never shuffled. The join is exact.

A batch is named by a number of the caller's, and adding it again replaces it, so a job that failed halfway is run
again. Compaction folds the batches into one that covers their numbers; it moves each key once, and the whole check
over a compacted registry moves none.

    root/buckets=B/batch=FIRST-LAST     (key, occurrences)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators.integrity import UNIQUE_KEYS
from chatlens.sources.bucketed import read_bucketed, write_bucketed
from chatlens.sources.summaries import _children


class KeyRegistry:
    """The keys of one column. NULL keys are legal and not registered.

    ``buckets`` (default: the session's shuffle partitions) counts for a registry that is new; one that exists keeps its own number."""

    def __init__(self, spark: SparkSession, root: str, key_type: str = "long", buckets: int | None = None):
        self.spark, self.root, self.key_type = spark, root.rstrip("/"), key_type
        had = [int(n.removeprefix("buckets=")) for n in _children(spark, self.root) if n.startswith("buckets=")]
        self.buckets = had[0] if had else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, span: tuple[int, int]) -> str:
        return f"{self.root}/buckets={self.buckets}/batch={span[0]}-{span[1]}"

    def batches(self) -> list[tuple[int, int]]:
        """First and last number of each batch that was written to its end and that no later compaction covers."""
        names = [n for n in _children(self.spark, f"{self.root}/buckets={self.buckets}") if n.startswith("batch=")]
        spans = [tuple(map(int, n.removeprefix("batch=").split("-"))) for n in names]
        done = [s for s in spans if "_SUCCESS" in _children(self.spark, self._path(s))]
        return sorted(s for s in done if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in done))

    def keys(self, span: tuple[int, int]) -> DataFrame:
        return read_bucketed(self.spark, self._path(span), f"key {self.key_type}, occurrences long", "key", self.buckets)

    def files(self, span: tuple[int, int]) -> DataFrame:
        """The same rows without their buckets, for unions: Spark 4.1 takes a union of bucketed scans for bucketed, leaves out the
        exchange, then reads the scans without buckets, and so sums copies of a key apart."""
        return self.spark.read.schema(f"key {self.key_type}, occurrences long").parquet(self._path(span))

    def add(self, rows: DataFrame, key: str, batch: int) -> bool:
        """Register the keys of ``rows`` as ``batch``. False, and nothing done, if a compaction already covers it."""
        if any(a <= batch <= b for a, b in self.batches() if a < b):
            return False
        counted = (rows.select(F.col(key).cast(self.key_type).alias("key")).filter(F.col("key").isNotNull())
                   .groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")))
        write_bucketed(counted, self._path((batch, batch)), "key", self.buckets)
        return True

    def earlier(self, batch: int, span: tuple[int, int]) -> DataFrame:
        """The rows of an earlier batch for keys that ``batch`` holds too: bucket meets bucket."""
        old = self.keys(span)
        return old.join(self.keys((batch, batch)).hint("merge").select("key"), "key", "left_semi")

    def repeated_by(self, batch: int) -> DataFrame:
        """``key, occurrences`` of the keys that ``batch`` holds and that occur more than once so far, in it or with earlier batches."""
        frames = [self.files((batch, batch)), *(self.earlier(batch, s) for s in self.batches() if s[1] < batch)]
        return _repeated(_summed(frames))

    def repeated(self) -> DataFrame:
        """``key, occurrences`` of every key that occurs more than once in all batches."""
        spans = self.batches()
        return _repeated(_summed([self.files(s) for s in spans])) if spans else self.spark.createDataFrame([], f"key {self.key_type}, occurrences long")

    def compact(self) -> None:
        """Fold the batches into one; their folders stay for the cluster's cleaning."""
        spans = self.batches()
        if len(spans) > 1:
            write_bucketed(_summed([self.files(s) for s in spans]), self._path((spans[0][0], spans[-1][1])), "key", self.buckets)


def _summed(frames: list[DataFrame]) -> DataFrame:
    if len(frames) == 1:
        return frames[0]
    return reduce(DataFrame.unionByName, frames).groupBy("key").agg(F.sum("occurrences").alias("occurrences"))


def _repeated(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("occurrences") > 1)


def registries(spark: SparkSession, root: str, tables, buckets: int | None = None) -> dict[tuple[str, str], KeyRegistry]:
    """A registry below ``root`` for each unique key of the schema."""
    return {(t, k): KeyRegistry(spark, f"{root}/{t}.{k}", getattr(tables, t).schema[k].dataType.simpleString(), buckets) for t, k in UNIQUE_KEYS}


def register_batch(found: dict[tuple[str, str], KeyRegistry], tables, batch: int) -> None:
    """Add the keys of the rows in ``tables`` to every registry."""
    for (table, key), registry in found.items():
        registry.add(getattr(tables, table), key, batch)


def registered_duplicates(found: dict[tuple[str, str], KeyRegistry], batch: int | None = None) -> DataFrame:
    """D1 detail over all batches, or of the keys that ``batch`` repeats; the columns of ``integrity.duplicate_keys``."""
    parts = [(r.repeated() if batch is None else r.repeated_by(batch))
             .select(F.lit(t).alias("table_name"), F.lit(k).alias("key_column"), F.col("key").cast("string").alias("key_value"), "occurrences")
             for (t, k), r in found.items()]
    return reduce(DataFrame.unionByName, parts)
