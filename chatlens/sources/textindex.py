"""F8: which blocks of stored messages can hold a text, from an inverted trigram index.

For each block (a run of rows of one file) the index has the distinct trigrams of its lower-cased
texts, and the range of its conversations. A search needs all trigrams of its literal
runs (between wildcards); only files with a block that has them all are read, and within them only the
row groups whose conversations may be in such a block. ILIKE then decides, so the index never
changes an answer. Texts without three literal characters in a row, and texts that are
too common, are searched in the whole table.

The index is kept by load like the other summaries; files in no load are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import schema as S
from chatlens.functions.patterns import contains_pattern

#: Rows of a block; beyond so many blocks a text counts as common; ranges of conversations that a search names at most.
BLOCK_ROWS, COMMON, RANGES = 20_000, 1_000, 64


def write_index(spark: SparkSession, paths: list[str], path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Index the message files ``paths`` under ``path``: ``grams`` (sorted by trigram) and ``blocks``.

    A block's key is a hash of its file and number. Blocks that share one are found together, which only reads more."""
    block = F.floor(F.col("_metadata.row_index") / F.lit(block_rows))
    rows = spark.read.schema(S.MESSAGES).parquet(*paths).select(
        F.lower("content").alias("t"), "conversation_id", F.col("_metadata.file_path").alias("file"), block.alias("block"),
        F.xxhash64("_metadata.file_path", block).alias("key"))
    # a look ahead at every place: one pass over the text, however long it is
    each = F.array_distinct(F.regexp_extract_all("t", F.lit("(?s)(?=(...))"), 1))
    grams = (rows.filter(F.length("t") >= 3).select(F.explode(each).alias("gram"), "key")
             .groupBy("gram", "key").agg(F.lit(1).alias("_")).drop("_"))
    (grams.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key")
     .write.option("parquet.block.size", 8 << 20).parquet(f"{path}/grams"))
    (rows.groupBy("key", "file", "block").agg(F.min("conversation_id").alias("low"), F.max("conversation_id").alias("high"),
                                              F.count_if(F.col("conversation_id").isNull()).alias("without"))
     .write.parquet(f"{path}/blocks"))


def literal_runs(pattern: str) -> list[str]:
    """The runs of literal characters of a LIKE pattern, its escapes undone."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            runs[-1] += pattern[at]
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
        at += 1
    return [r for r in runs if r]


def joined_ranges(ranges: list[tuple], most: int = RANGES) -> list[tuple]:
    """At most ``most`` ranges that together hold every value of ``ranges``: those that meet become one, then those
    with the smallest gaps between them."""
    out: list[tuple] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)[:most - 1]
    edges = [0, *sorted(gaps), len(out)] if out else []
    return [(out[a][0], out[b - 1][1]) for a, b in zip(edges, edges[1:])]


class TextIndex:
    """The index of one root's messages, and the files that are in no load yet."""

    def __init__(self, spark: SparkSession, root: str, loads: list[str], live: list[str], schema):
        self.spark, self.root, self.loads, self.live, self.schema = spark, root, loads, live, schema

    def trigrams(self, search: str) -> list[str]:
        """The trigrams that a matching lower-cased text must have. Lower-cased as the scan does it, before the pattern is taken apart."""
        lowered = self.spark._jvm.org.apache.spark.unsafe.types.UTF8String.fromString(contains_pattern(search)).toLowerCase().toString()
        return sorted({r[i:i + 3] for r in literal_runs(lowered) for i in range(len(r) - 2)})

    def blocks(self, grams: list[str]) -> DataFrame:
        """``file, low, high, without`` of the blocks that have all of ``grams``."""
        found = []
        for load in self.loads:
            hits = (self.spark.read.parquet(f"{load}/grams").filter(F.col("gram").isin(grams))
                    .groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)))
            found.append(self.spark.read.parquet(f"{load}/blocks").join(hits, "key").select("file", "low", "high", "without"))
        return reduce(DataFrame.unionByName, found)

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/messages").parquet(*files)

    def candidates(self, search: str) -> DataFrame | None:
        """A part of the messages that holds every match of ``search``; None: the text says too little, or is common."""
        grams = self.trigrams(search)
        if not grams or not self.loads:
            return None
        blocks = self.blocks(grams).limit(COMMON + 1).collect()
        if len(blocks) > COMMON:
            return None
        parts = [self._read(self.live)] if self.live else []
        if blocks:
            # a few ranges that may hold more than the blocks: each adds to the depth of the filter's expression
            ranges = joined_ranges([(b["low"], b["high"]) for b in blocks if b["low"] is not None])
            inside = [F.col("conversation_id").between(*r) for r in ranges]
            inside += [F.col("conversation_id").isNull()] if any(b["without"] for b in blocks) else []
            parts.append(self._read(sorted({b["file"] for b in blocks})).filter(reduce(lambda a, b: a | b, inside)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)
