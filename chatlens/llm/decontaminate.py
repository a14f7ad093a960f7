"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask picks some of a window's words and ignores the others, so a window still
hashes to the same value when a word at an ignored position was replaced. Every
window of the benchmark and of the documents is hashed under every mask and joined. A
hit fixes how a document and an item lie against each other; along it, the words
are compared one by one, and a stretch in which most words agree is an overlap.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Positions that count are 1. All have the same span. Every pair of positions is ignored by one of them, so that
#: wherever two words of a window were replaced, a mask still sees the rest (tests go through all pairs).
MASKS = ("01110001110", "00101110110", "01011111000", "10010011101", "10111001010", "11100010011", "11001100101")
#: Items of fewer words are found only as whole texts.
LEAST = 5
#: Words of the window in which agreement is measured, and the share of them that must agree.
WINDOW, AGREE = 13, 0.8
#: Rows of seeds that are broadcast (16 bytes of key and about as much of value each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def word_hashes(text: Column) -> Column:
    """XXH64 of each word: runs of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(n: int, agree: float) -> tuple[str, ...]:
    """Masks for items of ``n`` words: all ways to ignore as many words as may differ."""
    differ = n - math.ceil(n * agree)
    return tuple("".join("0" if k in out else "1" for k in range(n)) for out in itertools.combinations(range(n), differ))


def seeds(rows: DataFrame, masks, *keep: str) -> DataFrame:
    """``keep``, ``pos`` and ``seed`` of every window of ``words`` under every mask.

    The shifted copies of a row's words become the columns of one row a window, so that
    the hashes are compiled expressions on columns.
    """
    span = max(map(len, masks))
    n = F.size("words")
    shifted = [F.slice("words", k + 1, F.greatest(n - (span - 1), F.lit(0))).alias(f"w{k}") for k in range(span)]
    windows = rows.filter(n >= span).select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    hashes = [F.xxhash64(F.lit(m), F.lit(span), *(F.col(f"w.w{k}") for k, c in enumerate(mask) if c == "1")) for m, mask in enumerate(masks)]
    return windows.select(*keep, "pos", F.explode(F.array(*hashes)).alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, window: int = WINDOW,
             agree: float = AGREE) -> DataFrame:
    """``doc_id, text_hash, item_id, doc_start, doc_end, matched``: the overlap of
    each document and benchmark item that share one.

    Positions count words (runs of letters and digits, lower case). A pair is
    reported if a window of ``window`` words (the whole item, if it is shorter)
    around a hit agrees in at least ``agree`` of its words; the span reported
    covers all such windows, and ``matched`` counts its equal words. Of several
    alignments, the one with the most equal words is reported, then the first in
    the document. Clean documents have no row.

    No overlap is missed: whichever words differ, a mask ignores them. Items with fewer words than a mask
    has positions have masks of their own length, which cost as many hashes a word for each
    such length that the benchmark has. Items of fewer than ``LEAST`` words are too short to tell a leak from a phrase:
    they are found where they are a whole text. Null texts and texts without words overlap nothing. ``text_hash`` (XXH64 of
    the text) tells rows with a repeated or null id apart; equal rows give one. Other
    columns are ignored. Texts are not shuffled for the search: hits are aggregated to
    one row for each alignment before they move.
    """
    items = (benchmark.filter(F.col(item_text_col).isNotNull())
             .select(F.col(item_col).cast("long").alias("item_id"), word_hashes(F.col(item_text_col)).alias("item")).distinct())
    items = stored(items, "items")
    span = max(map(len, masks))
    # at most as many lengths as a mask has positions
    short = sorted(r["n"] for r in items.select(F.size("item").alias("n")).filter(F.col("n").between(1, span - 1)).distinct().collect())
    sets = [masks] + [masks_of(n, agree) for n in short if n >= LEAST]

    def all_seeds(rows: DataFrame, of_items: bool, *keep: str) -> DataFrame:
        """Seeds under the common masks, and under those of short items' lengths: of items of that length alone, and of all documents."""
        parts = []
        for own in sets:
            n = len(own[0])
            parts.append(seeds(rows.filter((F.size("words") == n) if of_items and own is not masks else F.lit(True)), own, *keep))
        if any(n < LEAST for n in short):  # a whole text is a seed
            few = rows.filter(F.size("words").between(1, LEAST - 1))
            parts.append(few.select(*keep, F.lit(0).alias("pos"), F.xxhash64(F.lit(-1), "words").alias("seed")))
        return reduce(DataFrame.unionByName, parts)

    known = stored(all_seeds(items.withColumnRenamed("item", "words"), True, "item_id").withColumnRenamed("pos", "item_pos"), "seeds")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
        word_hashes(F.col(text_col)).alias("words"))
    hits = (all_seeds(rows, False, "doc_id", "text_hash").join(known, "seed")
            .groupBy("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count("*").alias("hits")))
    hits = stored(hits, "hits")
    # verify: null ids meet themselves, and a row that repeats is compared once
    key = hits.select("doc_id", "text_hash").distinct().select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    hit_rows = rows.join(key, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    pairs = (hits.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
             .join(hit_rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
             .join(items.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))))
    n, width = F.size("item"), F.least(F.size("item"), F.lit(window))
    same = F.transform(F.col("item"), lambda w, i: F.when(F.col("shift") + i < 0, 0).otherwise(
        F.coalesce((F.get(F.col("words"), F.greatest(F.col("shift") + i, F.lit(0))) == w).cast("int"), F.lit(0))))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    good = F.filter(F.sequence(F.lit(0), n - F.col("width")),
                    lambda s: total(F.slice(F.col("same"), s + 1, F.col("width"))) >= F.ceil(F.col("width") * agree))
    pairs = pairs.filter((n >= LEAST) | (F.size("words") == n))
    found = (pairs.withColumn("width", width).withColumn("same", same).withColumn("good", good)
             .filter(F.size("good") > 0)
             .withColumn("begin", F.array_min("good")).withColumn("stop", F.array_max("good") + F.col("width"))
             .withColumn("matched", total(F.slice(F.col("same"), F.col("begin") + 1, F.col("stop") - F.col("begin")))))
    start, stop = F.col("shift") + F.col("begin"), F.col("shift") + F.col("stop")
    best = F.max(F.struct("matched", (-start).alias("minus_start"), stop.alias("doc_end"))).alias("best")
    return (found.groupBy("doc_id", "text_hash", "item_id").agg(best)
            .select("doc_id", "text_hash", "item_id", (-F.col("best.minus_start")).cast("long").alias("doc_start"),
                    F.col("best.doc_end").cast("long").alias("doc_end"), F.col("best.matched").cast("long").alias("matched")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Rows of ``docs`` that overlap no benchmark item; columns as they were. Rows with a null text stay."""
    bad = stored(overlaps(docs, benchmark, id_col, text_col, **params).select(
        F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct(), "leaks")
    same = docs[id_col].eqNullSafe(bad["__leak_id"]) & (F.xxhash64(docs[text_col]) == bad["__leak_hash"])
    return docs.join(bad, same, "left_anti")
