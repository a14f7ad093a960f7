"""Exact duplicates by sorting content.

Sampled splitters deal the texts' bytes into ranges, an external sort places equal
texts side by side within each range, and neighbours are compared in full. A range is
cut by the head of the text and then by its digest, so that splitters stay
small and a head shared by many texts doesn't make a range larger; the comparison is of
whole texts. Of equal texts, one row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a text that its splitter carries, and bytes that a range should hold.
HEAD, RANGE_BYTES = 64, 128 << 20
#: A text with more than a range's share over this of all rows or bytes is dealt into slices.
SLICES = 4


def _slices(texts: DataFrame, ranges: int | None) -> tuple[DataFrame, int]:
    """``digest, slices`` of texts that are too common for one range, and the number of ranges.

    At most ``2 * SLICES * ranges`` rows: each holds at least that share of all rows or bytes.
    """
    sums = stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "copies")
    total = sums.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    if ranges is None:
        partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(partitions, -(-(total["bytes"] or 0) // RANGE_BYTES))
    share = F.greatest(F.col("n") / F.lit(total["n"] or 1), F.col("bytes") / F.lit(total["bytes"] or 1))
    return (sums.withColumn("slices", F.ceil(share * ranges * SLICES).cast("int"))
            .filter("n > 1 AND slices > 1").select("digest", "slices")), ranges


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 normalise=None, ranges: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs``.

    ``keep`` ("max" or "min") says which id of equal texts stays. ``normalise`` maps the
    text column to what is compared (default: the text as it is). A null
    text counts as empty, and empty texts are equal to each other. A null id is
    below every other for "max" and above it for "min", so it stays only in a group
    without ids. Of repeated rows (same id, equal texts) one is kept. Texts are
    equal byte by byte, whatever the session's collation. Other columns are ignored. An empty
    table gives no rows.

    Texts cross the network once, in ``ranges`` ranges (default: the session's shuffle
    partitions, or more if they would exceed ``RANGE_BYTES``). A text that has many
    copies is dealt into slices by id, each a range's share over ``SLICES`` at most; one
    row of each slice, compared in full again, joins them.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be max or min, not {keep!r}")
    best, order = (F.max, F.desc_nulls_last) if keep == "max" else (F.min, F.asc_nulls_last)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    text = text if normalise is None else F.coalesce(normalise(text), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("bytes"))
            .withColumn("digest", F.xxhash64("bytes")))
    sizes = rows.select("digest", F.octet_length("bytes").cast("long").alias("size"))
    common, ranges = _slices(sizes, ranges)
    dealt = (rows.join(F.broadcast(common), "digest", "left")
             .withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("slices")).cast("int")))
             .withColumn("head", F.substring("bytes", 1, HEAD))
             .select("head", "digest", "slice", "bytes", "doc_id")
             .repartitionByRange(ranges, "head", "digest", "slice"))
    # the ranges' own columns come first, so the window needs no other exchange, only the external sort
    same = Window.partitionBy("head", "digest", "slice", "bytes").orderBy(order("doc_id"))
    run = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = stored(dealt.select("doc_id", "slice", F.first("doc_id").over(run).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"),
                               (F.row_number().over(same) == 1).alias("kept"), F.sha2("bytes", 256).alias("text_sha256"), "bytes")
                  .withColumn("bytes", F.when(F.col("kept") & F.col("slice").isNotNull(), F.col("bytes"))), "equal-texts")
    # slices of one text: as many rows as there are slices
    whole = (runs.filter("bytes IS NOT NULL").groupBy("bytes")
             .agg(best("keep_id").alias("all_keep_id"), F.sum("group_size").alias("all_size"), F.first("text_sha256").alias("text_sha256"))
             .select("text_sha256", "all_keep_id", "all_size"))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    sliced = runs.filter("slice IS NOT NULL").join(F.broadcast(whole), "text_sha256")
    return (runs.filter("slice IS NULL").select(*columns)
            .unionByName(sliced.select("doc_id", F.col("all_keep_id").alias("keep_id"), F.col("all_size").alias("group_size"),
                                       (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("all_keep_id"))).alias("kept"), "text_sha256")))
