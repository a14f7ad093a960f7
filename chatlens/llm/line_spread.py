"""Line dedup by distinct-site spread, in DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites that have the line;
sketches merge by aggregation. Lines estimated clearly above the threshold are boilerplate,
lines near it get an exact distinct count, and the rest are dropped at
once, so that only few lines are ever counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Sites from which a line is boilerplate; sketch size (2^10 cells, standard error 3.3 %); width of the band counted exactly.
SITES, LG_CELLS, BAND = 8, 10, 0.25
#: Hashes that count as hot, for each shuffle partition at most.
HOT = 4


def _by_hash(lines: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``found`` (by ``key``, their hash). Lines whose hash is hot meet a broadcast of the few
    hot ones where they are; only the others are shuffled."""
    few = F.broadcast(found.join(F.broadcast(hot), "key", "left_semi"))
    rest = found.join(F.broadcast(hot), "key", "left_anti")
    cold = lines.join(F.broadcast(hot), lines["hash"] == hot["key"], "left_anti")
    return (lines.join(few, lines["hash"] == few["key"]).drop("key")
            .unionByName(cold.join(rest, cold["hash"] == rest["key"]).drop("key")))


def boilerplate(lines: DataFrame, sites: int, lg_cells: int, band: float) -> DataFrame:
    """Rows of ``lines`` (``hash``, ``site``, ...) whose hash has at least ``sites`` distinct sites."""
    spread = (lines.groupBy("hash").agg(F.hll_sketch_agg("site", lg_cells).alias("sketch"), F.count(F.lit(1)).alias("n"))
              .select(F.col("hash").alias("key"), F.hll_sketch_estimate("sketch").alias("estimate"), "n")
              .filter(F.col("estimate") >= sites * (1 - band))
              .select("key", (F.col("estimate") > sites * (1 + band)).alias("sure"), "n"))
    spread = stored(spread, "spread")
    # at most as many as this: each has that share of all these lines
    most = HOT * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = spread.agg(F.sum("n")).first()[0] or 0
    hot = spread.filter(F.col("n") > F.lit(total / most)).select("key")
    rows = stored(_by_hash(lines, spread.select("key", "sure"), hot), "candidates")
    near = rows.filter("NOT sure")
    exact = (near.groupBy("hash").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
             .select(F.col("hash").alias("key")))
    return rows.filter("sure").unionByName(_by_hash(near, exact, hot)).drop("sure")


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                        sites: int = SITES, lg_cells: int = LG_CELLS, band: float = BAND) -> DataFrame:
    """``docs`` with its columns, the text without repeats of boilerplate lines, and
    ``__n_lines``, ``__n_removed`` (long).

    Lines are split at newlines and compared without spaces at either end; blank lines
    are never removed. A line that ``sites`` or more distinct sites have stays once, at
    its first place (by id, then text hash, then line number), and goes everywhere
    else. A null site counts as the empty one, as in the SQL. Null texts stay null with
    no lines; an empty text has one, blank. Equal rows are treated alike, so
    if they hold the first place, each keeps it. A document that loses all its lines stays, with
    an empty text. Other columns stay; names that begin with two underscores are reserved.

    A line that very many documents share costs one sketch a task before the shuffle, and its places aren't shuffled
    by its hash: only by their documents.
    """
    text, th = F.col(text_col), F.xxhash64(F.col(text_col))
    lines = (docs.filter(text.isNotNull())
             .select(F.col(id_col).alias("id"), th.alias("text_hash"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                     F.posexplode(F.split(text, "\n")).alias("pos", "line"))
             .filter(F.trim("line") != "")
             .select("id", "text_hash", "site", "pos", F.xxhash64(F.trim("line")).alias("hash")))
    rows = boilerplate(lines, sites, lg_cells, band)
    rows = stored(rows, "boilerplate")
    # the first places go to their documents, not to the other places of their lines
    first = rows.groupBy("hash").agg(F.min(F.struct("id", "text_hash", "pos")).alias("f")).select("f.*", F.lit(1).alias("stays"))
    places = rows.select("id", "text_hash", "pos", F.lit(0).alias("stays")).unionByName(first)
    each = (places.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
            .agg(F.collect_set("pos").alias("all"), F.collect_set(F.when(F.col("stays") == 1, F.col("pos"))).alias("kept")))
    gone = stored(each.select("__id", "__hash", F.array_except("all", "kept").alias("__gone")).filter(F.size("__gone") > 0), "gone")
    same = docs[id_col].eqNullSafe(gone["__id"]) & (th == gone["__hash"])
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone["__gone"], i))
    total = F.when(text.isNotNull(), F.size(F.split(text, "\n"))).otherwise(0).cast("long")
    lost = F.coalesce(F.size(gone["__gone"]), F.lit(0)).cast("long")
    new_text = F.when(gone["__gone"].isNull(), text).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, same, "left").select(
        *[(new_text.alias(c) if c == text_col else docs[c]) for c in docs.columns],
        total.alias("__n_lines"), F.when(gone["__gone"].isNull(), F.lit(0).cast("long")).otherwise(lost).alias("__n_removed"))
