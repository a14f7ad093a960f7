"""L5 + W1/W2: deterministic top-k with rank and share of the largest.

The top-k runs as ``TakeOrderedAndProject`` (each task keeps k rows); the two
window columns are then computed over at most k rows, so the single-partition
window Spark uses for an unpartitioned ``over ()`` is bounded by k, never by
the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def with_rank_and_share(topk: DataFrame, order: list[Column], count_col: str = "count",
                        rank_col: str = "rank", share_col: str = "share_pct") -> DataFrame:
    """1-based position in ``order``; W2: ``count / max(max count, 1) * 100``.

    Only for inputs already cut to k rows.
    """
    by_order = Window.orderBy(*order)
    everything = Window.partitionBy()
    largest = F.greatest(F.max(count_col).over(everything), F.lit(1))
    return (topk.withColumn(rank_col, F.row_number().over(by_order).cast("long"))
            .withColumn(share_col, (F.col(count_col) / largest) * F.lit(100.0)))
