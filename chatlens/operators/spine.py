"""G1/G2 + J5: a gap-free time spine and gap filling.

The spine is generated from two literal bounds with ``sequence`` (one row,
exploded), so its size is fixed by the parameters (24 hours, 14 days), never
by the data. Gap filling unions one zero row per spine bucket with the
bucketed rows (which callers restrict to the spine's range with literal
bounds) and sums per bucket. That is the spine ⟕ counts of the original,
done as one aggregation: each task pre-aggregates to at most one row per
bucket, and there is no join or broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions.timefns import ntz


def time_spine(spark: SparkSession, first: dt.datetime, last: dt.datetime,
               step: str, name: str = "bucket") -> DataFrame:
    """Rows ``first, first+step, ..., last`` (inclusive) as NTZ ``name``."""
    return spark.range(1).select(
        F.explode(F.sequence(ntz(first), ntz(last),
                             F.expr(f"INTERVAL {step}"))).alias(name))


def gap_fill(spine: DataFrame, rows: DataFrame, key: str = "bucket",
             sums: tuple[str, ...] = ()) -> DataFrame:
    """One row per spine bucket with ``sums`` added up over ``rows``; buckets
    without rows get 0. ``rows`` must lie within the spine's range."""
    zeros = spine.select(key, *[F.lit(0).cast("long").alias(c) for c in sums])
    both = zeros.unionByName(rows.select(key, *[F.col(c).cast("long").alias(c) for c in sums]))
    out = both.groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    # at most one row per spine bucket: sort it in one partition
    return out.coalesce(1).sortWithinPartitions(key)
