"""Joins of a bounded page back to the big tables.

A page has at most ``limit`` rows (checked by ``check_page``), so its keys are
a proven-small set. Pages are cut in two phases: a top-k over the narrow key
and sort columns only (each task ships ``offset + limit`` small tuples to the
final merge, not whole rows with their text), whose at most ``limit`` keys
come back to the driver; then those keys become literal ``IN`` predicates
that reach the parquet scans (row-group statistics, day folders) of the big
tables to fetch the page's own rows and its parents' rows. Key sets that are
not bounded by a page are joined as distinct keys (``semi_join_keys``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def collect_page_keys(df: DataFrame, order: list, limit: int, offset: int,
                      columns: list[str]) -> list:
    """Phase 1: the key columns of one ordered page (at most ``limit`` rows)."""
    ordered = df.select(*columns).orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit).collect()


def key_in(col: str, values) -> Column:
    """``col IN (values)`` for a page's (or a small set's) keys; false when
    empty. Integer keys are written into one SQL expression, which builds the
    predicate in one call instead of one driver-JVM call per literal."""
    vals = sorted({v for v in values if v is not None})
    if not vals:
        return F.lit(False)
    if all(isinstance(v, int) and not isinstance(v, bool) for v in vals):
        return F.expr(f"`{col}` IN ({', '.join(str(v) for v in vals)})")
    return F.col(col).isin(vals)


def _distinct_keys(keys: DataFrame, key: str) -> DataFrame:
    return keys.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()


def semi_join_keys(big: DataFrame, big_key: str, keys: DataFrame, key: str) -> DataFrame:
    """Exactly the rows of ``big`` whose key is in ``keys``: one semi-join on
    the distinct keys at every size. No key passes through the driver; Spark
    broadcasts the keys when it knows them to be few."""
    return big.join(_distinct_keys(keys, key), F.col(big_key) == F.col("_k"), "left_semi")


def anti_join_keys(big: DataFrame, big_key: str, big_pk: str, keys: DataFrame, key: str) -> DataFrame:
    """Exactly the rows of ``big`` whose key is NOT in ``keys`` (a NULL key
    is kept), with NULL keys spread by ``big_pk`` (``joins.anti_join_nullable``)."""
    from chatlens.operators.joins import anti_join_nullable
    return anti_join_nullable(big, _distinct_keys(keys, key), big_key, big_pk, "_k")


def rows_with_keys(big: DataFrame, big_key: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``big_key`` is among ``keys[key]``.

    ``keys`` must be bounded (a page, or derived 1:1 from one).
    """
    k = keys.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    return big.join(F.broadcast(k), big[big_key] == F.col("_k"), "left_semi")


def user_columns(users: DataFrame, prefix_key: str = "_uid") -> DataFrame:
    """The three user columns the lists show, keyed by ``prefix_key``."""
    return users.select(F.col("id").alias(prefix_key), "display_name", "email", "ms_user_id")
