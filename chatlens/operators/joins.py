"""Outer and anti joins on a nullable foreign key without a NULL hot spot.

A NULL foreign key never matches, yet in a shuffled join every NULL-keyed
row hashes to the same partition: if a third of the rows have no parent,
one task gets a third of the table. Joining on the pair
``(coalesce(fk, own_pk), fk IS NULL)`` against ``(pk, false)`` keeps the
result exactly the same (a NULL-keyed row still matches nothing) while those
rows spread over all partitions by their own primary key. One scan, no union.
A hot non-NULL key (one parent owning a third of the children) is left to
AQE's skew-join split, which replicates the parent's small partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(left: DataFrame, left_fk: str, left_pk: str, right: DataFrame, right_pk: str):
    lk = F.coalesce(left[left_fk], left[left_pk])
    return (lk == right[right_pk]) & (left[left_fk].isNull() == F.lit(False))


def left_join_nullable(left: DataFrame, right: DataFrame, left_fk: str, left_pk: str,
                       right_pk: str) -> DataFrame:
    """``left ⟕ right ON left.fk = right.pk`` with NULL keys spread out.

    ``left_pk`` must be non-NULL and of the key's type (the row's own id).
    """
    return left.join(right, _keys(left, left_fk, left_pk, right, right_pk), "left")


def anti_join_nullable(left: DataFrame, right: DataFrame, left_fk: str, left_pk: str,
                       right_pk: str) -> DataFrame:
    """Rows of ``left`` whose fk matches no ``right.pk`` (NULL fk kept)."""
    return left.join(right, _keys(left, left_fk, left_pk, right, right_pk), "left_anti")
