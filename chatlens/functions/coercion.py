"""How raw aggregates become the integers the reports hand out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(col: Column | str, default: int = 0) -> Column:
    """NULL -> ``default``; numbers -> round half to even -> bigint.

    NaN and strings that are not numbers also give ``default`` (``try_cast``), as a
    failed conversion does in the reference's helper.
    """
    c = F.col(col) if isinstance(col, str) else col
    rounded = F.bround(c.try_cast("double"), 0).try_cast("long")
    return F.coalesce(rounded, F.lit(default).cast("long"))


def zero_if_null(col: Column | str) -> Column:
    """P5: missing rollup -> 0 (never used on timestamps)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(0))


def rounded_mean(col: Column) -> Column:
    """``ROUND(AVG(x))`` — half away from zero, as bigint."""
    return F.round(F.avg(col), 0).cast("long")
