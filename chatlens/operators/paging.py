"""Ordering, bounded pages and the facts about a page.

A page is ``orderBy(...).offset(o).limit(n)``; Spark plans it as one
``TakeOrderedAndProject`` where every task keeps only its best ``o + n`` rows,
so no full sort or shuffle of the input happens. Sort keys always end with
the primary key so a page is the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PageBounds:
    default: int
    maximum: int


# Page-size limits of each list (default, maximum).
USERS_PAGE = PageBounds(50, 200)
CONVERSATIONS_PAGE = PageBounds(50, 200)
USER_CONVERSATIONS_PAGE = PageBounds(25, 200)
MESSAGES_PAGE = PageBounds(100, 500)
ERRORS_PAGE = PageBounds(50, 200)
TOOLS_PAGE = PageBounds(8, 50)


def check_page(limit: int | None, offset: int, bounds: PageBounds) -> int:
    """Validate page arguments; returns the effective limit."""
    n = bounds.default if limit is None else limit
    if not 1 <= n <= bounds.maximum:
        raise ValueError(f"limit must be within 1..{bounds.maximum}, got {n}")
    if offset < 0:
        raise ValueError(f"offset must be >= 0, got {offset}")
    return n


def newest_first(col: str, key: str = "id") -> list[Column]:
    """DESC with NULLs first (the original database's DESC), then key."""
    return [F.col(col).desc_nulls_first(), F.col(key).asc()]


def oldest_first(col: str, key: str = "id") -> list[Column]:
    """ASC with NULLs last, then key."""
    return [F.col(col).asc_nulls_last(), F.col(key).asc()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One ordered page: top-(offset+limit) per task, then the slice."""
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def order_bounded(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Order a result already cut to one page (at most a few hundred rows).

    Its rows were read by their ids; where a table repeats an id, ``limit``
    keeps the page from growing beyond its size.

    The page's rows are moved into one partition (a single-partition
    exchange of at most ``limit`` rows) and sorted there: no range-
    partitioning sample job, and, unlike ``coalesce(1)``, the scans that
    fetch the page keep their parallelism.
    """
    return df.repartition(1).sortWithinPartitions(*order).limit(limit)


def total(df: DataFrame, name: str = "total") -> DataFrame:
    """The filtered row count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def page_facts(total_df: DataFrame, limit: int, offset: int,
               total_col: str = "total") -> DataFrame:
    """Page number, page count, first/last row number, prev/next flags."""
    t = F.col(total_col)
    lim = F.lit(limit)
    off = F.lit(offset)
    return total_df.select(
        t.alias("total"), lim.alias("limit"), off.alias("offset"),
        (F.floor(off / lim) + 1).cast("long").alias("current_page"),
        F.ceil(t / lim).cast("long").alias("total_pages"),
        (off + 1).cast("long").alias("first_row"),
        F.least(off + lim, t).cast("long").alias("last_row"),
        (off > 0).alias("has_previous"),
        (off + lim < t).alias("has_next"))
