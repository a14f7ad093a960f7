"""Most used tools in the last 7 days (all roles), with rank and share.

``explode`` drops NULL and empty arrays and keeps NULL elements, which form
their own group. Counting is a partial/final aggregate on the tool name (a
hot tool collapses to one row per task before the shuffle); the top-k keeps
k rows per task. Ties are broken by tool name (NULL last) so the list is
stable.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.predicates import since
from chatlens.functions.timefns import DAY, resolve_as_of
from chatlens.operators.paging import TOOLS_PAGE, check_page
from chatlens.operators.ranking import top_k, with_rank_and_share
from chatlens.sources.tables import ChatTables

def tool_order() -> list:
    return [F.col("count").desc(), F.col("tool").asc_nulls_last()]


def tool_counts(tables: ChatTables, as_of: dt.datetime | None = None,
                days: int = 7) -> DataFrame:
    now = resolve_as_of(as_of)
    m = tables.messages
    recent = m.filter(F.col("tools_used").isNotNull()
                      & since("timestamp", now - days * DAY,
                              date_partition=tables.messages_date_partitioned))
    return (recent.select(F.explode("tools_used").alias("tool"))
            .groupBy("tool").agg(F.count(F.lit(1)).alias("count")))


def top_tools(tables: ChatTables, as_of: dt.datetime | None = None,
              limit: int | None = None) -> DataFrame:
    """``tool, count`` ordered by count desc, at most ``limit`` (1..50, 8)."""
    k = check_page(limit, 0, TOOLS_PAGE)
    return top_k(tool_counts(tables, as_of), tool_order(), k)


def top_tools_ranked(tables: ChatTables, as_of: dt.datetime | None = None,
                     limit: int | None = None) -> DataFrame:
    """R4 + W1/W2: adds ``rank`` (1-based) and ``share_pct`` of the largest."""
    return with_rank_and_share(top_tools(tables, as_of, limit), tool_order())
