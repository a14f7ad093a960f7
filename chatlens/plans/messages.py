"""The message search and the error list.

All filters are on message columns, so the page is cut from messages alone:
phase 1 is a top-k over (timestamp, id, conversation_id) only; phase 2 reads
the page's rows, conversations and users through literal ``IN`` predicates on
their keys (at most ``limit`` values each), which reach the parquet scans.
No message is joined to its parents before sorting, and no big table is
shuffled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.predicates import (all_of, date_range, ilike_any,
                                           key_equals, null_tristate,
                                           role_equals)
from chatlens.functions.timefns import ntz
from chatlens.operators.lookup import (collect_page_keys, key_in,
                                       rows_with_keys, user_columns)
from chatlens.operators.paging import (ERRORS_PAGE, MESSAGES_PAGE, PageBounds,
                                       check_page, newest_first, order_bounded,
                                       total)
from chatlens.schema import MESSAGE_COLUMNS, MESSAGE_DATE_PARTITION
from chatlens.sources.tables import ChatTables

USER_VIEW_COLUMNS = ["display_name", "email", "ms_user_id"]
KEY_COLUMNS = ["id", "timestamp", "conversation_id"]


def _filtered(tables: ChatTables, conversation_id, role, has_error, search,
              date_from, date_to) -> DataFrame:
    """The messages that pass; for a text, from the files that can hold it where the tables carry an index."""
    found = tables.text_index.candidates(search) if search and tables.text_index is not None else None
    return (tables.messages if found is None else found).filter(all_of(
        key_equals("conversation_id", conversation_id),
        role_equals("role", role),
        date_range("timestamp", date_from, date_to,
                   date_partition=tables.messages_date_partitioned),
        ilike_any(["content"], search),
        null_tristate("error", has_error)))


def _page_rows(tables: ChatTables, keys: list) -> DataFrame:
    """The page's rows by id, with the page's time span (and days) added as
    redundant bounds so row-group statistics and folders prune the scan."""
    pred = key_in("id", [k.id for k in keys])
    times = [k.timestamp for k in keys if k.timestamp is not None]
    if times and len(times) == len(keys):
        pred = pred & F.col("timestamp").between(ntz(min(times)), ntz(max(times)))
    if tables.messages_date_partitioned:
        days = {k.timestamp.date() for k in keys if k.timestamp is not None}
        part = key_in(MESSAGE_DATE_PARTITION, days)
        if any(k.timestamp is None for k in keys):
            part = part | F.col(MESSAGE_DATE_PARTITION).isNull()
        pred = pred & part
    return tables.messages.filter(pred).select(*MESSAGE_COLUMNS)


def _with_users(tables: ChatTables, pg: DataFrame, keys: list) -> DataFrame:
    """Attach user columns to a page through its conversation keys."""
    convs = (tables.conversations.filter(key_in("id", [k.conversation_id for k in keys]))
             .select(F.col("id").alias("_cid"), F.col("user_id").alias("_cuid")))
    users = user_columns(rows_with_keys(tables.users, "id", convs, "_cuid"))
    out = (pg.join(F.broadcast(convs), pg["conversation_id"] == convs["_cid"], "left")
           .join(F.broadcast(users), F.col("_cuid") == users["_uid"], "left"))
    return out.select(*[pg[c] for c in MESSAGE_COLUMNS], *USER_VIEW_COLUMNS)


def _newest_keys(tables: ChatTables, filtered: DataFrame, order: list, n: int, offset: int,
                 errors_only: bool, date_to: dt.date | None) -> list:
    """Phase 1 from the newest day down, where the day counts are known.

    The scan is bounded at the day by which that many messages (or errors)
    have been counted. When the other filters leave the page short, the bound
    goes back to eight times as many, and in the end falls away. Days without
    a time come first in the order and are always read, so every page is
    exact, whatever the counts say.
    """
    if tables.message_days is None or not tables.messages_date_partitioned:
        return collect_page_keys(filtered, order, n, offset, KEY_COLUMNS)
    day = F.col(MESSAGE_DATE_PARTITION)
    known = tables.message_days.filter(day.isNotNull())
    if date_to is not None:
        known = known.filter(day <= F.lit(date_to))
    # one row for each calendar day
    days = known.select(MESSAGE_DATE_PARTITION, "errors" if errors_only else "messages") \
        .orderBy(day.desc()).collect()
    wanted = offset + n
    while True:
        seen = 0
        for first, count in days:
            seen += count
            if seen >= wanted:
                break
        else:
            return collect_page_keys(filtered, order, n, offset, KEY_COLUMNS)
        recent = filtered.filter(day.isNull() | (day >= F.lit(first)))
        keys = collect_page_keys(recent, order, n, offset, KEY_COLUMNS)
        if len(keys) == n:
            return keys
        wanted = 8 * seen


def messages_list(tables: ChatTables, conversation_id: int | None = None,
                  role: str | None = None, has_error: bool | None = None,
                  search: str | None = None, date_from: dt.date | None = None,
                  date_to: dt.date | None = None, limit: int | None = None,
                  offset: int = 0, bounds: PageBounds = MESSAGES_PAGE) -> DataFrame:
    """R9 page, newest first (NULL timestamps first), with user columns.

    Runs phase 1 (small jobs, newest days first) when called; the returned DataFrame reads
    only the page's rows.
    """
    n = check_page(limit, offset, bounds)
    order = newest_first("timestamp")
    plain = conversation_id is None and not role and has_error is None and not search and date_from is None and date_to is None
    ranked = (tables.orders or {}).get("messages_order") if plain else None
    if ranked is not None:  # the slice of the stored order that holds the page
        keys = ranked.page(n, offset)
        return order_bounded(_with_users(tables, _page_rows(tables, keys), keys), order, n)
    filtered = _filtered(tables, conversation_id, role, has_error, search, date_from, date_to)
    if conversation_id is not None:  # the conversation's own row groups bound the scan
        keys = collect_page_keys(filtered, order, n, offset, KEY_COLUMNS)
    else:
        keys = _newest_keys(tables, filtered, order, n, offset, has_error is True, date_to)
    return order_bounded(_with_users(tables, _page_rows(tables, keys), keys), order, n)


def messages_total(tables: ChatTables, conversation_id: int | None = None,
                   role: str | None = None, has_error: bool | None = None,
                   search: str | None = None, date_from: dt.date | None = None,
                   date_to: dt.date | None = None) -> DataFrame:
    """R9 total: the same filters, messages only."""
    return total(_filtered(tables, conversation_id, role, has_error, search,
                           date_from, date_to))


def errors_list(tables: ChatTables, date_from: dt.date | None = None,
                date_to: dt.date | None = None, search: str | None = None,
                limit: int | None = None, offset: int = 0) -> DataFrame:
    """Messages whose error is not NULL (limits 1..200, default 50)."""
    return messages_list(tables, has_error=True, search=search, date_from=date_from,
                         date_to=date_to, limit=limit, offset=offset,
                         bounds=ERRORS_PAGE)


def errors_total(tables: ChatTables, date_from: dt.date | None = None,
                 date_to: dt.date | None = None, search: str | None = None) -> DataFrame:
    return messages_total(tables, has_error=True, search=search,
                          date_from=date_from, date_to=date_to)
