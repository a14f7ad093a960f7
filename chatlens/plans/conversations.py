"""The filtered conversation list and one conversation's detail.

Joins towards parents are left joins (both foreign keys may be NULL). Lists
join users only for the page's keys, or, for a user search, the matching
users; the detail over all conversations joins the whole users table with
NULL user ids spread out (``operators.joins``) and a hot user left to AQE's
skew-join split.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.coercion import zero_if_null
from chatlens.functions.labels import highlight, tools_text
from chatlens.functions.predicates import (all_of, count_tristate, date_range,
                                           ilike_any, in_conversation_match,
                                           key_equals, null_tristate, role_selector,
                                           truthy_error)
from chatlens.operators.joins import left_join_nullable
from chatlens.operators.lookup import (anti_join_keys, collect_page_keys, key_in,
                                       rows_with_keys, semi_join_keys, user_columns)
from chatlens.operators.paging import (CONVERSATIONS_PAGE, check_page,
                                       newest_first, oldest_first, order_bounded,
                                       total)
from chatlens.operators.rollups import DETAIL_COLUMNS, LIST_COLUMNS, rollup_of
from chatlens.schema import CONVERSATION_COLUMNS, MESSAGE_COLUMNS
from chatlens.sources.tables import ChatTables

USER_VIEW_COLUMNS = ["display_name", "email", "ms_user_id"]


def _filtered_conversations(tables: ChatTables, user_id: int | None, search: str | None,
                            date_from: dt.date | None, date_to: dt.date | None) -> DataFrame:
    """Conversations passing the conversation-level filters (c.* only).

    Users are consulted only for a search, as a semi-join against the ids of
    the matching users (the search rejects rows without a user, and no user
    column is needed before the page is cut).
    """
    c = tables.conversations.filter(all_of(
        key_equals("user_id", user_id),
        date_range("started_at", date_from, date_to)))
    if not search:
        return c
    u = (tables.users.filter(ilike_any(USER_VIEW_COLUMNS, search))
         .select(F.col("id").alias("_uid")))
    return c.join(u, c["user_id"] == u["_uid"], "left_semi")


def _by_errors(tables: ChatTables, cand: DataFrame, has_error: bool) -> DataFrame:
    """the candidates with (without) an error among their messages. One
    semi- (anti-) join on the conversations that have one, from the rollup if
    the tables carry it, or else from the messages with an error alone."""
    if tables.conversation_rollup is not None:
        failed = rollup_of(tables, ("error_count",)).filter(count_tristate(F.col("error_count"), True))
    else:
        failed = tables.messages.filter(null_tristate("error", True))
    how = semi_join_keys if has_error else partial(anti_join_keys, big_pk="id")
    return how(cand, "id", keys=failed, key="conversation_id")


def _page_rows(tables: ChatTables, keys: list) -> DataFrame:
    """Phase 2: the page's conversations with user columns and rollup."""
    ids = [k.id for k in keys]
    c = tables.conversations.filter(key_in("id", ids))
    u = user_columns(tables.users.filter(key_in("id", [k.user_id for k in keys])))
    roll = rollup_of(tables, LIST_COLUMNS, conversation_ids=ids)
    joined = (c.join(F.broadcast(u), c["user_id"] == u["_uid"], "left")
              .join(F.broadcast(roll), c["id"] == roll["conversation_id"], "left"))
    return joined.select(
        *[c[x] for x in CONVERSATION_COLUMNS], *USER_VIEW_COLUMNS,
        zero_if_null(roll["error_count"]).cast("long").alias("error_count"),
        zero_if_null(roll["avg_assistant_response_time_ms"]).cast("long")
        .alias("avg_assistant_response_time_ms"),
        roll["last_error_at"])


def conversations_list(tables: ChatTables, user_id: int | None = None,
                       search: str | None = None, date_from: dt.date | None = None,
                       date_to: dt.date | None = None, has_error: bool | None = None,
                       limit: int | None = None, offset: int = 0) -> DataFrame:
    """R7 page, newest ``last_message_at`` first (NULLs first).

    Phase 1 finds the page's (id, user_id) keys: without an error filter from
    conversations alone; with one, after a semi- or anti-join with the
    conversations that have errors. Phase 2
    reads the page's conversations, users and messages through those keys.
    """
    n = check_page(limit, offset, CONVERSATIONS_PAGE)
    order = newest_first("last_message_at")
    if search or date_from or date_to or has_error is not None:
        ranked = None
    else:  # the slice of the stored order that holds the page
        ranked = (tables.orders or {}).get("conversations_order" if user_id is None else "user_conversations_order")
    if ranked is not None:
        return order_bounded(_page_rows(tables, ranked.page(n, offset, prefix=user_id)), order, n)
    cand = _filtered_conversations(tables, user_id, search, date_from, date_to)
    if has_error is not None:
        cand = _by_errors(tables, cand, has_error)
    keys = collect_page_keys(cand, order, n, offset, ["id", "user_id", "last_message_at"])
    return order_bounded(_page_rows(tables, keys), order, n)


def conversations_total(tables: ChatTables, user_id: int | None = None,
                        search: str | None = None, date_from: dt.date | None = None,
                        date_to: dt.date | None = None,
                        has_error: bool | None = None) -> DataFrame:
    """R7 total under the same filters (users joined only for a search,
    messages read only for an error filter)."""
    c = _filtered_conversations(tables, user_id, search, date_from, date_to)
    if has_error is not None:
        c = _by_errors(tables, c, has_error)
    return total(c)


def conversation_detail(tables: ChatTables, conversation_id: int | None = None) -> DataFrame:
    """R8 header row(s): c.* with user columns and the detail rollup.

    ``last_message_at`` is the recomputed one (NULL without messages): the
    stored column is replaced, as the reference's row keeps the later key.
    """
    c = tables.conversations.filter(all_of(key_equals("id", conversation_id)))
    roll = rollup_of(tables, DETAIL_COLUMNS, conversation_ids=(
        None if conversation_id is None else [conversation_id]))
    if conversation_id is None:
        named = left_join_nullable(c, user_columns(tables.users), "user_id", "id", "_uid")
    else:  # one conversation by its key: only its user is taken from users, without a shuffle
        u = user_columns(rows_with_keys(tables.users, "id", c, "user_id"))
        named = c.join(F.broadcast(u), c["user_id"] == u["_uid"], "left")
        roll = F.broadcast(roll)  # one row
    out = named.join(roll, c["id"] == roll["conversation_id"], "left")
    counts = ["total_messages", "user_messages", "assistant_messages",
              "error_count", "avg_assistant_response_time_ms"]
    return out.select(
        *[c[x] for x in CONVERSATION_COLUMNS if x != "last_message_at"],
        *USER_VIEW_COLUMNS,
        *[zero_if_null(roll[x]).cast("long").alias(x) for x in counts],
        roll["first_message_at"], roll["last_message_at"])


def conversation_messages(tables: ChatTables, conversation_id: int | None = None,
                          query: str | None = None, role: str = "all",
                          errors_only: bool = False) -> DataFrame:
    """R8 messages: in time order for one conversation, filtered like the
    detail page (F13-F15), with the highlighted text and tool list added.

    For all conversations (``conversation_id`` None) no global sort is made.
    """
    m = tables.messages.filter(all_of(
        key_equals("conversation_id", conversation_id),
        in_conversation_match(query), role_selector(role),
        truthy_error() if errors_only else None))
    out = m.select(*MESSAGE_COLUMNS,
                   highlight("content", query).alias("highlighted"),
                   tools_text("tools_used").alias("tools_text"))
    if conversation_id is not None:
        out = out.orderBy(*oldest_first("timestamp"))
    return out


def conversation_match_counts(tables: ChatTables, conversation_id: int | None = None,
                              query: str | None = None, role: str = "all",
                              errors_only: bool = False) -> DataFrame:
    """A14 per conversation: messages matching the page filters, all
    messages, and messages whose error is non-empty."""
    m = tables.messages.filter(all_of(key_equals("conversation_id", conversation_id)))
    m = m.filter(F.col("conversation_id").isNotNull())
    match = all_of(in_conversation_match(query), role_selector(role),
                   truthy_error() if errors_only else None)
    return m.groupBy("conversation_id").agg(
        F.count_if(match).alias("matching_messages"),
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(truthy_error()).alias("error_messages"))
