"""The user directory, one user's rollup and their conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.coercion import zero_if_null
from chatlens.functions.predicates import all_of, ilike_any, key_equals
from chatlens.operators.lookup import (collect_page_keys, key_in,
                                       semi_join_keys)
from chatlens.operators.paging import (USER_CONVERSATIONS_PAGE, USERS_PAGE,
                                       check_page, newest_first, order_bounded,
                                       total)
from chatlens.operators.rollups import join_user_rollup, rollup_of, with_user_rollup
from chatlens.schema import CONVERSATION_COLUMNS, USER_COLUMNS
from chatlens.sources.tables import ChatTables

SEARCH_COLUMNS = ["display_name", "email", "ms_user_id"]
ROLLUP_COLUMNS = ["conversation_count", "message_count", "error_count"]


def _searched_users(tables: ChatTables, search: str | None) -> DataFrame:
    return tables.users.filter(all_of(ilike_any(SEARCH_COLUMNS, search)))


def users_list(tables: ChatTables, search: str | None = None,
               limit: int | None = None, offset: int = 0) -> DataFrame:
    """R5 page: users.* + conversation/message/error counts, newest active first.

    The page's user ids are found first (the order only needs
    ``last_active``); users, their conversations and messages are then read
    through those ids, and the rollup is computed for the page's users only.
    """
    n = check_page(limit, offset, USERS_PAGE)
    order = newest_first("last_active")
    ranked = None if search else (tables.orders or {}).get("users_order")
    if ranked is not None:  # the slice of the stored order that holds the page
        keys = ranked.page(n, offset)
    else:
        keys = collect_page_keys(_searched_users(tables, search), order, n, offset,
                                 ["id", "last_active"])
    ids = [k.id for k in keys]
    pg = tables.users.filter(key_in("id", ids))
    if tables.user_states is not None:
        return order_bounded(join_user_rollup(pg, F.broadcast(tables.user_states.of(ids))), order, n)
    convs = tables.conversations.filter(key_in("user_id", ids))
    return order_bounded(_with_rollup(tables, pg, convs), order, n)


def _with_rollup(tables: ChatTables, users: DataFrame, convs: DataFrame) -> DataFrame:
    """A9 for a page of ``users`` owning ``convs``: from the shared rollup when the
    tables carry one, else from their conversations' messages only (the
    messages are cut by a semi-join on their keys)."""
    if tables.conversation_rollup is not None:
        shared = semi_join_keys(rollup_of(tables, ("total_messages", "error_count")),
                                  "conversation_id", convs, "id")
        return with_user_rollup(users, convs, tables.messages, per_conversation=shared, page=True)
    msgs = semi_join_keys(tables.messages, "conversation_id", convs, "id")
    return with_user_rollup(users, convs, msgs, page=True)


def users_total(tables: ChatTables, search: str | None = None) -> DataFrame:
    """R5 total: users matching the search (no join needed)."""
    return total(_searched_users(tables, search))


def user_detail(tables: ChatTables, user_id: int | None = None) -> DataFrame:
    """Users.* + rollup for one user (empty = not found), or for all."""
    users = tables.users.filter(all_of(key_equals("id", user_id)))
    convs = tables.conversations.filter(all_of(key_equals("user_id", user_id)))
    if user_id is not None and tables.user_states is not None:
        rolled = join_user_rollup(users, F.broadcast(tables.user_states.of([user_id])))
    elif user_id is not None:
        rolled = _with_rollup(tables, users, convs)
    elif tables.conversation_rollup is not None:
        rolled = with_user_rollup(users, convs, tables.messages, per_conversation=rollup_of(
            tables, ("total_messages", "error_count")))
    else:
        rolled = with_user_rollup(users, convs, tables.messages)
    return rolled.select(
        *USER_COLUMNS, *ROLLUP_COLUMNS)


def user_conversations(tables: ChatTables, user_id: int | None = None,
                       limit: int | None = None, offset: int = 0,
                       paged: bool = True) -> DataFrame:
    """A user's conversations (all users when ``user_id`` is None) with
    error count and mean assistant latency, newest first.

    Paged (the default), the page's conversation ids are found first and
    conversations and messages are read through them (literal ``IN``).
    ``paged=False`` returns every row, unordered.
    """
    convs = tables.conversations.filter(all_of(key_equals("user_id", user_id)))
    cols = ("error_count", "avg_assistant_response_time_ms")
    if paged:
        n = check_page(limit, offset, USER_CONVERSATIONS_PAGE)
        order = newest_first("last_message_at")
        ranked = (tables.orders or {}).get("conversations_order" if user_id is None else "user_conversations_order")
        if ranked is not None:
            ids = [k.id for k in ranked.page(n, offset, prefix=user_id)]
        else:
            ids = [k.id for k in collect_page_keys(convs, order, n, offset,
                                                   ["id", "last_message_at"])]
        convs = tables.conversations.filter(key_in("id", ids))
    else:
        order = None
        ids = None
    roll = rollup_of(tables, cols, conversation_ids=ids)
    out = (convs.join(roll, convs["id"] == roll["conversation_id"], "left")
           .select(*[convs[c] for c in CONVERSATION_COLUMNS],
                   *[zero_if_null(roll[c]).cast("long").alias(c) for c in cols]))
    return order_bounded(out, order, n) if order else out
