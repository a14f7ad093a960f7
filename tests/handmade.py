"""Tiny hand-made chat tables for the semantic traps (FIXTURES.md §3)."""

import datetime as dt

from chatlens import schema as S
from chatlens.sources.tables import ChatTables

AS_OF = dt.datetime(2024, 5, 10, 12, 30, 0)
T = dt.datetime


def make_tables(spark, messages=None, conversations=None, users=None) -> ChatTables:
    users = users if users is not None else [
        (1, "ms-1", "Alice", "alice@example.com", T(2024, 5, 1), T(2024, 5, 10, 12)),
        (2, "ms-2", None, "bob@example.com", T(2024, 5, 2), None),
        (3, "ms-3", "", None, None, T(2024, 5, 9)),
        (4, "ms-4", "Zoë 100%_sure\\x", "z@example.com", None, T(2024, 5, 8)),
    ]
    conversations = conversations if conversations is not None else [
        (10, "t-10", 1, T(2024, 5, 10, 0, 0, 0), T(2024, 5, 10, 12, 0), 5),
        (11, "t-11", 1, T(2024, 5, 10, 23, 59, 59, 999999), T(2024, 5, 10, 23, 59, 59), 1),
        (12, "t-12", None, T(2024, 5, 9, 8), T(2024, 5, 9, 9), 2),
        (13, "t-13", 2, T(2024, 5, 1), None, 0),
    ]
    messages = messages if messages is not None else default_messages()
    return ChatTables(
        users=spark.createDataFrame(users, S.USERS),
        conversations=spark.createDataFrame(conversations, S.CONVERSATIONS),
        messages=spark.createDataFrame(messages, S.MESSAGES),
    )


def default_messages():
    a = AS_OF
    h = dt.timedelta(hours=1)
    d = dt.timedelta(days=1)
    return [
        # id, conv, role, content, ts, rt, tools, sql, sqln, error
        (1, 10, "user", "Hello (world).", a - h, None, None, None, None, None),
        (2, 10, "assistant", "50% of a_b \\ c", a - h + dt.timedelta(seconds=1), 12,
         ["search", "sql"], "SELECT 1", 3, None),
        (3, 10, "assistant", "Grüße ÄÖÜ", a - 24 * h, 13, ["sql", None], None, None, ""),
        (4, 10, "user", "Fehler", a - 7 * d, None, [], None, None, "boom"),
        (5, 11, "assistant", "after as_of", a + h, 1450, ["chart"], None, None, "late"),
        (6, 11, "assistant", "midnight", T(2024, 5, 10), 100, ["chart", "search"], None, None, None),
        (7, None, "user", "orphan text", a - 2 * h, None, None, None, None, "x"),
        (8, 12, "assistant", "no time", None, 40, ["search"], None, None, None),
        (9, 99, "user", "dangling conversation", a - 3 * h, None, None, None, None, None),
    ]
