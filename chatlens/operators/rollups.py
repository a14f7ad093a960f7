"""The shared per-conversation and per-user rollups.

Both aggregate the fact table *before* any join: messages are grouped by
``conversation_id`` (map-side partial aggregation collapses a hot
conversation to one row per task before the shuffle), then joined 1:1 to
conversations, then grouped again by ``user_id``. Joining the three
tables first and counting distinct conversations gives the same numbers but
shuffles every message row through two joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.coercion import rounded_mean
from chatlens.functions.predicates import assistant_latency_sample

def _err() -> Column:
    return F.col("error").isNotNull()


def _agg(name: str) -> Column:
    latency = F.when(assistant_latency_sample(), F.col("response_time_ms"))
    return {
        "error_count": F.count_if(_err()).alias("error_count"),
        "last_error_at": F.max(F.when(_err(), F.col("timestamp"))).alias("last_error_at"),
        "avg_assistant_response_time_ms":
            rounded_mean(latency).alias("avg_assistant_response_time_ms"),
        "total_messages": F.count(F.lit(1)).alias("total_messages"),
        "user_messages": F.count_if(F.col("role") == "user").alias("user_messages"),
        "assistant_messages":
            F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        "first_message_at": F.min(F.col("timestamp")).alias("first_message_at"),
        "last_message_at": F.max(F.col("timestamp")).alias("last_message_at"),
    }[name]


LIST_COLUMNS = ("error_count", "avg_assistant_response_time_ms", "last_error_at")
DETAIL_COLUMNS = ("total_messages", "user_messages", "assistant_messages",
                  "error_count", "avg_assistant_response_time_ms",
                  "first_message_at", "last_message_at")
SHARED_COLUMNS = DETAIL_COLUMNS + ("last_error_at",)


#: How the partial states of a conversation are merged.
ROLLUP_MERGE = {"total_messages": "sum", "user_messages": "sum", "assistant_messages": "sum", "error_count": "sum",
                "latency_sum": "sum", "latency_count": "sum", "first_message_at": "min", "last_message_at": "max",
                "last_error_at": "max"}


def rollup_states(messages: DataFrame) -> DataFrame:
    """A10 as partial states that can be merged: the mean is kept as sum and count."""
    latency = F.when(assistant_latency_sample(), F.col("response_time_ms"))
    return (messages.filter(F.col("conversation_id").isNotNull())
            .groupBy("conversation_id")
            .agg(*[_agg(c) for c in ("total_messages", "user_messages", "assistant_messages", "error_count")],
                 F.sum(latency.cast("long")).alias("latency_sum"), F.count(latency).alias("latency_count"),
                 *[_agg(c) for c in ("first_message_at", "last_message_at", "last_error_at")]))


def finish_rollup(states: DataFrame) -> DataFrame:
    """The states with the rounded mean latency of the kept sum and count."""
    mean = F.round(F.col("latency_sum") / F.col("latency_count"), 0).cast("long")
    return states.withColumn("avg_assistant_response_time_ms", F.when(F.col("latency_count") > 0, mean))


def conversation_rollup(messages: DataFrame,
                        columns: tuple[str, ...] = LIST_COLUMNS) -> DataFrame:
    """A10: one row per non-NULL ``conversation_id`` with the asked columns."""
    return (messages.filter(F.col("conversation_id").isNotNull())
            .groupBy("conversation_id")
            .agg(*[_agg(c) for c in columns]))


def rollup_of(tables, columns: tuple[str, ...], messages: DataFrame | None = None,
              conversation_ids: list | None = None) -> DataFrame:
    """A10 for ``columns``: read from ``tables.conversation_rollup`` when the
    tables carry one, else aggregated from ``messages`` (default: all).

    ``conversation_ids`` (a page's keys) restricts either source; a caller's
    own pre-restricted ``messages`` only matter when aggregating.
    """
    shared = tables.conversation_rollup
    if shared is not None:
        out = shared.select("conversation_id", *columns)
        if conversation_ids is not None:
            from chatlens.operators.lookup import key_in
            out = out.filter(key_in("conversation_id", conversation_ids))
        return out
    msgs = tables.messages if messages is None else messages
    if conversation_ids is not None:
        from chatlens.operators.lookup import key_in
        msgs = msgs.filter(key_in("conversation_id", conversation_ids))
    return conversation_rollup(msgs, columns)


def share_rollup(tables):
    """The tables plus their per-conversation rollup, computed once and
    written to the shared checkpoint folder, for a session that runs several
    reports over the same data."""
    from dataclasses import replace

    from chatlens.session import materialize
    roll = conversation_rollup(tables.messages, SHARED_COLUMNS)
    return replace(tables, conversation_rollup=materialize(roll, "conversation_id"))


def user_rollup(conversations: DataFrame, messages: DataFrame,
                per_conversation: DataFrame | None = None) -> DataFrame:
    """A9 per user: conversation_count, message_count, error_count.

    Every conversation of the user counts once, also those without messages
    (the fan-out's COUNT(DISTINCT c.id)); messages count when their
    conversation belongs to the user.
    """
    if per_conversation is not None:
        per_conv = per_conversation.select(
            "conversation_id", F.col("total_messages").alias("n_messages"),
            F.col("error_count").alias("n_errors"))
    else:
        per_conv = (messages.filter(F.col("conversation_id").isNotNull())
                    .groupBy("conversation_id")
                    .agg(F.count(F.lit(1)).alias("n_messages"),
                         F.count_if(_err()).alias("n_errors")))
    convs = conversations.filter(F.col("user_id").isNotNull()).select(
        F.col("id").alias("conversation_id"), "user_id")
    return (convs.join(per_conv, "conversation_id", "left")
            .groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("conversation_count"),
                 F.coalesce(F.sum("n_messages"), F.lit(0)).cast("long")
                 .alias("message_count"),
                 F.coalesce(F.sum("n_errors"), F.lit(0)).cast("long")
                 .alias("error_count")))


def with_user_rollup(users: DataFrame, conversations: DataFrame,
                     messages: DataFrame, per_conversation: DataFrame | None = None,
                     page: bool = False) -> DataFrame:
    """users.* plus A9 columns, zero for users with no conversations.
    ``page``: ``conversations`` are those of a page's users, so the rollup has
    a row for each user of the page at most and is broadcast."""
    roll = user_rollup(conversations, messages, per_conversation)
    if page:
        roll = F.broadcast(roll)
    return join_user_rollup(users, roll)


def join_user_rollup(users: DataFrame, roll: DataFrame) -> DataFrame:
    """users.* plus the counts in ``roll``, zero for users without a row there."""
    return (users.join(roll, users["id"] == roll["user_id"], "left")
            .select(users["*"],
                    *[F.coalesce(roll[c], F.lit(0)).cast("long").alias(c)
                      for c in ("conversation_count", "message_count",
                                "error_count")]))
