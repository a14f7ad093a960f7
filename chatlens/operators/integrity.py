"""The database constraints of the original schema, as checks.

A lake does not enforce keys, NOT NULL or foreign keys, so each becomes a
job. All are aggregations or anti-joins that Spark distributes: duplicate
keys shuffle once on the key (the partial count collapses repeats within a
task first). Orphan checks count children per foreign key before the
anti-join, so only distinct keys move and a hot key is one row per task.
NULL foreign keys are legal and are dropped, or spread by the row's own id,
before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.predicates import all_of
from chatlens.operators.lookup import anti_join_keys, semi_join_keys
from chatlens.operators.rollups import rollup_of
from chatlens.sources.tables import ChatTables

# The unique keys and required columns of the original schema.
UNIQUE_KEYS = (("users", "id"), ("users", "ms_user_id"),
               ("conversations", "id"), ("conversations", "thread_id"),
               ("messages", "id"))
REQUIRED_COLUMNS = (("users", ("id", "ms_user_id")),
                    ("conversations", ("id", "thread_id")),
                    ("messages", ("id", "role", "content")))


def _table(tables: ChatTables, name: str) -> DataFrame:
    return getattr(tables, name)


def duplicate_keys(tables: ChatTables) -> DataFrame:
    """D1 detail: every key value that occurs more than once."""
    parts = []
    for table, key in UNIQUE_KEYS:
        df = _table(tables, table)
        parts.append(df.filter(F.col(key).isNotNull()).groupBy(key)
                     .agg(F.count(F.lit(1)).alias("occurrences"))
                     .filter(F.col("occurrences") > 1)
                     .select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"),
                             F.col(key).cast("string").alias("key_value"), "occurrences"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_key_summary(tables: ChatTables) -> DataFrame:
    """D1 summary: per unique key, distinct values, duplicated values and the
    rows beyond the first of each duplicated value."""
    parts = []
    for table, key in UNIQUE_KEYS:
        df = _table(tables, table)
        per_key = (df.filter(F.col(key).isNotNull()).groupBy(key)
                   .agg(F.count(F.lit(1)).alias("n")))
        parts.append(per_key.agg(
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(F.col("n") > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_rows"))
            .select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"),
                    "distinct_keys", "duplicated_keys", "extra_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required_nulls(tables: ChatTables) -> DataFrame:
    """NULL count per required column (one scan per table)."""
    parts = []
    for table, cols in REQUIRED_COLUMNS:
        df = _table(tables, table)
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        parts.append(counts.unpivot([], list(cols), "column_name", "null_rows")
                     .select(F.lit(table).alias("table_name"), "column_name",
                             F.col("null_rows").cast("long").alias("null_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """``fk, rows`` for every non-NULL foreign key value with no parent row.

    Children are counted per key first (partial aggregation: a key holding a
    third of all rows is one row per task), so the anti-join moves distinct
    keys, not child rows."""
    per_key = (child.filter(F.col(fk).isNotNull()).groupBy(fk)
               .agg(F.count(F.lit(1)).alias("rows")))
    parents = parent.select(F.col(pk).alias("_pk"))
    return per_key.join(parents, per_key[fk] == parents["_pk"], "left_anti")


def orphan_conversations(tables: ChatTables) -> DataFrame:
    """D3: conversations whose non-NULL user_id has no users row."""
    keys = _orphan_keys(tables.conversations, "user_id", tables.users, "id")
    return semi_join_keys(tables.conversations, "user_id", keys, "user_id")


def orphan_messages(tables: ChatTables) -> DataFrame:
    """D3: messages whose non-NULL conversation_id has no conversations row."""
    keys = _orphan_keys(tables.messages, "conversation_id", tables.conversations, "id")
    return semi_join_keys(tables.messages, "conversation_id", keys, "conversation_id")


def orphan_summary(tables: ChatTables) -> DataFrame:
    """D3 summary: orphan rows per foreign key (from the per-key counts)."""
    def total(keys: DataFrame, name: str) -> DataFrame:
        return keys.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("orphan_rows")) \
            .select(F.lit(name).alias("foreign_key"), "orphan_rows")
    return total(_orphan_keys(tables.conversations, "user_id", tables.users, "id"),
                 "conversations.user_id").unionByName(
        total(_orphan_keys(tables.messages, "conversation_id", tables.conversations, "id"),
              "messages.conversation_id"))


def cascade_delete(tables: ChatTables, deleted_conversations: DataFrame) -> ChatTables:
    """Remove conversations and, with them, their messages.

    ``deleted_conversations`` needs an ``id`` column. Messages without a
    conversation stay (a NULL key matches nothing). The deleted keys go through
    one anti-join with NULL keys spread out (``lookup.anti_join_keys``).
    """
    gone = deleted_conversations.select(F.col("id").alias("_gone"))
    convs = anti_join_keys(tables.conversations, "id", "id", gone, "_gone")
    msgs = anti_join_keys(tables.messages, "conversation_id", "id", gone, "_gone")
    return ChatTables(users=tables.users, conversations=convs, messages=msgs,
                      messages_date_partitioned=tables.messages_date_partitioned)


def counter_audit(tables: ChatTables, only_mismatches: bool = True) -> DataFrame:
    """Stored message_count / last_message_at against the messages."""
    c = tables.conversations
    roll = rollup_of(tables, ("total_messages", "last_message_at"))
    out = (c.join(roll, c["id"] == roll["conversation_id"], "left").select(
        c["id"],
        c["message_count"].alias("stored_message_count"),
        F.coalesce(roll["total_messages"], F.lit(0)).cast("long").alias("counted_messages"),
        c["last_message_at"].alias("stored_last_message_at"),
        roll["last_message_at"].alias("recomputed_last_message_at")))
    out = out.withColumn("count_mismatch",
                         ~F.col("stored_message_count").eqNullSafe(F.col("counted_messages")))
    out = out.withColumn("last_message_mismatch",
                         ~F.col("stored_last_message_at")
                         .eqNullSafe(F.col("recomputed_last_message_at")))
    if only_mismatches:
        out = out.filter(all_of(F.col("count_mismatch") | F.col("last_message_mismatch")))
    return out
