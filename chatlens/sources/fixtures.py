"""Chat tables derived from the shared test data (``events`` and ``customer``).

The test folders hold no users/conversations/messages tables, so they are
derived here, the same way in Spark and in the DuckDB oracle. ``events``
rows become messages, (user, day-of-month) pairs become conversations and
customers become users; a few deterministic rules plant the edge cases the
reports must handle (messages without conversation, conversations without
user, empty-string errors, NULL and empty tool arrays, NULL tool names, long
texts, active users without a last time).
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.sources.tables import ChatTables

# Fixed report time for the test data: events span 2024-01-01 .. 2024-01-30,
# so some rows lie after it (windows have no upper bound).
FIXTURE_AS_OF = dt.datetime(2024, 1, 30, 18, 30, 0)


def _conversation_key(ts: str = "ts") -> F.Column:
    return F.col("user_id") * 100 + F.dayofmonth(ts)


def messages_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    etype = F.col("event_type")
    tools = (F.when(etype == "view", F.array(F.lit("search")))
             .when(etype == "click", F.array(F.lit("search"), F.lit("sql")))
             .when(etype == "purchase",
                   F.array(F.lit("sql"), F.lit(None).cast("string"),
                           F.lit("chart")))
             .when(etype == "signup", F.array().cast("array<string>")))
    purchase = etype == "purchase"
    return events.select(
        eid.alias("id"),
        F.when(eid % 97 == 0, F.lit(None)).otherwise(_conversation_key())
        .alias("conversation_id"),
        F.when(eid % 2 == 0, "user").otherwise("assistant").alias("role"),
        # every third text is long enough to be cut by the preview
        F.when(eid % 3 == 0, F.repeat(F.concat(etype, F.lit(" "), F.col("props"), F.lit(" ")), 9))
        .otherwise(F.concat(etype, F.lit(" "), F.col("props"))).alias("content"),
        F.col("ts").alias("timestamp"),
        F.when((eid % 2 == 1) & (eid % 10 != 1),
               F.floor(F.col("value") * 10).cast("int"))
        .alias("response_time_ms"),
        tools.alias("tools_used"),
        F.when(purchase, F.concat(F.lit("SELECT "), eid)).alias("sql_query"),
        F.when(purchase, F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        .alias("sql_results_count"),
        F.when(etype == "error",
               F.when(eid % 50 == 0, F.lit(""))
               .otherwise(F.concat(F.lit("E"), F.col("user_id"))))
        .alias("error"),
    )


def conversations_from_events(events: DataFrame) -> DataFrame:
    key = F.col("id")
    per_day = (events.groupBy(_conversation_key().alias("id"),
                              F.col("user_id"))
               .agg(F.min("ts").alias("started_at"),
                    F.max("ts").alias("last_message_at"),
                    F.count(F.lit(1)).alias("message_count")))
    return per_day.select(
        key,
        F.concat(F.lit("t-"), key).alias("thread_id"),
        F.when(key % 89 == 0, F.lit(None)).otherwise(F.col("user_id"))
        .alias("user_id"),
        "started_at", "last_message_at", "message_count")


def users_from_customers(customer: DataFrame, events: DataFrame) -> DataFrame:
    activity = (events.groupBy("user_id")
                .agg(F.min("ts").alias("first_seen"),
                     F.max("ts").alias("last_active")))
    key = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    base = customer.select(
        key.alias("id"),
        F.col("c_name").alias("ms_user_id"),
        F.when(key % 11 == 0, F.lit(None))
        .otherwise(F.concat(seg, F.lit(" "), key)).alias("display_name"),
        F.when(key % 13 == 0, F.lit(None))
        .otherwise(F.lower(F.concat(seg, F.lit("_"), key,
                                    F.lit("@example.com")))).alias("email"))
    return (base.join(activity, base["id"] == activity["user_id"], "left")
            .select("id", "ms_user_id", "display_name", "email",
                    "first_seen",
                    # some active users lack the time, and so come first in the list
                    F.when(F.col("id") % 5 != 0, F.col("last_active")).alias("last_active")))


def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as an unbounded stream of the ``events`` files."""
    # a pattern, since a stream takes a file or a folder of files only through one
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return messages_from_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def from_testdata(spark: SparkSession, sf_dir: str) -> ChatTables:
    """Derive the three chat tables from ``{sf_dir}/events|customer.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return ChatTables(
        users=users_from_customers(customer, events),
        conversations=conversations_from_events(events),
        messages=messages_from_events(events),
    )


_STORED: dict[tuple[str, str], str] = {}


def stored_testdata(spark: SparkSession, sf_dir: str) -> ChatTables:
    """The tables of ``from_testdata`` read from the stored layout, with summaries in three states: most messages
    came with the first load, some with an appended one, and some files are in no load yet.

    Written once for a session, below its shared checkpoint folder."""
    from chatlens.session import ensure_checkpoint_dir
    from chatlens.sources.tables import _write_messages, append_messages, load_tables, write_tables
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
        tables = from_testdata(spark, sf_dir)
        wave = F.col("id") % 10
        write_tables(replace(tables, messages=tables.messages.filter(wave < 6)), root, slice_rows=500)
        append_messages(spark, root, tables.messages.filter(wave.between(6, 8)))
        _write_messages(tables.messages.filter(wave == 9), root, "append", 5_000_000, None)
        _STORED[key] = root
    return load_tables(spark, _STORED[key])


def with_planted_faults(tables: ChatTables) -> ChatTables:
    """The tables with faults planted by id: required values missing, keys
    shared or repeated, foreign keys that point nowhere, messages twice."""
    def broken(df: DataFrame, **columns: F.Column) -> DataFrame:
        return df.select(*[columns.get(c, F.col(c)).alias(c) for c in df.columns])

    key = F.col("id")
    users = broken(
        tables.users, id=F.when(key % 17 != 0, key),
        ms_user_id=F.when(key % 19 == 0, None).when(key % 23 == 0, "shared").otherwise(F.col("ms_user_id")))
    conversations = broken(
        tables.conversations,
        thread_id=F.when(key % 29 == 0, None).when(key % 31 == 0, "t-shared").otherwise(F.col("thread_id")),
        user_id=F.when(key % 37 == 0, -F.col("user_id")).otherwise(F.col("user_id")))
    twice = tables.messages.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(key % 53 == 0, 2).otherwise(1))))
    messages = broken(
        twice.drop("_n"),
        conversation_id=F.when(key % 41 == 0, -F.col("conversation_id")).otherwise(F.col("conversation_id")),
        role=F.when(key % 43 != 0, F.col("role")), content=F.when(key % 47 != 0, F.col("content")))
    return ChatTables(users=users, conversations=conversations, messages=messages)


def dealt(tables: ChatTables, of: int, n: int) -> ChatTables:
    """Every n-th row of each table, whatever it holds, so that copies of a key come apart. The tables must be stored ones."""
    part = lambda df: df.filter(F.pmod(F.monotonically_increasing_id(), F.lit(n)) == of)
    return replace(tables, users=part(tables.users), conversations=part(tables.conversations), messages=part(tables.messages))


def registered_testdata(spark: SparkSession, sf_dir: str) -> dict:
    """Key registries of the tables with planted faults: two appends that were compacted, and a third one.

    Written once for a session, below its shared checkpoint folder."""
    from chatlens.operators.keys import register_batch, registries
    from chatlens.session import ensure_checkpoint_dir, materialize
    folder = ensure_checkpoint_dir(spark)
    key = (spark.sparkContext.applicationId, sf_dir, "keys")
    found = with_planted_faults(from_testdata(spark, sf_dir))
    if key in _STORED:
        return registries(spark, _STORED[key], found)
    tables = replace(found, users=materialize(found.users), conversations=materialize(found.conversations), messages=materialize(found.messages))
    root = f"{folder}/keys-{uuid.uuid4().hex}"
    kept = registries(spark, root, tables)
    for batch in range(3):
        if batch == 2:
            for registry in kept.values():
                registry.compact()
        register_batch(kept, dealt(tables, batch, 3), batch)
    _STORED[key] = root
    return kept
