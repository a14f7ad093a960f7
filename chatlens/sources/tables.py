"""Reading and storing users, conversations and messages.

Stored layout (``write_tables``): users and conversations are clustered by id; messages are partitioned by the calendar day
of ``timestamp`` (column ``msg_date``) and range-clustered by
(``conversation_id``, ``timestamp``) inside each day, so time-window reports
prune whole folders and per-conversation lookups read row groups whose
min/max statistics are narrow. Beside them lie summaries (``sources.summaries``): the
per-conversation rollup, counts of each day, latency histograms of each hour, bitmaps of active users, per-user
counts, and the keys in the order of each list. They are kept as partial states by load, and follow the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import schema as S
from chatlens.sources.summaries import UserStates, count_days, read_summaries, refresh_summaries  # noqa: F401
from chatlens.sources.textindex import TextIndex


@dataclass(frozen=True)
class ChatTables:
    """The three input DataFrames of every report.

    ``messages_date_partitioned`` says that ``messages`` carries the
    ``msg_date`` partition column; time predicates then also filter on it so
    the scan skips whole day folders.

    ``conversation_rollup`` optionally holds a precomputed per-conversation
    rollup (``operators.rollups.SHARED_COLUMNS``; e.g. written once by
    ``rollups.share_rollup`` or kept current by the streaming T3 job). Reports
    that need per-conversation figures then read it instead of aggregating
    messages again.

    ``message_days`` optionally holds one row for each ``msg_date`` (NULL for
    messages without a time): ``messages``, ``errors``, ``last_timestamp``.

    ``latency_hours`` (A8), ``active_days`` (A3), ``user_states`` (A9), ``orders`` (L1-L3) and ``text_index`` (F8) are
    the other stored summaries; reports that find one read it instead of the tables.
    """

    users: DataFrame
    conversations: DataFrame
    messages: DataFrame
    messages_date_partitioned: bool = False
    conversation_rollup: DataFrame | None = None
    message_days: DataFrame | None = None
    latency_hours: DataFrame | None = None
    active_days: DataFrame | None = None
    user_states: UserStates | None = None
    orders: dict | None = None
    text_index: TextIndex | None = None


#: Bytes of messages that a task sorts and writes, and those of a row without its texts.
TASK_BYTES, ROW_BYTES = 128 << 20, 192


def _with_partition_column(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [
        T.StructField(S.MESSAGE_DATE_PARTITION, T.DateType(), True)])


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               fmt: str = "parquet") -> DataFrame:
    """Read one table with its declared schema (no inference)."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str,
                    schema: T.StructType, *, lower_bound: int,
                    upper_bound: int, num_partitions: int,
                    properties: dict[str, str] | None = None) -> DataFrame:
    """Parallel JDBC read split on the integer primary key ``id``.

    Each of ``num_partitions`` tasks reads one id range, so no single task
    pulls the whole table. Columns are then cast to the declared schema.
    """
    df = spark.read.jdbc(url, table, column="id", lowerBound=lower_bound,
                         upperBound=upper_bound, numPartitions=num_partitions,
                         properties=properties or {})
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in schema.fields])


def _stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {"users": read_table(spark, f"{root}/users", S.USERS),
            "conversations": read_table(spark, f"{root}/conversations", S.CONVERSATIONS),
            "messages": read_table(spark, f"{root}/messages", _with_partition_column(S.MESSAGES))}


def load_tables(spark: SparkSession, root: str, summaries: bool | None = None) -> ChatTables:
    """Read the layout produced by ``write_tables`` under ``root``.

    Summaries are used where they exist, and answers follow the tables: files that no
    load covers are summarised on the spot, and summaries of files that are gone are left aside.
    ``summaries=True`` raises in both cases; ``summaries=False`` reads the tables alone.
    """
    tables = _stored(spark, root)
    found = {} if summaries is False else read_summaries(spark, root, tables, required=summaries is True)
    return ChatTables(**tables, messages_date_partitioned=True, **found)


def refresh(spark: SparkSession, root: str, compact: bool = False, slice_rows: int | None = None) -> int:
    """Bring the summaries under ``root`` up to date with the tables' files; returns the version's number.

    Reads only files that are not covered yet. ``compact`` also folds the loads into one."""
    return refresh_summaries(spark, root, _stored(spark, root), compact, slice_rows).number


def append_messages(spark: SparkSession, root: str, messages: DataFrame, rows_per_file: int = 5_000_000) -> int:
    """Add messages to a stored table, laid out as ``write_tables`` does, and their states to the summaries."""
    _write_messages(messages, root, "append", rows_per_file, None)
    return refresh(spark, root)


def _with_bloom(writer, columns: tuple[str, ...]):
    """a bloom filter for each row group and key column, of a size that fits the number of its values."""
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def write_tables(tables: ChatTables, root: str, mode: str = "overwrite",
                 rows_per_file: int = 5_000_000, num_files: int | None = None,
                 slice_rows: int | None = None) -> None:
    """Store the three tables and the summaries as parquet under ``root``.

    Messages are range-partitioned on (day, conversation_id, timestamp) into
    ``num_files`` tasks (default: one per ``rows_per_file`` rows or
    ``TASK_BYTES``, from a count) and sorted the same way within each file. Range boundaries come
    from a sample, so a hot day or a conversation holding a third of all rows
    is split across many files by time instead of landing in one task; each
    file still holds contiguous conversations, so row-group statistics on
    ``conversation_id`` and ``timestamp`` prune lookups.
    """
    for name, columns, looked_up in (("users", S.USER_COLUMNS, ("ms_user_id",)), ("conversations", S.CONVERSATION_COLUMNS, ("user_id", "thread_id"))):
        rows = getattr(tables, name).select(columns).repartitionByRange("id").sortWithinPartitions("id")
        _with_bloom(rows.write.mode(mode), looked_up).parquet(f"{root}/{name}")
    _write_messages(tables.messages, root, mode, rows_per_file, num_files)
    refresh(tables.messages.sparkSession, root, slice_rows=slice_rows)


def _write_messages(messages: DataFrame, root: str, mode: str, rows_per_file: int, num_files: int | None) -> None:
    msgs = (messages.select(S.MESSAGE_COLUMNS)
            .withColumn(S.MESSAGE_DATE_PARTITION, F.to_date("timestamp")))
    if num_files is None:
        size = F.lit(ROW_BYTES) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("content", "sql_query", "error"))
        rows, n_bytes = msgs.agg(F.count(F.lit(1)), F.sum(size)).first()
        num_files = max(1, -(-rows // rows_per_file), -(-(n_bytes or 0) // TASK_BYTES))
    order = [S.MESSAGE_DATE_PARTITION, "conversation_id", "timestamp"]
    rows = msgs.repartitionByRange(num_files, *order).sortWithinPartitions(*order)
    # within a day's range of conversations, a filter tells the days on which one has no message
    (_with_bloom(rows.write.mode(mode), ("conversation_id", "id")).partitionBy(S.MESSAGE_DATE_PARTITION)
        .parquet(f"{root}/messages"))
