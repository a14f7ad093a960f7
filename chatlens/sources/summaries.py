"""Stored summaries that follow the tables: partial states by load, and what they cover.

A summary holds partial states (sums, counts, least and greatest values, bitmaps) that
can be merged. Each refresh aggregates only the files that no load covers yet and adds
them as one more load; readers merge the loads, and compaction folds them into one.

A *version* lists the files that are covered and the loads that cover them. It is the
last thing a refresh writes, so a refresh that fails halfway changes nothing for
readers. Readers compare the list with the files that are there: states of files
that are not covered are made from those files on the spot, and where a covered file is
gone (rows can't be taken out of a greatest value) the table's summaries are left aside.
So the answers are those of the tables, however the files came there.

    root/summaries/versions/version=N     (kind, name, value): files, loads, runs
    root/summaries/<summary>/load=N       partial states
    root/summaries/<order>/run=N          sorted keys (operators.ranked)
    root/summaries/trigrams/load=N        inverted index (sources.textindex)
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import schema as S
from chatlens.functions.predicates import assistant_latency_sample
from chatlens.operators.ranked import RankedOrder, write_run
from chatlens.operators.rollups import ROLLUP_MERGE, finish_rollup, rollup_states
from chatlens.sources.textindex import TextIndex, write_index

TABLES = ("users", "conversations", "messages")
SCHEMAS = {"users": S.USERS, "conversations": S.CONVERSATIONS, "messages": S.MESSAGES}


@dataclass(frozen=True)
class Summary:
    """Partial states of ``source`` by ``keys``; ``merge`` says how each other column is merged."""

    source: str
    keys: tuple[str, ...]
    merge: dict[str, str]
    states: object            # DataFrame of rows -> DataFrame of states
    schema: str

    def merged(self, frames: list[DataFrame]) -> DataFrame:
        if len(frames) == 1:
            return frames[0]
        how = {"sum": F.sum, "min": F.min, "max": F.max, "bitmap": F.bitmap_or_agg}
        rows = reduce(DataFrame.unionByName, frames)
        return rows.groupBy(*self.keys).agg(*[how[m](c).alias(c) for c, m in self.merge.items()])


def _day() -> Column:
    return F.to_date("timestamp").alias(S.MESSAGE_DATE_PARTITION)


def count_days(messages: DataFrame) -> DataFrame:
    """``messages, errors, last_timestamp`` of each ``msg_date``."""
    return messages.groupBy(_day()).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.max("timestamp").alias("last_timestamp"))


def latency_hours(messages: DataFrame) -> DataFrame:
    """Histogram of the assistant latencies of each hour: one row for each distinct latency."""
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")
    return (messages.filter(assistant_latency_sample() & F.col("timestamp").isNotNull())
            .groupBy(_day(), hour, "response_time_ms").agg(F.count(F.lit(1)).alias("weight")))


def active_days(conversations: DataFrame) -> DataFrame:
    """A3: bitmaps of the users whose conversations were last active on each day."""
    known = conversations.filter(F.col("user_id").isNotNull() & F.col("last_message_at").isNotNull())
    return (known.groupBy(F.to_date("last_message_at").alias("day"), F.bitmap_bucket_number("user_id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")))


SUMMARIES = {
    "conversation_rollup": Summary(
        "messages", ("conversation_id",), ROLLUP_MERGE, rollup_states,
        "conversation_id long, total_messages long, user_messages long, assistant_messages long, error_count long, "
        "latency_sum long, latency_count long, first_message_at timestamp_ntz, last_message_at timestamp_ntz, last_error_at timestamp_ntz"),
    "message_days": Summary(
        "messages", (S.MESSAGE_DATE_PARTITION,), {"messages": "sum", "errors": "sum", "last_timestamp": "max"}, count_days,
        "msg_date date, messages long, errors long, last_timestamp timestamp_ntz"),
    "latency_hours": Summary(
        "messages", (S.MESSAGE_DATE_PARTITION, "hour", "response_time_ms"), {"weight": "sum"}, latency_hours,
        "msg_date date, hour timestamp_ntz, response_time_ms int, weight long"),
    "active_days": Summary(
        "conversations", ("day", "bucket"), {"users": "bitmap"}, active_days, "day date, bucket long, users binary"),
}


@dataclass(frozen=True)
class Order:
    """Keys of ``source`` in the order of a list: newest ``sort`` first (within ``prefix``)."""

    source: str
    sort: str
    prefix: str | None = None
    extra: tuple[str, ...] = ()


ORDERS = {
    "users_order": Order("users", "last_active"),
    "conversations_order": Order("conversations", "last_message_at", extra=("user_id",)),
    "user_conversations_order": Order("conversations", "last_message_at", "user_id"),
    "messages_order": Order("messages", "timestamp", extra=("conversation_id",)),
}
#: Per-user counts, made from the conversations and the conversation rollup when either changes as a whole.
USER_ROLLUP = "user_rollup"
#: Inverted index of the messages' texts. Where only the index of an earlier layout (``text_index``) lies, a refresh makes this one.
TEXT_INDEX = "trigrams"
_USER_ROLLUP = "user_id long, conversation_count long, message_count long, error_count long"


@dataclass
class Version:
    """What one version lists: covered files by table, and loads (or runs) by name."""

    number: int = 0
    files: dict[str, set[str]] = field(default_factory=lambda: {t: set() for t in TABLES})
    loads: dict[str, list[int]] = field(default_factory=dict)

    def rows(self) -> list[tuple[str, str, str]]:
        return ([("file", t, f) for t in TABLES for f in sorted(self.files[t])]
                + [("load", n, str(k)) for n, ks in sorted(self.loads.items()) for k in ks])


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def newest_version(spark: SparkSession, root: str) -> Version | None:
    """The newest version that was written to its end."""
    base = f"{root}/summaries/versions"
    numbers = sorted((int(n.split("=")[1]) for n in _children(spark, base) if n.startswith("version=")), reverse=True)
    for number in numbers:
        if "_SUCCESS" in _children(spark, f"{base}/version={number}"):
            version = Version(number)
            for kind, name, value in spark.read.schema("kind string, name string, value string").parquet(f"{base}/version={number}").collect():
                if kind == "file":
                    version.files[name].add(value)
                else:
                    version.loads.setdefault(name, []).append(int(value))
            return version
    return None


def files_of(table: DataFrame, name: str) -> dict[str, str]:
    """The files that a stored table's DataFrame reads: path below the table's folder -> full path.

    A list of names, which Spark's own file index holds in the driver as well."""
    mark = f"/{name}/"
    return {unquote(f[f.rindex(mark) + len(mark):]): unquote(f) for f in table.inputFiles()}


def _rows(spark: SparkSession, root: str, name: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(*paths)


def write_version(spark: SparkSession, root: str, version: Version) -> None:
    """Fails if the number is taken: of two refreshes at once, one has to run again."""
    frame = spark.createDataFrame(version.rows(), "kind string, name string, value string")
    frame.coalesce(1).write.parquet(f"{root}/summaries/versions/version={version.number}")


def _next_number(spark: SparkSession, root: str) -> int:
    """Above every version and every load, also those that a failed refresh left."""
    taken = [int(n.split("=")[1]) for folder in ("versions", *SUMMARIES, *ORDERS, USER_ROLLUP, TEXT_INDEX)
             for n in _children(spark, f"{root}/summaries/{folder}") if "=" in n]
    return max(taken, default=0) + 1


def refresh_summaries(spark: SparkSession, root: str, tables: dict[str, DataFrame], compact: bool = False,
                      slice_rows: int | None = None) -> Version:
    """Cover the files that are not covered yet; returns the new version (or the old one if there are none).

    Only those files are read. Where a covered file is gone, that table's summaries are made anew. ``compact``
    folds all loads of a summary into one, and sorts all keys of an order again.
    """
    old = newest_version(spark, root)
    now = {t: files_of(tables[t], t) for t in TABLES}
    version = Version(_next_number(spark, root))
    kept = old or Version()
    for t in TABLES:
        version.files[t] = set(now[t])
    new = {t: sorted(set(now[t]) - kept.files[t]) for t in TABLES}
    gone = {t: bool(kept.files[t] - set(now[t])) for t in TABLES}
    if old and not compact and not any(new.values()) and not any(gone.values()):
        return old
    for name, s in SUMMARIES.items():
        loads = [] if gone[s.source] else list(kept.loads.get(name, []))
        paths = sorted(now[s.source].values()) if gone[s.source] else [now[s.source][f] for f in new[s.source]]
        frames = [_load(spark, root, name, loads)] if loads and compact else []
        if paths or (not loads and not frames):
            rows = _rows(spark, root, s.source, paths) if paths else spark.createDataFrame([], SCHEMAS[s.source])
            frames.append(s.states(rows))
        if frames:
            key = s.keys[0]
            (s.merged(frames).repartitionByRange(*s.keys).sortWithinPartitions(*s.keys)
             .write.parquet(f"{root}/summaries/{name}/load={version.number}"))
            loads = [version.number] if compact else [*loads, version.number]
        version.loads[name] = loads
    for name, o in ORDERS.items():
        runs = [] if gone[o.source] or compact else list(kept.loads.get(name, []))
        paths = sorted(now[o.source].values()) if not runs else [now[o.source][f] for f in new[o.source]]
        if paths:
            write_run(_rows(spark, root, o.source, paths), o.sort, o.prefix, o.extra, f"{root}/summaries/{name}/run={version.number}",
                      **({} if slice_rows is None else {"slice_rows": slice_rows}))
            runs.append(version.number)
        version.loads[name] = runs
    indexed = [] if gone["messages"] or compact else list(kept.loads.get(TEXT_INDEX, []))
    paths = sorted(now["messages"].values()) if not indexed else [now["messages"][f] for f in new["messages"]]
    if paths:
        write_index(spark, paths, f"{root}/summaries/{TEXT_INDEX}/load={version.number}", **({} if slice_rows is None else {"block_rows": slice_rows}))
        indexed.append(version.number)
    version.loads[TEXT_INDEX] = indexed
    if compact or gone["messages"] or gone["conversations"] or new["conversations"] or not kept.loads.get(USER_ROLLUP):
        _write_user_rollup(spark, root, tables["conversations"], version)
    else:
        version.loads[USER_ROLLUP] = kept.loads[USER_ROLLUP]
        version.loads[f"{USER_ROLLUP}_of"] = kept.loads[f"{USER_ROLLUP}_of"]
    write_version(spark, root, version)
    return version


def _load(spark: SparkSession, root: str, name: str, loads: list[int]) -> DataFrame:
    s = SUMMARIES[name]
    return s.merged([spark.read.schema(s.schema).parquet(f"{root}/summaries/{name}/load={n}") for n in loads])


def _write_user_rollup(spark: SparkSession, root: str, conversations: DataFrame, version: Version) -> None:
    from chatlens.operators.rollups import user_rollup
    loads = version.loads["conversation_rollup"]
    (user_rollup(conversations, None, finish_rollup(_load(spark, root, "conversation_rollup", loads)))
     .repartitionByRange("user_id").sortWithinPartitions("user_id").write.parquet(f"{root}/summaries/{USER_ROLLUP}/load={version.number}"))
    version.loads[USER_ROLLUP], version.loads[f"{USER_ROLLUP}_of"] = [version.number], list(loads)


@dataclass(frozen=True)
class UserStates:
    """A9 for a page's users: stored counts, and the states of message loads that they do not hold yet."""

    base: DataFrame
    later: DataFrame | None       # conversation_id, total_messages, error_count
    conversations: DataFrame      # user_id, id: clustered by user

    def of(self, user_ids: list) -> DataFrame:
        """``user_id, conversation_count, message_count, error_count`` of at most a page of users."""
        from chatlens.operators.lookup import key_in
        rows = self.base.filter(key_in("user_id", user_ids))
        if self.later is None:
            return rows
        own = self.conversations.filter(key_in("user_id", user_ids))
        more = own.join(self.later, own["id"] == self.later["conversation_id"]).select(
            "user_id", F.lit(0).cast("long").alias("conversation_count"), F.col("total_messages").alias("message_count"), "error_count")
        return rows.unionByName(more).groupBy("user_id").agg(
            *[F.sum(c).alias(c) for c in ("conversation_count", "message_count", "error_count")])


def read_summaries(spark: SparkSession, root: str, tables: dict[str, DataFrame], required: bool = False) -> dict:
    """What ``ChatTables`` carries beside the tables; empty where there are no summaries.

    ``required``: raise where a table's summaries are missing or do not match its files."""
    version = newest_version(spark, root)
    if version is None:
        if required:
            raise ValueError(f"no summaries under {root}: run refresh")
        return {}
    now = {t: files_of(tables[t], t) for t in TABLES}
    stale = {t: bool(version.files[t] - set(now[t])) for t in TABLES}
    live = {t: sorted(now[t][f] for f in set(now[t]) - version.files[t]) for t in TABLES}
    if required and (any(stale.values()) or any(live.values())):
        raise ValueError("summaries do not cover the files: " + ", ".join(
            f"{t}: {len(live[t])} new, {len(version.files[t] - set(now[t]))} gone" for t in TABLES if stale[t] or live[t]))
    out: dict = {}
    for name, s in SUMMARIES.items():
        if stale[s.source] or not version.loads.get(name):
            continue
        frames = [spark.read.schema(s.schema).parquet(f"{root}/summaries/{name}/load={n}") for n in version.loads[name]]
        if live[s.source]:
            frames.append(s.states(_rows(spark, root, s.source, live[s.source])))
        out[name] = s.merged(frames)
    if "conversation_rollup" in out:
        out["conversation_rollup"] = finish_rollup(out["conversation_rollup"])
    orders = {}
    for name, o in ORDERS.items():
        if not stale[o.source]:
            extra = _rows(spark, root, o.source, live[o.source]) if live[o.source] else None
            orders[name] = RankedOrder(spark, [f"{root}/summaries/{name}/run={n}" for n in version.loads.get(name, [])], o.sort, o.prefix, o.extra, extra)
    out["orders"] = orders
    if not stale["messages"] and version.loads.get(TEXT_INDEX):
        out["text_index"] = TextIndex(spark, root, [f"{root}/summaries/{TEXT_INDEX}/load={n}" for n in version.loads[TEXT_INDEX]],
                                      live["messages"], tables["messages"].schema)
    if "conversation_rollup" in out and not stale["conversations"] and not live["conversations"] and version.loads.get(USER_ROLLUP):
        s = SUMMARIES["conversation_rollup"]
        after = [n for n in version.loads["conversation_rollup"] if n not in version.loads[f"{USER_ROLLUP}_of"]]
        frames = [spark.read.schema(s.schema).parquet(f"{root}/summaries/conversation_rollup/load={n}") for n in after]
        if live["messages"]:
            frames.append(s.states(_rows(spark, root, "messages", live["messages"])))
        base = spark.read.schema(_USER_ROLLUP).parquet(f"{root}/summaries/{USER_ROLLUP}/load={version.loads[USER_ROLLUP][0]}")
        out["user_states"] = UserStates(
            base, s.merged(frames).select("conversation_id", "total_messages", "error_count") if frames else None,
            orders["user_conversations_order"].keys().select("user_id", "id"))
    return out
