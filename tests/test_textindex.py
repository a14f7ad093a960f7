"""Content search through the trigram index, and key lookups through bloom filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlens import schema as S
from chatlens.plans import messages
from chatlens.sources import ChatTables, append_messages, load_tables, write_tables
from chatlens.sources.tables import _write_messages
from chatlens.sources import tables as stored_tables
from chatlens.sources.textindex import RANGES, joined_ranges, literal_runs
from tests.handmade import make_tables

ODD = ["50% of a_b \\ c", "GRÜSSE ÄÖÜ und Straße", "İstanbul ΣΊΣΥΦΟΣ", "ab", "", "aa%bb__cc", "needle in Hay", "日本語テキスト", "back\\slash\\%"]
SEARCHES = ["needle", "NEEDLE in", "edl%hay", "grüsse", "straße", "50\\%", "a\\_b", "a_b", "ab", "x", "%", "_", "___", "%%needle%%", "ΣΊΣΥΦΟΣ", "istanbul",
            "İstanbul", "日本語", "本語テ", "\\", "\\\\ c", "back\\\\slash", "aa\\%bb", "filler 17 of", "filler%absent", "nothing like it", "filler", "cc"]


def chat(spark, n):
    """Messages of ``n`` conversations over ten days; the odd texts are in a few places."""
    rows = spark.range(n * 20).select(
        F.col("id"), F.when(F.col("id") % 91 != 0, F.col("id") % n).alias("conversation_id"), F.lit("user").alias("role"),
        F.concat(F.lit("Filler "), F.col("id") % 50, F.lit(" of text "), F.col("id")).alias("content"),
        F.when(F.col("id") % 77 != 0, F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 240).cast("int")))
        .alias("timestamp"), F.lit(None).cast("int").alias("response_time_ms"), F.lit(None).cast("array<string>").alias("tools_used"),
        F.lit(None).cast("string").alias("sql_query"), F.lit(None).cast("int").alias("sql_results_count"),
        F.when(F.col("id") % 5 == 0, "e").alias("error"))
    odd = [(10 ** 6 + i, (i * 37) % n if i % 4 else None, "user", t, dt.datetime(2024, 3, 1 + i % 10), None, None, None, None, "e" if i % 2 else None)
           for i, t in enumerate(ODD)]
    return rows.select(S.MESSAGE_COLUMNS).unionAll(spark.createDataFrame(odd, S.MESSAGES))


@pytest.fixture(scope="module")
def stored(spark, scratch):
    root, all_ = f"{scratch}/searched", chat(spark, 300)
    base = make_tables(spark)
    tables = ChatTables(base.users, base.conversations, all_)
    wave = F.col("id") % 4
    write_tables(ChatTables(base.users, base.conversations, all_.filter(wave < 2)), root, num_files=12, slice_rows=100)
    append_messages(spark, root, all_.filter(wave == 2))
    _write_messages(all_.filter(wave == 3), root, "append", 5_000_000, None)
    return tables, load_tables(spark, root), root


def test_every_search_is_exact(spark, stored):
    tables, indexed, _ = stored
    narrowed = 0
    for search in SEARCHES:
        for how in ({}, {"has_error": True}) if search in ("needle", "%") else ({},):
            want = messages.messages_total(tables, search=search, **how).first().total
            assert messages.messages_total(indexed, search=search, **how).first().total == want, (search, how)
        narrowed += indexed.text_index.candidates(search) is not None
    assert narrowed >= 15 and indexed.text_index.candidates("ab") is None
    for search in ("needle", "filler 17 of"):
        assert messages.messages_list(indexed, search=search, limit=30).collect() == messages.messages_list(tables, search=search, limit=30).collect()


def scanned(spark, df) -> int:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("id")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_rare_text_reads_few_rows(spark, scratch):
    base = make_tables(spark)
    root = f"{scratch}/rare"
    write_tables(ChatTables(base.users, base.conversations, chat(spark, 3000)), root, num_files=24, slice_rows=200)
    indexed = load_tables(spark, root, summaries=True)
    total = indexed.messages.count()
    assert total > 60_000
    assert scanned(spark, indexed.text_index.candidates("needle in")) < total / 10
    assert scanned(spark, indexed.text_index.candidates("nothing like it")) == 0


def test_literal_runs():
    assert literal_runs("%ab_c%") == ["ab", "c"] and literal_runs("%a\\%b\\\\c%") == ["a%b\\c"] and literal_runs("%%_") == []


def test_bloom_filters_skip_row_groups(spark, scratch):
    """A key that lies between a row group's least and greatest value, but isn't there, reads nothing."""
    base = make_tables(spark)
    n = 20_000
    convs = spark.range(n).select("id", F.concat(F.lit("t-"), "id").alias("thread_id"), (F.col("id") * 7919 % n * 2).alias("user_id"),
                                  F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("last_message_at"),
                                  F.lit(0).cast("long").alias("message_count"))
    root = f"{scratch}/bloom"
    write_tables(ChatTables(base.users, convs, base.messages), root)
    stored = load_tables(spark, root).conversations
    there = [scanned(spark, stored.filter(F.col("user_id") == v)) for v in (2, 20_000)]
    absent = [scanned(spark, stored.filter(F.col("user_id") == v)) for v in (1, 777, 20_001, 39_997)]
    assert all(v > 0 for v in there) and sum(v == 0 for v in absent) >= 3
    assert scanned(spark, stored.filter(F.col("thread_id") == "t-5x")) == 0


def test_a_text_in_many_blocks(spark, scratch):
    """Nearly as many blocks as an index lists: the filter names a few ranges of conversations, not each block."""
    base = make_tables(spark)
    root, rows = f"{scratch}/many", chat(spark, 450)
    every = rows.withColumn("content", F.when(F.col("id") % 11 == 7, F.concat(F.lit("Zebra "), "content")).otherwise(F.col("content")))
    write_tables(ChatTables(base.users, base.conversations, every), root, num_files=12, slice_rows=10)
    indexed = load_tables(spark, root, summaries=True)
    assert indexed.text_index.blocks(indexed.text_index.trigrams("zebra")).count() > 400
    assert indexed.text_index.candidates("zebra") is not None
    want = every.filter(F.col("content").ilike("%zebra%") & F.col("error").isNotNull()).count()
    assert messages.messages_total(indexed, search="zebra", has_error=True).first().total == want
    assert messages.errors_total(indexed, search="zebra", date_from=dt.date(2024, 3, 1)).first().total > 0


def test_joined_ranges_hold_every_value():
    assert joined_ranges([]) == [] and joined_ranges([(5, 9), (1, 3), (4, 6)]) == [(1, 9)]
    assert joined_ranges([(0, 1), (10, 11), (13, 14), (90, 91)], 2) == [(0, 14), (90, 91)]
    many = [(i * i, i * i + 1) for i in range(1000)]
    out = joined_ranges(many)
    assert len(out) == RANGES and all(any(a <= low and high <= b for a, b in out) for low, high in many)


def test_long_messages_are_written_by_more_tasks(spark, scratch, monkeypatch):
    """A task sorts a bounded number of bytes, whatever the number of rows in a file."""
    base = make_tables(spark)
    monkeypatch.setattr(stored_tables, "TASK_BYTES", 64 << 10, raising=False)
    root, rows = f"{scratch}/bytes", chat(spark, 150).filter(F.col("timestamp").isNotNull())
    _write_messages(rows, root, "overwrite", 5_000_000, None)
    kept = spark.read.parquet(f"{root}/messages")
    assert kept.count() == rows.count()
    assert len({f.split("/part-")[1][:5] for f in kept.inputFiles()}) >= 5
