"""

Every registered query derives the chat tables from the given test tables
(``events`` -> messages and conversations, ``customer`` -> users; see
``chatlens.sources.fixtures``) and runs the report over the whole tables at
the fixed report time ``FIXTURE_AS_OF``.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatlens.plans import (activity, conversations, kpis, messages,  # noqa: E402
                            tools, users, views)
from chatlens.functions.timefns import ntz  # noqa: E402
from chatlens.operators import integrity, keys  # noqa: E402
from chatlens.session import ensure_checkpoint_dir  # noqa: E402
from chatlens.streaming import additive, replay  # noqa: E402
from chatlens.sources.fixtures import (FIXTURE_AS_OF, from_testdata,  # noqa: E402
                                       message_events, registered_testdata, stored_testdata,
                                       with_planted_faults)
import oracle  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF = FIXTURE_AS_OF

# the subpackage is optional: its absence is no error, but a library that it lacks is one
try:
    import chatlens.llm  # noqa: F401
    import corpus_pipeline
except ModuleNotFoundError as error:
    if error.name not in ("chatlens.llm", "corpus_pipeline"):
        raise
    corpus_pipeline = llm_queries = None
else:
    from chatlens.llm import queries as llm_queries


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the gap-filled hourly activity chart on sf0.001."""
    return activity.activity_hourly(spark, from_testdata(spark, SMOKE_DIR), AS_OF)


def _q(fn: Callable[..., DataFrame], needs_spark: bool = False, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = from_testdata(spark, sf_dir)
        if needs_spark:
            return fn(spark, tables, **params)
        return fn(tables, **params)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


# Parameters of the registered list queries, shared with the oracle texts.
CASES = {
    "users_search": {"search": "MACHINERY 1"},
    "conversations_filtered": {
        "filters": {"date_from": dt.date(2024, 1, 5), "date_to": dt.date(2024, 1, 20),
                    "has_error": True, "search": "building"},
        "limit": 50, "offset": 0},
    "conversations_no_errors": {
        "filters": {"has_error": False}, "limit": 200, "offset": 10},
    "messages_filtered": {
        "filters": {"role": "assistant", "has_error": False, "search": "click",
                    "date_from": dt.date(2024, 1, 10), "date_to": dt.date(2024, 1, 20)},
        "limit": 100, "offset": 20},
    "errors_filtered": {
        "filters": {"search": "error%3}", "date_from": dt.date(2024, 1, 3)},
        "limit": 200, "offset": 5},
    "conversation_search": {"query": "ch", "role": "assistant"},
    "users_page_facts": {"search": "MACHINERY 1", "limit": 50, "offset": 100},
    "cascade": {"started_before": dt.date(2024, 1, 10)},
    "conversations_search": {
        "filters": {"search": "machinery", "date_from": dt.date(2024, 1, 12)},
        "limit": 100, "offset": 7},
    "users_deep": {"limit": 200, "offset": 1400},
    "conversations_deep": {"limit": 200, "offset": 3700},
    "messages_deep": {"limit": 500, "offset": 9300},
    "drill": {"user_id": 7, "conversation_id": 709},
}


def _cascade_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = from_testdata(spark, sf_dir)
    before = CASES["cascade"]["started_before"]
    deleted = tables.conversations.filter(
        tables.conversations["started_at"] < ntz(before))
    return integrity.cascade_delete(tables, deleted).messages


def _last_messages(tables) -> DataFrame:
    return tables.conversations.select("id", "last_message_at")


def _view(view: Callable[..., DataFrame], report: Callable[..., DataFrame],
          report_params: dict | None = None, needs_spark: bool = False, **view_params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = from_testdata(spark, sf_dir)
        args = (spark, tables) if needs_spark else (tables,)
        return view(report(*args, **(report_params or {})), **view_params)
    run.__name__ = view.__name__
    return run


def _stored(fn: Callable[..., DataFrame], **params):
    """The report over the same tables in the stored layout: partitioned and clustered
    files, summaries by load, and key orders (S1-S3, L1-L3)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stored_testdata(spark, sf_dir), **params)
    run.__name__ = fn.__name__
    return run


def _stream(job: Callable[..., DataFrame], **params):
    """A streaming job over the given ``events``, read as a stream. Jobs that
    answer a report also get the tables, for the windows still open."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the session's shared checkpoint folder is used; a local one is set
        # only when the (test) session names none
        ensure_checkpoint_dir(spark)
        return job(message_events(spark, sf_dir), from_testdata(spark, sf_dir), **params)
    run.__name__ = job.__name__
    return run


def _late_activity(spark: SparkSession, sf_dir: str, hourly: bool) -> DataFrame:
    ensure_checkpoint_dir(spark)
    states = replay.replay_states(from_testdata(spark, sf_dir), additive.ACTIVITY, "t1-late")
    return additive.activity_from_states(spark, states, AS_OF, hourly)


def _late_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    tables = from_testdata(spark, sf_dir)
    return additive.top_tools_from_states(replay.replay_states(tables, additive.TOOLS, "t2-late"), tables, AS_OF)


def _late_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    states = replay.replay_states(from_testdata(spark, sf_dir), additive.ROLLUP, "t3-late")
    return additive.rollup_from_states(states)


def _registered_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 over the same tables from key registries that took them in three appends."""
    return keys.registered_duplicates(registered_testdata(spark, sf_dir))


def _faulty(check: Callable[..., DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return check(with_planted_faults(from_testdata(spark, sf_dir)))
    run.__name__ = check.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    cf = CASES["conversations_filtered"]
    cne = CASES["conversations_no_errors"]
    mf = CASES["messages_filtered"]
    ef = CASES["errors_filtered"]
    cs = CASES["conversation_search"]
    us = CASES["users_search"]["search"]
    llm = {} if llm_queries is None else {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}
    drill = CASES["drill"]
    return llm | {
        "stored_kpi_stats": _stored(kpis.kpi_stats, as_of=AS_OF),
        "stored_table_health": _stored(kpis.table_health, as_of=AS_OF),
        "stored_users_page": _stored(users.users_list),
        "stored_users_page_deep": _stored(users.users_list, **CASES["users_deep"]),
        "stored_users_page_search": _stored(users.users_list, search=us),
        "stored_user_by_id": _stored(users.user_detail, user_id=drill["user_id"]),
        "stored_user_conversations_by_id": _stored(users.user_conversations, user_id=drill["user_id"]),
        "stored_conversations_page": _stored(conversations.conversations_list),
        "stored_conversations_page_deep": _stored(conversations.conversations_list, **CASES["conversations_deep"]),
        "stored_conversations_page_filtered": _stored(
            conversations.conversations_list, limit=cf["limit"], offset=cf["offset"], **cf["filters"]),
        "stored_conversations_page_of_user": _stored(conversations.conversations_list, user_id=drill["user_id"]),
        "stored_conversation_detail": _stored(conversations.conversation_detail),
        "stored_messages_page": _stored(messages.messages_list),
        "stored_messages_page_deep": _stored(messages.messages_list, **CASES["messages_deep"]),
        "stored_messages_page_filtered": _stored(
            messages.messages_list, limit=mf["limit"], offset=mf["offset"], **mf["filters"]),
        "stored_messages_total_filtered": _stored(messages.messages_total, **mf["filters"]),
        "stored_errors_page": _stored(messages.errors_list),
        "stored_errors_total_filtered": _stored(messages.errors_total, **ef["filters"]),
        "activity_hourly": _q(activity.activity_hourly, True, as_of=AS_OF),
        "activity_daily": _q(activity.activity_daily, True, as_of=AS_OF),
        "kpi_stats": _q(kpis.kpi_stats, as_of=AS_OF),
        "table_health": _q(kpis.table_health, as_of=AS_OF),
        "top_tools": _q(tools.top_tools, as_of=AS_OF),
        "top_tools_ranked": _q(tools.top_tools_ranked, as_of=AS_OF),
        "users_page": _q(users.users_list),
        "users_total": _q(users.users_total),
        "users_page_search": _q(users.users_list, search=us),
        "users_total_search": _q(users.users_total, search=us),
        "user_detail": _q(users.user_detail),
        "user_conversations": _q(users.user_conversations, paged=False),
        "user_conversations_page": _q(users.user_conversations),
        "conversations_page": _q(conversations.conversations_list),
        "conversations_page_deep": _q(conversations.conversations_list, **CASES["conversations_deep"]),
        "conversations_total": _q(conversations.conversations_total),
        "conversations_page_filtered": _q(
            conversations.conversations_list, limit=cf["limit"], offset=cf["offset"],
            **cf["filters"]),
        "conversations_total_filtered": _q(conversations.conversations_total,
                                           **cf["filters"]),
        "conversations_page_no_errors": _q(
            conversations.conversations_list, limit=cne["limit"], offset=cne["offset"],
            **cne["filters"]),
        "conversations_total_no_errors": _q(conversations.conversations_total,
                                            **cne["filters"]),
        "conversation_detail": _q(conversations.conversation_detail),
        "conversation_messages": _q(conversations.conversation_messages,
                                    query=cs["query"]),
        "user_by_id": _q(users.user_detail, user_id=CASES["drill"]["user_id"]),
        "user_by_id_missing": _q(users.user_detail, user_id=-1),
        "conversation_by_id": _q(conversations.conversation_detail,
                                 conversation_id=CASES["drill"]["conversation_id"]),
        "conversation_by_id_missing": _q(conversations.conversation_detail, conversation_id=-1),
        "conversation_messages_by_id": _q(conversations.conversation_messages,
                                          conversation_id=CASES["drill"]["conversation_id"],
                                          query=cs["query"]),
        "conversation_messages_errors": _q(conversations.conversation_messages, role=cs["role"],
                                           errors_only=True),
        "user_conversations_by_id": _q(users.user_conversations,
                                       user_id=CASES["drill"]["user_id"]),
        "conversations_page_of_user": _q(conversations.conversations_list,
                                         user_id=CASES["drill"]["user_id"]),
        "messages_page_of_conversation": _q(messages.messages_list,
                                            conversation_id=CASES["drill"]["conversation_id"]),
        "conversation_match_counts": _q(conversations.conversation_match_counts,
                                        query=cs["query"], role=cs["role"]),
        "messages_page": _q(messages.messages_list),
        "messages_page_deep": _q(messages.messages_list, **CASES["messages_deep"]),
        "messages_total": _q(messages.messages_total),
        "messages_page_filtered": _q(messages.messages_list, limit=mf["limit"],
                                     offset=mf["offset"], **mf["filters"]),
        "messages_total_filtered": _q(messages.messages_total, **mf["filters"]),
        "errors_page": _q(messages.errors_list),
        "errors_total": _q(messages.errors_total),
        "errors_page_filtered": _q(messages.errors_list, limit=ef["limit"],
                                   offset=ef["offset"], **ef["filters"]),
        "errors_total_filtered": _q(messages.errors_total, **ef["filters"]),
        "dashboard_cards": _view(views.dashboard_cards, kpis.kpi_stats,
                                 {"as_of": AS_OF}, as_of=AS_OF),
        "conversations_page_view": _view(views.conversations_view,
                                         conversations.conversations_list,
                                         as_of=AS_OF, lang="de"),
        "conversation_labels_de": _view(views.relative_time, _last_messages, as_of=AS_OF, lang="de",
                                        col="last_message_at", name="last_message_label"),
        "conversation_labels_en": _view(views.relative_time, _last_messages, as_of=AS_OF, lang="en",
                                        col="last_message_at", name="last_message_label"),
        "conversation_header": _view(views.conversation_header,
                                     conversations.conversation_detail),
        "users_page_view": _view(views.users_view, users.users_list),
        "errors_page_view": _view(views.errors_view, messages.errors_list),
        "activity_hourly_view": _view(views.activity_view, activity.activity_hourly,
                                      {"as_of": AS_OF}, needs_spark=True),
        "users_page_facts": _view(views.list_page_facts, users.users_total,
                                  {"search": CASES["users_page_facts"]["search"]},
                                  limit=CASES["users_page_facts"]["limit"],
                                  offset=CASES["users_page_facts"]["offset"]),
        "conversations_page_search": _q(
            conversations.conversations_list, limit=CASES["conversations_search"]["limit"],
            offset=CASES["conversations_search"]["offset"],
            **CASES["conversations_search"]["filters"]),
        "conversations_total_search": _q(conversations.conversations_total,
                                         **CASES["conversations_search"]["filters"]),
        "users_page_deep": _q(users.users_list, limit=CASES["users_deep"]["limit"],
                              offset=CASES["users_deep"]["offset"]),
        "dq_duplicate_keys": _faulty(integrity.duplicate_keys),
        "stored_dq_duplicate_keys": _registered_duplicates,
        "dq_duplicate_key_summary": _faulty(integrity.duplicate_key_summary),
        "dq_required_nulls": _faulty(integrity.required_nulls),
        "dq_orphans": _faulty(integrity.orphan_summary),
        "dq_orphan_conversations": _faulty(integrity.orphan_conversations),
        "dq_orphan_messages": _faulty(integrity.orphan_messages),
        "dq_cascade_messages": _cascade_messages,
        "dq_counter_audit": _q(integrity.counter_audit),
        "stream_activity_buckets": _stream(replay.replay_activity_buckets),
        "stream_tool_buckets": _stream(replay.replay_tool_buckets),
        "stream_activity_hourly": _stream(replay.replay_activity, as_of=AS_OF),
        "stream_activity_daily": _stream(replay.replay_activity, as_of=AS_OF, hourly=False),
        "stream_top_tools": _stream(replay.replay_top_tools, as_of=AS_OF),
        "stream_late_activity_hourly": partial(_late_activity, hourly=True),
        "stream_late_activity_daily": partial(_late_activity, hourly=False),
        "stream_late_top_tools": _late_tools,
        "stream_late_conversation_rollup": _late_rollup,
        "stream_conversation_rollup": _stream(replay.replay_conversation_rollup),
        "stream_dedup_messages": _stream(replay.replay_dedup),
    }


def oracle_sql() -> dict[str, str]:
    llm = {} if llm_queries is None else dict(llm_queries.ORACLE)
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        llm["pipeline"] = corpus_pipeline.ORACLE_SQL
    return llm | oracle.oracle_sql(CASES)
