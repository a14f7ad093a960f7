"""Command line: one report per call, named after the original endpoints.

    python -m chatlens <report> --tables ROOT [--as-of TS] [--param k=v ...]
                       [--out PATH --format json|parquet|csv|orc]

``ROOT`` holds the stored layout (``users/``, ``conversations/``,
``messages/``; see ``sources.tables.write_tables``); ``--testdata DIR`` derives
the tables from a test-data folder instead. Without ``--out`` the rows are
printed as JSON lines, which is meant for page-sized results (lists, details,
KPIs); whole results go to ``--out``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from chatlens.plans import activity, conversations, kpis, messages, tools, users

# report name -> (function, needs the SparkSession, takes as_of)
REPORTS = {
    "stats": (kpis.kpi_stats, False, True),
    "db-health": (kpis.table_health, False, True),
    "activity-hourly": (activity.activity_hourly, True, True),
    "activity-daily": (activity.activity_daily, True, True),
    "tools": (tools.top_tools, False, True),
    "users": (users.users_list, False, False),
    "users-total": (users.users_total, False, False),
    "user": (users.user_detail, False, False),
    "user-conversations": (users.user_conversations, False, False),
    "conversations": (conversations.conversations_list, False, False),
    "conversations-total": (conversations.conversations_total, False, False),
    "conversation": (conversations.conversation_detail, False, False),
    "conversation-messages": (conversations.conversation_messages, False, False),
    "messages": (messages.messages_list, False, False),
    "messages-total": (messages.messages_total, False, False),
    "errors": (messages.errors_list, False, False),
    "errors-total": (messages.errors_total, False, False),
}

_INT = {"limit", "offset", "user_id", "conversation_id"}
_BOOL = {"has_error", "errors_only"}
_DATE = {"date_from", "date_to"}


def parse_param(text: str) -> tuple[str, object]:
    key, _, value = text.partition("=")
    if key in _INT:
        return key, int(value)
    if key in _BOOL:
        return key, value.lower() in ("1", "true", "yes")
    if key in _DATE:
        return key, dt.date.fromisoformat(value)
    return key, value


def run(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="chatlens")
    ap.add_argument("report", choices=sorted(REPORTS))
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="root of the stored users/conversations/messages")
    src.add_argument("--testdata", help="test-data folder with events/customer parquet")
    ap.add_argument("--as-of", help="report time, ISO (default: now, UTC)")
    ap.add_argument("--param", action="append", default=[], help="key=value")
    ap.add_argument("--out")
    ap.add_argument("--format", default="json")
    ap.add_argument("--master")
    args = ap.parse_args(argv)

    from chatlens.session import build_session
    from chatlens.sources import export, from_testdata, load_tables
    spark = build_session(args.master)
    tables = (load_tables(spark, args.tables) if args.tables
              else from_testdata(spark, args.testdata))
    fn, needs_spark, takes_as_of = REPORTS[args.report]
    params = dict(parse_param(p) for p in args.param)
    if takes_as_of and args.as_of:
        params["as_of"] = dt.datetime.fromisoformat(args.as_of)
    df = fn(spark, tables, **params) if needs_spark else fn(tables, **params)
    if args.out:
        export(df, args.out, args.format)
    else:
        for row in df.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(run())
