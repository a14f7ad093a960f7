"""The command line maps endpoint names to reports."""

import datetime as dt
import json

from chatlens.cli import REPORTS, parse_param, run
from tests.conftest import SF_SMALL


def test_parse_param():
    assert parse_param("limit=5") == ("limit", 5)
    assert parse_param("has_error=false") == ("has_error", False)
    assert parse_param("date_to=2024-01-05") == ("date_to", dt.date(2024, 1, 5))
    assert parse_param("search=a=b") == ("search", "a=b")


def test_every_endpoint_has_a_report():
    assert {"stats", "db-health", "activity-hourly", "activity-daily", "tools", "users",
            "user", "conversations", "conversation", "messages", "errors"} <= set(REPORTS)


def test_run_prints_json_lines(spark, capsys):
    assert run(["errors", "--testdata", SF_SMALL, "--param", "limit=4"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(lines) == 4 and all(x["error"] is not None for x in lines)
    assert run(["activity-daily", "--testdata", SF_SMALL, "--as-of", "2024-01-30T18:30:00"]) == 0
    days = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(days) == 14 and days[-1]["bucket"].startswith("2024-01-30")
