"""C1-C12 and L8 applied to the reports: what each UI page shows.

Each view takes a report DataFrame (already cut to a page or one row) and
adds text columns; all of them are built-in expressions evaluated inside the
same codegen stage as the report's last projection.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from chatlens.functions.labels import (content_preview, duration_label,
                                       hour_label, latency_label,
                                       missing_latency_label, name_fallback,
                                       relative_time_label, status_flag)
from chatlens.functions.timefns import resolve_as_of
from chatlens.operators.paging import page_facts


def dashboard_cards(kpis: DataFrame, as_of: dt.datetime | None = None,
                    lang: str = "en") -> DataFrame:
    """R1 + C4 (dashboard wording, no "yesterday", ``—`` when NULL), C5, C11."""
    now = resolve_as_of(as_of)
    return kpis.select(
        "*",
        relative_time_label("last_message_at", now, lang, with_yesterday=False,
                            null_text="—").alias("last_activity_label"),
        latency_label("avg_response_time_ms_7d").alias("avg_response_label"),
        latency_label("p95_response_time_ms_7d").alias("p95_response_label"),
        status_flag("errors_24h").alias("errors_status"))


def conversations_view(rows: DataFrame, as_of: dt.datetime | None = None,
                       lang: str = "en") -> DataFrame:
    """R7 + C7 (``Unknown``), C6, C3 and C4 (with "yesterday")."""
    now = resolve_as_of(as_of)
    return rows.select(
        "*",
        name_fallback("Unknown", email=None).alias("user_label"),
        missing_latency_label("avg_assistant_response_time_ms").alias("avg_response_label"),
        duration_label("started_at", "last_message_at").alias("duration_label"),
        relative_time_label("last_message_at", now, lang).alias("last_message_label"))


def conversation_header(detail: DataFrame) -> DataFrame:
    """R8 header + C7 (display_name, then email, then ``Unknown User``)."""
    return detail.select("*", name_fallback("Unknown User").alias("user_label"))


def users_view(rows: DataFrame) -> DataFrame:
    """R5 + C7 (``—``) for name and email, C11 error badge."""
    return rows.select(
        "*",
        name_fallback("—", email=None).alias("name_label"),
        name_fallback("—", display_name="email", email=None).alias("email_label"),
        status_flag("error_count").alias("error_badge"))


def errors_view(rows: DataFrame) -> DataFrame:
    """R10 + C7 (``—``) and C8 content preview."""
    return rows.select(
        "*",
        name_fallback("—", email=None).alias("user_label"),
        content_preview("content").alias("content_preview"))


def activity_view(rows: DataFrame) -> DataFrame:
    """R2 + C12 hour label."""
    return rows.select("*", hour_label("bucket").alias("hour_label"))


def list_page_facts(total_df: DataFrame, limit: int, offset: int) -> DataFrame:
    """L8 over an R5/R7/R9/R10 total."""
    return page_facts(total_df, limit, offset)


def relative_time(df: DataFrame, col: str, as_of: dt.datetime | None = None,
                  lang: str = "en", name: str | None = None) -> DataFrame:
    """C4 on any timestamp column (list wording)."""
    return df.withColumn(name or f"{col}_label",
                         relative_time_label(col, resolve_as_of(as_of), lang))


__all__ = ["dashboard_cards", "conversations_view", "conversation_header",
           "users_view", "errors_view", "activity_view", "list_page_facts",
           "relative_time"]
