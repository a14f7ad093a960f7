"""The derived text columns the UI shows next to the numbers.

All are built-in expressions (no Python per row). C5 rounds the binary double
to tenths of a second, as JavaScript's ``toFixed`` does (``1450 ms -> 1.4s``).
Elsewhere, where the UI's JavaScript and the JVM differ, the JVM result is used:
* C8 counts code points; JavaScript's ``slice`` counts UTF-16 units.
* C9 matches case-insensitively with Unicode case folding, like the ``i``
  flag of a JavaScript regex.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions.timefns import floor_minutes_between, ntz

# The relative-time wording of the two UI languages.
RELATIVE_WORDING = {
    "en": {"just_now": "just now", "minutes": "{n} minutes ago",
           "hours": "{n} hours ago", "yesterday": "yesterday",
           "days": "{n} days ago"},
    "de": {"just_now": "gerade eben", "minutes": "vor {n} Minuten",
           "hours": "vor {n} Stunden", "yesterday": "gestern",
           "days": "vor {n} Tagen"},
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _fill(template: str, n: Column) -> Column:
    before, after = template.split("{n}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def duration_label(start: Column | str, end: Column | str) -> Column:
    """Whole minutes between two times: ``< 1 min``, ``N min``, ``Hh Mm``."""
    mins = floor_minutes_between(start, end).cast("long")
    return (F.when(mins < 1, F.lit("< 1 min"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min")))
            .otherwise(F.concat(F.floor(mins / 60).cast("string"), F.lit("h "),
                                (mins % 60).cast("string"), F.lit("m"))))


def relative_time_label(ts: Column | str, as_of: dt.datetime, lang: str = "en",
                        with_yesterday: bool = True, null_text: str | None = None) -> Column:
    """C4: just now / N minutes / N hours / (yesterday) / N days before as_of.

    The list page says "yesterday" for one day; the dashboard does not and
    shows ``null_text`` ("—") for a missing time.
    """
    words = RELATIVE_WORDING[lang]
    mins = floor_minutes_between(ts, ntz(as_of)).cast("long")
    hours = F.floor(mins / 60).cast("long")
    days = F.floor(hours / 24).cast("long")
    label = (F.when(mins < 1, F.lit(words["just_now"]))
             .when(mins < 60, _fill(words["minutes"], mins))
             .when(hours < 24, _fill(words["hours"], hours)))
    if with_yesterday:
        label = label.when(days == 1, F.lit(words["yesterday"]))
    label = label.otherwise(_fill(words["days"], days))
    if null_text is not None:
        label = F.when(_c(ts).isNull(), F.lit(null_text)).otherwise(label)
    return label


def latency_label(ms: Column | str) -> Column:
    """``< 1000`` -> ``Nms``; else seconds with one decimal and ``s``.

    The seconds are a double, and its binary value is rounded: 1450 ms are a
    little under 1.45 s and give ``1.4s``, 1250 ms are exactly 1.25 s and give
    ``1.3s``. At a tie in milliseconds the double, times a power of two that
    makes it an integer, is compared with the exact value.
    """
    v = _c(ms).cast("long")
    seconds = v.cast("double") / F.lit(1000.0)
    power = F.pow(F.lit(2.0), F.lit(53.0) - F.floor(F.log2(F.greatest(seconds, F.lit(1.0)))))
    exact = lambda x: x.cast("long").cast("decimal(20,0)")
    below = (v % 100 == 50) & (exact(seconds * power) * F.lit(1000).cast("decimal(5,0)")
                               < exact(v) * exact(power))
    tenths = (F.floor((v + 50) / 100) - F.when(below, 1).otherwise(0)).cast("long")
    secs = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("s"))
    return F.when(v < 1000, F.concat(v.cast("string"), F.lit("ms"))).otherwise(secs)


def missing_latency_label(ms: Column | str) -> Column:
    """0 (no assistant latency) -> ``—``, else ``Nms``."""
    v = _c(ms).cast("long")
    return F.when(v > 0, F.concat(v.cast("string"), F.lit("ms"))).otherwise(F.lit("—"))


def name_fallback(fallback: str, display_name: str = "display_name",
                  email: str | None = "email") -> Column:
    """display_name, then email, then ``fallback``; '' falls through."""
    parts = [F.nullif(F.col(display_name), F.lit(""))]
    if email:
        parts.append(F.nullif(F.col(email), F.lit("")))
    return F.coalesce(*parts, F.lit(fallback))


def content_preview(content: Column | str, length: int = 100) -> Column:
    """First ``length`` characters and always ``...``."""
    return F.concat(F.substring(_c(content), 1, length), F.lit("..."))


def _java_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def highlight(content: Column | str, query: str | None) -> Column:
    """Wrap every case-insensitive literal match of ``query`` as ``==m==``."""
    c = _c(content)
    if not query:
        return c
    return F.regexp_replace(c, F.lit("(?iu)(" + _java_quote(query) + ")"),
                            F.lit("==$1=="))


def tools_text(tools: Column | str) -> Column:
    """Tool names joined by ``, `` (NULL names skipped)."""
    return F.array_join(_c(tools), ", ")


def status_flag(count: Column | str) -> Column:
    """C11: ``error`` when the count is above zero, else ``success``."""
    return F.when(_c(count) > 0, F.lit("error")).otherwise(F.lit("success"))


def hour_label(bucket: Column | str) -> Column:
    """``HH:mm`` of a bucket."""
    return F.date_format(_c(bucket), "HH:mm")
