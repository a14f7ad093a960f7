"""F1-F16: the optional filters of the list reports.

Every builder returns a Column or ``None`` (= parameter absent, no filter);
``all_of`` ANDs the given ones. Literal bounds keep the predicates foldable
so Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions.patterns import contains_pattern
from chatlens.functions.timefns import DAY, ntz
from chatlens.schema import MESSAGE_DATE_PARTITION


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def all_of(*preds: Column | None) -> Column:
    """F16: AND of the given predicates; true when none is given."""
    given = [p for p in preds if p is not None]
    if not given:
        return F.lit(True)
    return reduce(lambda a, b: a & b, given)


def key_equals(col: Column | str, value) -> Column | None:
    """equality on a key; absent (None) = no filter."""
    return None if value is None else _c(col) == F.lit(value)


def role_equals(col: Column | str, role: str | None) -> Column | None:
    """exact role; None or '' = no filter."""
    return _c(col) == F.lit(role) if role else None


def on_or_after_day(col: Column | str, day: dt.date | None) -> Column | None:
    """``ts >= day`` (midnight)."""
    return None if day is None else _c(col) >= ntz(day)


def on_or_before_day(col: Column | str, day: dt.date | None) -> Column | None:
    """inclusive end day, ``ts < day + 1 day``."""
    return None if day is None else _c(col) < ntz(day + DAY)


def null_tristate(col: Column | str, flag: bool | None) -> Column | None:
    """True -> NOT NULL, False -> NULL, None -> all."""
    if flag is None:
        return None
    return _c(col).isNotNull() if flag else _c(col).isNull()


def count_tristate(col: Column | str, flag: bool | None) -> Column | None:
    """on an aggregated count with missing = 0: True -> > 0, False -> = 0."""
    if flag is None:
        return None
    n = F.coalesce(_c(col), F.lit(0))
    return n > 0 if flag else n == 0


def ilike_any(cols: list[str], text: str | None) -> Column | None:
    """``col ILIKE '%text%'`` OR-ed over ``cols``; '' / None = no filter.

    NULL columns do not match; a row whose every column is NULL drops out.
    """
    if not text:
        return None
    pattern = contains_pattern(text)
    preds = [F.coalesce(_c(c).ilike(pattern), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def since(col: Column | str, bound: dt.datetime, *, strict: bool = False,
          date_partition: bool = False) -> Column:
    """``ts >= bound`` (``>`` when strict), no upper bound.

    With ``date_partition`` the same bound is also put on the stored day
    column so whole folders are pruned.
    """
    c = _c(col)
    pred = c > ntz(bound) if strict else c >= ntz(bound)
    if date_partition:
        pred = pred & (F.col(MESSAGE_DATE_PARTITION) >= F.lit(bound.date()))
    return pred


def between_times(col: Column | str, lower: dt.datetime, upper_exclusive: dt.datetime,
                  *, date_partition: bool = False) -> Column:
    """``lower <= ts < upper_exclusive`` (with day-folder pruning if stored)."""
    c = _c(col)
    pred = (c >= ntz(lower)) & (c < ntz(upper_exclusive))
    if date_partition:
        part = F.col(MESSAGE_DATE_PARTITION)
        pred = pred & (part >= F.lit(lower.date())) & (part <= F.lit(upper_exclusive.date()))
    return pred


def date_range(col: Column | str, date_from: dt.date | None, date_to: dt.date | None,
               *, date_partition: bool = False) -> Column | None:
    """F3 AND F4 with optional day-folder pruning."""
    pred = all_of(on_or_after_day(col, date_from), on_or_before_day(col, date_to))
    if date_from is None and date_to is None:
        return None
    if date_partition:
        part = F.col(MESSAGE_DATE_PARTITION)
        if date_from is not None:
            pred = pred & (part >= F.lit(date_from))
        if date_to is not None:
            pred = pred & (part <= F.lit(date_to))
    return pred


def assistant_latency_sample(role: str = "role", latency: str = "response_time_ms") -> Column:
    """F12 without the window: assistant rows with a latency."""
    return (F.col(role) == "assistant") & F.col(latency).isNotNull()


def in_conversation_match(query: str | None, content: str = "content",
                          tools: str = "tools_used", error: str = "error") -> Column | None:
    """lower-cased literal substring in content, any tool name, or error."""
    if not query:
        return None
    q = F.lit(query.lower())
    in_content = F.coalesce(F.contains(F.lower(F.col(content)), q), F.lit(False))
    in_tools = F.coalesce(
        F.exists(F.col(tools),
                 lambda t: F.coalesce(F.contains(F.lower(t), q), F.lit(False))),
        F.lit(False))
    in_error = F.coalesce(F.contains(F.lower(F.col(error)), q), F.lit(False))
    return in_content | in_tools | in_error


def role_selector(role: str, col: str = "role") -> Column | None:
    """'all' | 'user' | 'assistant'."""
    if role not in ("all", "user", "assistant"):
        raise ValueError(f"role must be all, user or assistant, not {role!r}")
    return None if role == "all" else F.col(col) == F.lit(role)


def truthy_error(col: str = "error") -> Column:
    """error present and not the empty string."""
    return F.coalesce(F.col(col).isNotNull() & (F.col(col) != ""), F.lit(False))
