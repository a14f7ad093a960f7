"""DuckDB oracle texts for the registered queries.

Each text is written from the report's definition in words, in another form
than the Spark code: range joins instead of bucketing, ranks instead of a
percentile function, integer division instead of rounding, numbered rows
instead of LIMIT, membership tests instead of counters. The chat tables are
derived from ``events`` and ``customer`` by the CTEs ``u_``, ``c_`` and ``m_``
(the name ``conversations`` is taken by a test table).
"""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-30 18:30:00'"
TODAY = "TIMESTAMP '2024-01-30 00:00:00'"
DAY_AGO = "TIMESTAMP '2024-01-29 18:30:00'"
WEEK_AGO = "TIMESTAMP '2024-01-23 18:30:00'"
HOUR_AGO = "TIMESTAMP '2024-01-30 17:30:00'"

FIXTURE_CTES = """
m_ AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id*100 + day(ts) END AS conversation_id,
    CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN event_id % 3 = 0 THEN repeat(concat(event_type, ' ', props, ' '), 9)
      ELSE concat(event_type, ' ', props) END AS content,
    ts AS timestamp,
    CASE WHEN event_id % 2 = 1 AND event_id % 10 <> 1 THEN CAST(floor(value*10) AS INT) END AS response_time_ms,
    CASE event_type WHEN 'view' THEN ['search'] WHEN 'click' THEN ['search','sql']
      WHEN 'purchase' THEN ['sql',NULL,'chart'] WHEN 'signup' THEN CAST([] AS VARCHAR[]) END AS tools_used,
    CASE WHEN event_type = 'purchase' THEN concat('SELECT ', event_id) END AS sql_query,
    CASE WHEN event_type = 'purchase' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS sql_results_count,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('E', user_id) END END AS error
  FROM events),
c_ AS (
  SELECT user_id*100 + day(ts) AS id,
    concat('t-', user_id*100 + day(ts)) AS thread_id,
    CASE WHEN (user_id*100 + day(ts)) % 89 = 0 THEN NULL ELSE user_id END AS user_id,
    min(ts) AS started_at, max(ts) AS last_message_at, count(*) AS message_count
  FROM events GROUP BY user_id, day(ts)),
u_ AS (
  SELECT c_custkey AS id, c_name AS ms_user_id,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(c_mktsegment, ' ', c_custkey) END AS display_name,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lower(concat(c_mktsegment, '_', c_custkey, '@example.com')) END AS email,
    e.first_seen, CASE WHEN c_custkey % 5 <> 0 THEN e.last_active END AS last_active
  FROM customer LEFT JOIN
    (SELECT user_id, min(ts) first_seen, max(ts) last_active FROM events GROUP BY user_id) e
    ON e.user_id = c_custkey)"""

# the same tables with faults planted, for the quality checks
FAULTY_CTES = """,
fu AS (SELECT CASE WHEN id % 17 = 0 THEN NULL ELSE id END AS id,
              CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN 'shared' ELSE ms_user_id END AS ms_user_id FROM u_),
fc AS (SELECT id, CASE WHEN id % 29 = 0 THEN NULL WHEN id % 31 = 0 THEN 't-shared' ELSE thread_id END AS thread_id,
              CASE WHEN id % 37 = 0 THEN -user_id ELSE user_id END AS user_id, started_at, last_message_at, message_count FROM c_),
fm AS (SELECT id, CASE WHEN id % 41 = 0 THEN -conversation_id ELSE conversation_id END AS conversation_id,
              CASE WHEN id % 43 = 0 THEN NULL ELSE role END AS role, CASE WHEN id % 47 = 0 THEN NULL ELSE content END AS content,
              timestamp, response_time_ms, tools_used, sql_query, sql_results_count, error
       FROM m_, range(2) copy(n) WHERE n = 0 OR id % 53 = 0)"""

# figures of each conversation; the mean latency is the rounded quotient of two whole numbers
PER_CONVERSATION = """,
k_ AS (
  SELECT conversation_id AS k, count(id) AS n, sum(CAST(role = 'user' AS INT)) AS n_user,
    sum(CAST(role = 'assistant' AS INT)) AS n_assistant, count(error) AS n_error,
    min(timestamp) AS t_first, max(timestamp) AS t_last, max(CASE WHEN error IS NULL THEN NULL ELSE timestamp END) AS t_error,
    CAST(sum(CASE role WHEN 'assistant' THEN response_time_ms END) AS BIGINT) AS ms_sum,
    count(CASE role WHEN 'assistant' THEN response_time_ms END) AS ms_n
  FROM m_ WHERE conversation_id IS NOT NULL GROUP BY k)"""
MEAN = "CASE WHEN ms_n > 0 THEN (2 * ms_sum + ms_n) // (2 * ms_n) END"


def _with(body: str, *extra: str) -> str:
    return f"WITH{FIXTURE_CTES}{''.join(extra)}\n{body}"


def _num(expr: str) -> str:
    return f"CAST(ifnull({expr}, 0) AS BIGINT)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _page(rows: str, newest: str, limit: int, offset: int = 0) -> str:
    """Rows numbered by ``newest`` (a missing time counts as newest), then id."""
    return (f"{rows}\nQUALIFY row_number() OVER (ORDER BY ({newest} IS NULL) DESC, {newest} DESC, id) "
            f"BETWEEN {offset + 1} AND {offset + limit}")


# ---------------------------------------------------------------- charts ---
def _activity(unit: str, newest: str, n: int) -> str:
    """Messages that lie in each of ``n`` buckets, the last starting at ``newest``."""
    return _with(f"""SELECT b.bucket, count(m_.id) AS messages, count(m_.error) AS errors
FROM (SELECT TIMESTAMP '{newest}' - i * INTERVAL 1 {unit} AS bucket FROM range({n}) r(i)) b
LEFT JOIN m_ ON m_.timestamp >= b.bucket AND m_.timestamp < b.bucket + INTERVAL 1 {unit}
GROUP BY b.bucket""")


HOURLY = _activity("HOUR", "2024-01-30 18:00:00", 24)
DAILY = _activity("DAY", "2024-01-30 00:00:00", 14)

# percentile p: the values beside place p * (n - 1), weighted by nearness
KPI_STATS = _with(f"""SELECT {NOW} AS generated_at, uu.total_users, cc.total_conversations, mm.*, cc.active_users_today,
  {_num('ll.avg_ms')} AS avg_response_time_ms_7d,
  {_num('round_even(ll.p50, 0)')} AS p50_response_time_ms_7d, {_num('round_even(ll.p95, 0)')} AS p95_response_time_ms_7d
FROM uu, cc, mm, ll""", f""",
uu AS (SELECT count(id) AS total_users FROM u_),
cc AS (SELECT count(id) AS total_conversations, 
         CAST(ifnull(len(list(DISTINCT user_id) FILTER (last_message_at >= {TODAY} AND user_id IS NOT NULL)), 0) AS BIGINT)
         AS active_users_today FROM c_),
mm AS (SELECT count(id) AS total_messages, CAST(sum(CAST(timestamp >= {TODAY} AS INT)) AS BIGINT) AS messages_today,
         CAST(sum(CAST(timestamp >= {DAY_AGO} AS INT)) AS BIGINT) AS messages_24h,
         count(CASE WHEN timestamp >= {DAY_AGO} THEN error END) AS errors_24h,
         count(CASE WHEN timestamp >= {DAY_AGO} AND role = 'assistant' THEN id END) AS assistant_messages_24h,
         max(timestamp) AS last_message_at FROM m_),
placed AS (SELECT response_time_ms AS v, row_number() OVER (ORDER BY response_time_ms) - 1 AS place, count(*) OVER () - 1 AS top
           FROM m_ WHERE role = 'assistant' AND timestamp >= {WEEK_AGO} AND response_time_ms IS NOT NULL),
ll AS (SELECT (2 * sum(v) + count(v)) // (2 * count(v)) AS avg_ms,
         sum(v * greatest(0, 1 - abs(place - 0.5::DOUBLE * top))) AS p50,
         sum(v * greatest(0, 1 - abs(place - 0.95::DOUBLE * top))) AS p95 FROM placed)""")

TABLE_HEALTH = _with(f"""SELECT {NOW} AS server_time, * FROM
  (SELECT count(id) AS users FROM u_), (SELECT count(id) AS conversations FROM c_),
  (SELECT count(id) AS messages, count(CASE WHEN timestamp > {HOUR_AGO} THEN id END) AS messages_last_hour,
          count(error) AS errors FROM m_)""")

_TOOL_COUNTS = f"""
(SELECT m_.tools_used[p.i] AS tool, count(*) AS count
 FROM m_ JOIN range(1, 1 + (SELECT max(len(tools_used)) FROM m_)) p(i) ON p.i <= len(m_.tools_used)
 WHERE m_.timestamp >= {WEEK_AGO} GROUP BY 1)"""
TOP_TOOLS_RANKED = _with(f"""SELECT tool, count, place AS rank, count * 100.0::DOUBLE / max(count) OVER () AS share_pct
FROM (SELECT *, row_number() OVER (ORDER BY count DESC, tool IS NULL, tool) AS place FROM {_TOOL_COUNTS}) WHERE place <= 8""")
TOP_TOOLS = f"SELECT tool, count FROM ({TOP_TOOLS_RANKED})"


# ----------------------------------------------------------------- lists ---
def _names_like(search: str) -> str:
    return (f"len(list_filter([display_name, email, ms_user_id], "
            f"lambda x: lower(x) LIKE {_quoted('%' + search.lower() + '%')})) > 0")


def _where(*conditions: str | None) -> str:
    used = [c for c in conditions if c]
    return f"\nWHERE {' AND '.join(used)}" if used else ""


def _users(search: str | None = None, only: int | None = None, limit: int | None = None, offset: int = 0) -> str:
    rows = f"""SELECT *, (SELECT count(*) FROM c_ WHERE c_.user_id = u_.id) AS conversation_count,
  (SELECT count(*) FROM owned WHERE owned.owner = u_.id) AS message_count,
  (SELECT count(owned.error) FROM owned WHERE owned.owner = u_.id) AS error_count
FROM u_{_where(search and _names_like(search), only and f"id = {only}")}"""
    return _with(rows if limit is None else _page(rows, "last_active", limit, offset), """,
owned AS (SELECT c_.user_id AS owner, m_.error FROM c_ JOIN m_ ON m_.conversation_id = c_.id)""")


def _users_total(search: str | None = None) -> str:
    return _with(f"SELECT count(id) AS total FROM u_{_where(search and _names_like(search))}")


def _user_conversations(only: int | None = None, limit: int | None = None) -> str:
    rows = f"""SELECT c_.*, {_num('n_error')} AS error_count, {_num(MEAN)} AS avg_assistant_response_time_ms
FROM c_ LEFT JOIN k_ ON k = id{_where(only and f"user_id = {only}")}"""
    return _with(rows if limit is None else _page(rows, "last_message_at", limit), PER_CONVERSATION)


_WITH_NAMES = """,
cu AS (SELECT c_.*, display_name, email, ms_user_id FROM u_ RIGHT JOIN c_ ON c_.user_id = u_.id)"""


def _on_days(column: str, first=None, last=None) -> str | None:
    if first is None and last is None:
        return None
    return f"CAST({column} AS DATE) BETWEEN DATE '{first or '0001-01-01'}' AND DATE '{last or '9999-12-31'}'"


def _conversation_rules(user_id=None, search=None, date_from=None, date_to=None, has_error=None) -> str:
    failed = "id IN (SELECT conversation_id FROM m_ WHERE error IS NOT NULL AND conversation_id IS NOT NULL)"
    return _where(_on_days("started_at", date_from, date_to), search and _names_like(search),
                  user_id and f"user_id = {user_id}",
                  None if has_error is None else f"({failed}) = {str(has_error).lower()}")


def _conversations(limit=50, offset=0, **rules) -> str:
    rows = f"""SELECT cu.*, {_num('n_error')} AS error_count, {_num(MEAN)} AS avg_assistant_response_time_ms,
  t_error AS last_error_at
FROM cu LEFT JOIN k_ ON k = id{_conversation_rules(**rules)}"""
    return _with(_page(rows, "last_message_at", limit, offset), _WITH_NAMES, PER_CONVERSATION)


def _conversations_total(**rules) -> str:
    return _with(f"SELECT count(id) AS total FROM cu{_conversation_rules(**rules)}", _WITH_NAMES)


def _conversation_detail(only: int | None = None) -> str:
    return _with(f"""SELECT cu.* EXCLUDE (last_message_at), t_first AS first_message_at, t_last AS last_message_at,
  {_num('n')} AS total_messages, {_num('n_user')} AS user_messages, {_num('n_assistant')} AS assistant_messages,
  {_num('n_error')} AS error_count, {_num(MEAN)} AS avg_assistant_response_time_ms
FROM cu LEFT JOIN k_ ON k = id{_where(only and f"id = {only}")}""", _WITH_NAMES, PER_CONVERSATION)


# -------------------------------------------------------------- messages ---
def _mentions(q: str) -> str:
    """The text, the error or a tool's name holds ``q``, whatever the case."""
    return f"len(list_filter(list_concat([content, error], ifnull(tools_used, [])), lambda x: instr(lower(x), {_quoted(q.lower())}) > 0)) > 0"


def _conversation_messages(q: str = "", only: int | None = None, role: str | None = None, errors_only: bool = False) -> str:
    marked = f"regexp_replace(content, {_quoted(f'({q})')}, '==\\1==', 'gi')" if q else "content"
    return _with(f"""SELECT *, {marked} AS highlighted, array_to_string(tools_used, ', ') AS tools_text
FROM m_{_where(q and _mentions(q), only and f"conversation_id = {only}", role and f"role = '{role}'",
               "length(error) > 0" if errors_only else None)}""")


def _match_counts(q: str, role: str) -> str:
    return _with(f"""SELECT conversation_id, sum(n)::BIGINT AS total_messages, sum(n * hit)::BIGINT AS matching_messages,
  sum(n * failed)::BIGINT AS error_messages
FROM (SELECT conversation_id, CAST({_mentions(q)} AND role = '{role}' AS INT) AS hit,
        CAST(ifnull(length(error), 0) > 0 AS INT) AS failed, count(*) AS n FROM m_ GROUP BY ALL)
WHERE conversation_id IS NOT NULL GROUP BY conversation_id""")


def _message_rules(conversation_id=None, role=None, has_error=None, search=None, date_from=None, date_to=None) -> str:
    return _where(_on_days("timestamp", date_from, date_to), role and f"role = '{role}'",
                  conversation_id and f"conversation_id = {conversation_id}",
                  search and f"lower(content) LIKE {_quoted('%' + search.lower() + '%')}",
                  None if has_error is None else f"(error IS NOT NULL) = {str(has_error).lower()}")


def _messages(limit=100, offset=0, **rules) -> str:
    cut = _page(f"SELECT * FROM m_{_message_rules(**rules)}", "timestamp", limit, offset)
    return _with(f"SELECT pg.*, display_name, email, ms_user_id FROM ({cut}) pg LEFT JOIN cu ON cu.id = pg.conversation_id",
                 _WITH_NAMES)


def _messages_total(**rules) -> str:
    return _with(f"SELECT count(id) AS total FROM m_{_message_rules(**rules)}")


# ---------------------------------------------------------------- labels ---
# The wording of relative times (now, minutes, hours, yesterday, days).
WORDS = {
    "en": ("just now", "{} minutes ago", "{} hours ago", "yesterday", "{} days ago"),
    "de": ("gerade eben", "vor {} Minuten", "vor {} Stunden", "gestern", "vor {} Tagen"),
}


def _minutes(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 60e6) AS BIGINT)"


def _ago(ts: str, lang: str, yesterday: bool = True) -> str:
    """The first wording whose limit, in minutes, has not been reached."""
    now, minutes, hours, one_day, days = WORDS[lang]
    steps = [(1, now, 1), (60, minutes, 1), (1440, hours, 60)] + ([(2880, one_day, 1)] if yesterday else [])
    m = _minutes(ts, NOW)
    arms = " ".join(f"WHEN {m} < {limit} THEN format('{text}', {m} // {unit})" for limit, text, unit in steps)
    return f"CASE {arms} ELSE format('{days}', {m} // 1440) END"


def _latency(ms: str) -> str:
    # printf rounds the binary value, but exact ties (.25, .75) to the even digit, not up
    return (f"CASE WHEN {ms} < 1000 THEN concat({ms}, 'ms') ELSE "
            f"printf('%.1fs', CAST({ms} + CASE WHEN {ms} % 500 = 250 THEN 50 ELSE 0 END AS DOUBLE) / 1000) END")


def _or(*columns_and_default: str) -> str:
    """The first text that is not empty."""
    *columns, default = columns_and_default
    return f"list_filter([{', '.join(columns)}, '{default}'], lambda x: length(x) > 0)[1]"


def _shown(base: str, **labels: str) -> str:
    return f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in labels.items())} FROM ({base})"


def _badge(n: str) -> str:
    return f"['success', 'error'][1 + CAST({n} > 0 AS INT)]"


def _conversation_labels(base: str, lang: str) -> str:
    span = _minutes("started_at", "last_message_at")
    return _shown(base, user_label=_or("display_name", "Unknown"),
                  avg_response_label="CASE avg_assistant_response_time_ms WHEN 0 THEN '—' ELSE concat(avg_assistant_response_time_ms, 'ms') END",
                  duration_label=f"CASE {span} // 60 WHEN 0 THEN replace(concat({span}, ' min'), '0 min', CASE {span} WHEN 0 THEN '< 1 min' ELSE '0 min' END) "
                                 f"ELSE format('{{}}h {{}}m', {span} // 60, {span} % 60) END",
                  last_message_label=_ago("last_message_at", lang))


def label_views(cases: dict) -> dict[str, str]:
    facts = cases["users_page_facts"]
    size, skipped = facts["limit"], facts["offset"]
    page = skipped // size + 1
    return {
        "dashboard_cards": _shown(KPI_STATS, last_activity_label=_ago("last_message_at", "en", False),
                                  avg_response_label=_latency("avg_response_time_ms_7d"),
                                  p95_response_label=_latency("p95_response_time_ms_7d"), errors_status=_badge("errors_24h")),
        "conversations_page_view": _conversation_labels(_conversations(), "de"),
        "conversation_labels_de": _shown(_with("SELECT id, last_message_at FROM c_"), last_message_label=_ago("last_message_at", "de")),
        "conversation_labels_en": _shown(_with("SELECT id, last_message_at FROM c_"), last_message_label=_ago("last_message_at", "en")),
        "conversation_header": _shown(_conversation_detail(), user_label=_or("display_name", "email", "Unknown User")),
        "users_page_view": _shown(_users(limit=50), name_label=_or("display_name", "—"), email_label=_or("email", "—"),
                                  error_badge=_badge("error_count")),
        "errors_page_view": _shown(_messages(limit=50, has_error=True), user_label=_or("display_name", "—"),
                                   content_preview="concat(left(content, 100), '...')"),
        "activity_hourly_view": _shown(HOURLY, hour_label="left(CAST(CAST(bucket AS TIME) AS VARCHAR), 5)"),
        "users_page_facts": f"""SELECT total, {size}::INTEGER AS "limit", {skipped}::INTEGER AS "offset",
  {page}::BIGINT AS current_page, (total + {size - 1}) // {size} AS total_pages, {skipped + 1}::BIGINT AS first_row,
  CASE WHEN total < {skipped + size} THEN total ELSE {skipped + size} END AS last_row,
  {page} > 1 AS has_previous, total > {skipped + size} AS has_next
FROM ({_users_total(facts['search'])})""",
    }


# --------------------------------------------------------------- quality ---
_UNIQUE = (("users", "fu", "id"), ("users", "fu", "ms_user_id"), ("conversations", "fc", "id"),
           ("conversations", "fc", "thread_id"), ("messages", "fm", "id"))
_REQUIRED = (("users", "fu", ("id", "ms_user_id")), ("conversations", "fc", ("id", "thread_id")),
             ("messages", "fm", ("id", "role", "content")))
# key values, with the place of each row among those of the same value
_KEYS = ",\nkeys AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_column, CAST({k} AS VARCHAR) AS key_value, "
    f"row_number() OVER (PARTITION BY {k}) AS nth FROM {cte} WHERE {k} IS NOT NULL" for t, cte, k in _UNIQUE) + ")"


def quality_checks(cases: dict) -> dict[str, str]:
    day = cases["cascade"]["started_before"]
    return {
        "dq_duplicate_keys": _with("SELECT table_name, key_column, key_value, max(nth) AS occurrences FROM keys "
                                   "GROUP BY ALL HAVING max(nth) > 1", FAULTY_CTES, _KEYS),
        "dq_duplicate_key_summary": _with(
            "SELECT table_name, key_column, count(CASE nth WHEN 1 THEN 1 END) AS distinct_keys, "
            "count(CASE nth WHEN 2 THEN 1 END) AS duplicated_keys, count(CASE WHEN nth > 1 THEN 1 END) AS extra_rows "
            "FROM keys GROUP BY ALL", FAULTY_CTES, _KEYS),
        "dq_required_nulls": _with(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_rows FROM {cte}"
            for t, cte, cols in _REQUIRED for c in cols), FAULTY_CTES),
        "dq_orphans": _with("""SELECT 'conversations.user_id' AS foreign_key, count(user_id) AS orphan_rows
FROM fc ANTI JOIN fu ON fu.id = fc.user_id
UNION ALL SELECT 'messages.conversation_id', count(conversation_id) FROM fm ANTI JOIN fc ON fc.id = fm.conversation_id""", FAULTY_CTES),
        "dq_orphan_conversations": _with("SELECT * FROM fc ANTI JOIN fu ON fu.id = fc.user_id WHERE user_id IS NOT NULL", FAULTY_CTES),
        "dq_orphan_messages": _with("SELECT * FROM fm ANTI JOIN fc ON fc.id = fm.conversation_id "
                                    "WHERE conversation_id IS NOT NULL", FAULTY_CTES),
        "dq_cascade_messages": _with(f"SELECT * FROM m_ ANTI JOIN (SELECT id AS gone FROM c_ WHERE CAST(started_at AS DATE) < DATE '{day}') "
                                     "ON gone = conversation_id"),
        "dq_counter_audit": _with(f"""SELECT id, message_count AS stored_message_count, {_num('n')} AS counted_messages,
  last_message_at AS stored_last_message_at, t_last AS recomputed_last_message_at,
  message_count <> {_num('n')} AS count_mismatch, ifnull(last_message_at <> t_last, true) AS last_message_mismatch
FROM c_ LEFT JOIN k_ ON k = id WHERE message_count <> {_num('n')} OR ifnull(last_message_at <> t_last, true)""", PER_CONVERSATION),
    }


# ------------------------------------------------------------- streaming ---
def streaming() -> dict[str, str]:
    hour = "time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket"
    return {
        "stream_activity_buckets": _with(f"SELECT {hour}, count(id) AS messages, count(error) AS errors FROM m_ GROUP BY ALL"),
        "stream_tool_buckets": _with(f"""SELECT {hour}, tools_used[p.i] AS tool, count(*) AS count
FROM m_ JOIN range(1, 1 + (SELECT max(len(tools_used)) FROM m_)) p(i) ON p.i <= len(tools_used) GROUP BY ALL"""),
        "stream_activity_hourly": HOURLY,
        "stream_activity_daily": DAILY,
        "stream_top_tools": TOP_TOOLS,
        "stream_conversation_rollup": _with(f"""SELECT k AS conversation_id, n AS total_messages, n_user::BIGINT AS user_messages,
  n_assistant::BIGINT AS assistant_messages, n_error AS error_count, ms_sum AS latency_sum, ms_n AS latency_count,
  t_first AS first_message_at, t_last AS last_message_at, t_error AS last_error_at,
  CAST({MEAN} AS BIGINT) AS avg_assistant_response_time_ms FROM k_""", PER_CONVERSATION),
        # rows that come late for any watermark are in these answers too
        "stream_late_activity_hourly": HOURLY,
        "stream_late_activity_daily": DAILY,
        "stream_late_top_tools": TOP_TOOLS,
        "stream_late_conversation_rollup": _with(f"""SELECT k AS conversation_id, n AS total_messages, n_user::BIGINT AS user_messages,
  n_assistant::BIGINT AS assistant_messages, n_error AS error_count, t_first AS first_message_at, t_last AS last_message_at,
  t_error AS last_error_at, CAST({MEAN} AS BIGINT) AS avg_assistant_response_time_ms FROM k_""", PER_CONVERSATION),
        "stream_dedup_messages": _with("SELECT * FROM m_"),
    }


#: Reports that are also registered over the stored layout, whose answers are those of the tables.
STORED = ("kpi_stats", "table_health", "users_page", "users_page_deep", "users_page_search", "user_by_id", "user_conversations_by_id",
          "conversations_page", "conversations_page_deep", "conversations_page_filtered", "conversations_page_of_user", "conversation_detail",
          "messages_page", "messages_page_deep", "messages_page_filtered", "messages_total_filtered", "errors_page", "errors_total_filtered", "dq_duplicate_keys")


def oracle_sql(cases: dict) -> dict[str, str]:
    """Oracle text per registered query; ``cases`` holds the shared parameters."""
    texts = _oracle_sql(cases)
    return texts | {f"stored_{name}": texts[name] for name in STORED}


def _oracle_sql(cases: dict) -> dict[str, str]:
    searched = cases["users_search"]["search"]
    listed, clean, found = (cases[k] for k in ("conversations_filtered", "conversations_no_errors", "conversations_search"))
    texts, failed = cases["messages_filtered"], cases["errors_filtered"]
    detail, drill = cases["conversation_search"], cases["drill"]
    user, conversation = drill["user_id"], drill["conversation_id"]

    def cut(case: dict) -> dict:
        return {"limit": case["limit"], "offset": case["offset"], **case["filters"]}

    return {
        "activity_hourly": HOURLY,
        "activity_daily": DAILY,
        "kpi_stats": KPI_STATS,
        "table_health": TABLE_HEALTH,
        "top_tools": TOP_TOOLS,
        "top_tools_ranked": TOP_TOOLS_RANKED,
        "users_page": _users(limit=50),
        "users_total": _users_total(),
        "users_page_search": _users(searched, limit=50),
        "users_total_search": _users_total(searched),
        "users_page_deep": _users(**cases["users_deep"]),
        "user_detail": _users(),
        "user_by_id": _users(only=user),
        "user_by_id_missing": _users(only=-1),
        "user_conversations": _user_conversations(),
        "user_conversations_page": _user_conversations(limit=25),
        "user_conversations_by_id": _user_conversations(only=user, limit=25),
        "conversations_page": _conversations(),
        "conversations_page_deep": _conversations(**cases["conversations_deep"]),
        "conversations_total": _conversations_total(),
        "conversations_page_filtered": _conversations(**cut(listed)),
        "conversations_total_filtered": _conversations_total(**listed["filters"]),
        "conversations_page_no_errors": _conversations(**cut(clean)),
        "conversations_total_no_errors": _conversations_total(**clean["filters"]),
        "conversations_page_search": _conversations(**cut(found)),
        "conversations_total_search": _conversations_total(**found["filters"]),
        "conversations_page_of_user": _conversations(user_id=user),
        "conversation_detail": _conversation_detail(),
        "conversation_by_id": _conversation_detail(conversation),
        "conversation_by_id_missing": _conversation_detail(-1),
        "conversation_messages": _conversation_messages(detail["query"]),
        "conversation_messages_by_id": _conversation_messages(detail["query"], conversation),
        "conversation_messages_errors": _conversation_messages(role=detail["role"], errors_only=True),
        "conversation_match_counts": _match_counts(detail["query"], detail["role"]),
        "messages_page": _messages(),
        "messages_page_deep": _messages(**cases["messages_deep"]),
        "messages_total": _messages_total(),
        "messages_page_filtered": _messages(**cut(texts)),
        "messages_total_filtered": _messages_total(**texts["filters"]),
        "messages_page_of_conversation": _messages(conversation_id=conversation),
        "errors_page": _messages(limit=50, has_error=True),
        "errors_total": _messages_total(has_error=True),
        "errors_page_filtered": _messages(has_error=True, **cut(failed)),
        "errors_total_filtered": _messages_total(has_error=True, **failed["filters"]),
        **label_views(cases),
        **quality_checks(cases),
        **streaming(),
    }
