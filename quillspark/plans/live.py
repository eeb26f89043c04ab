"""Queries on events: the batch twins of the streaming rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ledgers as led
from .registry import query


def _repeats(keys: str, millis: int, rows: str, opens: bool = False) -> str:
    """Rows of a key in order of time, each against the last one that was no repeat (and opens)."""
    start = lambda row, last: f"CASE WHEN {row}.opens THEN {row}.ms ELSE {last} END" if opens else f"{row}.ms"
    same = " AND ".join(f"e.{k} = f.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms, event_id) AS i FROM ({rows})),
f AS (SELECT {keys}, event_id, ms, i, {start('e', 'NULL')} AS last, false AS repeat FROM e WHERE i = 1
  UNION ALL SELECT {", ".join(f"e.{k}" for k in keys.split(", "))}, e.event_id, e.ms, e.i, CASE WHEN e.ms - f.last < {millis} THEN f.last ELSE {start('e', 'f.last')} END, coalesce(e.ms - f.last < {millis}, false) FROM f JOIN e ON {same} AND e.i = f.i + 1)"""


@query("str1_progress", "SELECT paper_id, max(progress) AS progress, max_by(scroll_position, {'t': ts, 'e': event_id}) AS scroll_position, max_by(last_section, {'t': ts, 'e': event_id}) AS last_section, CASE WHEN max(progress) >= 100 THEN 'done' ELSE 'reading' END AS status FROM f_progress GROUP BY paper_id")
def _(t):
    return led.progress(t("f_progress"))


@query("str2_windowed_totals", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, provider, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, count(*) AS calls FROM f_usage GROUP BY ALL")
def _(t):
    return led.windowed_totals(t("f_usage"), "1 day")


@query("str3_cache_hits", _repeats("query_norm, source", 24 * 3_600_000, "SELECT query_norm, source, event_id, epoch_us(ts) // 1000 AS ms FROM f_search_log") + " SELECT event_id, repeat AS hit FROM f")
def _(t):
    return led.cached(t("f_search_log"))


@query("str4_cooldown", "SELECT event_id, coalesce(ts < last + INTERVAL 60 SECOND, false) AS skipped FROM (SELECT event_id, ts, max(CASE WHEN status = 429 THEN ts END) OVER (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f_search_log)")
def _(t):
    return led.cooling(t("f_search_log")).select("event_id", "skipped")


@query("str5_idle_sessions", "SELECT min(ts) AS start, max(ts) + INTERVAL 90 SECOND AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 90 SECOND THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _(t):
    return led.sessions(t("events"))


@query("str6_pending_sources", "SELECT query_norm, array_to_string(list_sort(list_filter(['click', 'nowhere', 'view'], lambda x: NOT list_contains(list(DISTINCT source), x))), ',') AS pending, false AS final FROM f_search_log GROUP BY query_norm")
def _(t):
    return led.pending_sources(t("f_search_log"), ["view", "click", "nowhere"])


@query("str7_run_totals", "SELECT task, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM f_usage GROUP BY task")
def _(t):
    return led.run_totals(t("f_usage"))


@query("str11_throttled", _repeats("key", 600, "SELECT CAST(user_id AS BIGINT) AS key, event_id, epoch_us(ts) // 1000 AS ms FROM events") + " SELECT key, event_id, ms AS \"at\" FROM f WHERE NOT repeat")
def _(t):
    return led.throttled(t("events"), "user_id")


@query("str12_distinct_requests", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return led.distinct_requests(t("events"), ["user_id", "event_type"]).select("user_id", "event_type")


# turns of users on papers: every seventh event ends a round, every third one has a language
_STATES = "SELECT event_id, ts, user_id % 40 AS paper_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'zh' ELSE 'ja' END END AS lang, CASE WHEN event_id % 7 = 0 THEN 'done' ELSE event_type END AS state FROM {events}"


@query("str8_current_only", _repeats("paper_id", 24 * 3_600_000, f"SELECT paper_id, event_id, state = 'done' AS opens, epoch_us(ts) // 1000 AS ms FROM ({_STATES.replace('{events}', 'events')}) WHERE paper_id % 4 <> 0 AND (lang IS NULL OR lang = CASE WHEN paper_id % 2 = 0 THEN 'zh' ELSE 'ja' END)", opens=True) + " SELECT paper_id, event_id FROM f WHERE NOT repeat")
def _(t):
    events = t("events")
    made = events.sparkSession.sql(_STATES, events=events)
    current = made.where("paper_id % 4 <> 0").select("paper_id", F.when(F.col("paper_id") % 2 == 0, "zh").otherwise("ja").alias("lang")).distinct()
    return led.current_only(made, current)
