"""Registered usage-event queries (step 6: F12-F19, X1, K5, A12-A16, C14, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.sanitize import sanitize_metadata
from ledgerspark.functions.text import DIGIT_BLOB_PATTERN, clean_text, looks_sensitive_text
from ledgerspark.operators import events as E
from ledgerspark.plans.registry import register
from ledgerspark.plans.sqlviews import USAGE_EVENTS, with_
from ledgerspark.session import staging_path
from ledgerspark.sources.events import read_event_batches
from ledgerspark.sources.tables import read_table, usage_events

TS_FMT = E.ISO_MICROS
TS_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(c: str):
    return F.date_format(c, TS_FMT).alias(c)


def _ts_sql(c: str) -> str:
    return TS_SQL.format(c) + f" AS {c}"


_SESSION_SQL = """sess AS (
  SELECT session_id, arg_min(user_id, (ts, event_id)) AS user_id, min(ts) AS started_at,
         max(ts) FILTER (WHERE event_type = 'session_ended') AS ended_at, COUNT(*) AS event_count,
         arg_min(page, (ts, event_id)) FILTER (WHERE COALESCE(page, '') <> '') AS first_page,
         arg_max(page, (ts, event_id)) FILTER (WHERE COALESCE(page, '') <> '') AS last_page,
         max(ts) AS last_event_at
  FROM {src} GROUP BY session_id)"""
_SESSION_COLS = f"""session_id, user_id, {_ts_sql('started_at')}, {_ts_sql('ended_at')},
  greatest(CAST(epoch_us(COALESCE(ended_at, last_event_at)) - epoch_us(started_at) AS DOUBLE) / CAST(1000000 AS DOUBLE), 0.0)
  AS duration_seconds, event_count, first_page, last_page, {_ts_sql('last_event_at')}"""


def _sessions_out(df):
    return df.select("session_id", "user_id", _ts("started_at"), _ts("ended_at"), "duration_seconds", "event_count",
                     "first_page", "last_page", _ts("last_event_at"))


@register("session_summary", with_(USAGE_EVENTS, _SESSION_SQL.format(src="usage")) + f"SELECT {_SESSION_COLS} FROM sess")
def session_summary(spark, sf):
    return _sessions_out(E.session_summary(usage_events(spark, sf)))


@register("top_events", with_(USAGE_EVENTS) + """
SELECT event_type, component, COUNT(*) AS count FROM usage GROUP BY 1, 2
ORDER BY count DESC, event_type, component NULLS FIRST LIMIT 10""")
def top_events(spark, sf):
    return E.top_events(usage_events(spark, sf), 10)


@register("feature_usage", with_(USAGE_EVENTS) + """
SELECT page, component, event_type, COUNT(*) AS count FROM usage
WHERE event_type NOT IN ('session_started', 'session_ended', 'page_view') GROUP BY 1, 2, 3
ORDER BY count DESC, page NULLS FIRST, component NULLS FIRST, event_type LIMIT 20""")
def feature_usage(spark, sf):
    return E.feature_usage(usage_events(spark, sf), 20)


def _truthy_sql(md: str, key: str) -> str:
    t = f"json_type({md}, '$.{key}')"
    s = f"json_extract_string({md}, '$.{key}')"
    return (f"CASE WHEN {s} IS NULL OR ({t} = 'VARCHAR' AND {s} = '') OR ({t} = 'BOOLEAN' AND {s} = 'false') "
            f"OR ({t} = 'ARRAY' AND {s} = '[]') OR ({t} = 'OBJECT' AND {s} = '{{}}') "
            f"OR ({t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND TRY_CAST({s} AS DOUBLE) = 0) THEN NULL ELSE {s} END")


def _first_truthy(md: str, *keys: str) -> str:
    return "COALESCE(" + ", ".join(_truthy_sql(md, k) for k in keys) + ", '')"


@register("filters_common", with_(USAGE_EVENTS) + f"""
SELECT filter, value, COUNT(*) AS count FROM (
  SELECT substr(trim({_first_truthy('metadata_json', 'filter', 'field', 'name')}), 1, 64) AS filter,
         substr(trim({_first_truthy('metadata_json', 'value', 'selected', 'state')}), 1, 80) AS value
  FROM usage WHERE event_type = 'filter_changed')
WHERE filter <> '' AND value <> '' GROUP BY 1, 2""")
def filters_common(spark, sf):
    return E.common_filters(usage_events(spark, sf))


@register("sorts_common", with_(USAGE_EVENTS) + f"""
SELECT sort, CASE WHEN direction = '' THEN 'asc' ELSE direction END AS direction, COUNT(*) AS count FROM (
  SELECT substr(trim({_first_truthy('metadata_json', 'sort', 'sortby', 'sort_by')}), 1, 64) AS sort,
         substr(trim({_first_truthy('metadata_json', 'direction', 'sortdir', 'sort_dir')}), 1, 32) AS direction
  FROM usage WHERE event_type = 'sort_changed')
WHERE sort <> '' GROUP BY 1, 2""")
def sorts_common(spark, sf):
    return E.common_sorts(usage_events(spark, sf))


@register("search_trends", with_(USAGE_EVENTS) + f""",
s AS (SELECT substr(trim({_first_truthy('metadata_json', 'query', 'term', 'search')}), 1, 120) AS query,
             event_type, session_id, ts,
             event_type = 'search_submitted' AND COALESCE(
               json_type(metadata_json, '$.resultcount') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
               AND abs(CAST(json_extract_string(metadata_json, '$.resultcount') AS DOUBLE)) < 1, FALSE) AS zero_flag
      FROM usage WHERE event_type IN ('search_submitted', 'search_zero_results', 'search_abandoned')),
g AS (SELECT query, count_if(event_type = 'search_submitted') AS submitted,
             count_if(event_type = 'search_zero_results') + count_if(zero_flag) AS zero_results,
             count_if(event_type = 'search_abandoned') AS abandoned, max(ts) AS last_seen,
             COUNT(DISTINCT session_id) AS session_count
      FROM s WHERE query <> '' GROUP BY 1)
SELECT query, submitted, zero_results, abandoned,
       CASE WHEN submitted > 0 THEN round(zero_results / submitted, 3) ELSE 0.0 END AS zero_result_rate,
       CASE WHEN submitted > 0 THEN round(abandoned / submitted, 3) ELSE 0.0 END AS abandonment_rate,
       {_ts_sql('last_seen')}, session_count
FROM g ORDER BY submitted DESC, zero_results DESC, query LIMIT 20""")
def search_trends(spark, sf):
    return E.search_trends(usage_events(spark, sf), 20).withColumn("last_seen", F.date_format("last_seen", TS_FMT))


@register("session_flows", with_(USAGE_EVENTS, _SESSION_SQL.format(src="usage")) + f""",
top AS (SELECT * FROM sess ORDER BY last_event_at DESC, session_id LIMIT 20)
SELECT u.session_id, {TS_SQL.format('u.ts')} AS ts, u.event_id, u.event_type, u.page,
       top.user_id, top.event_count, {TS_SQL.format('top.last_event_at')} AS last_event_at
FROM usage u JOIN top ON u.session_id = top.session_id""")
def session_flows(spark, sf):
    out = E.session_flows(usage_events(spark, sf), limit=20)
    return out.select("session_id", _ts("ts"), "event_id", "event_type", "page", "user_id", "event_count",
                      _ts("last_event_at"))


def _raw_meta_spark():
    k = F.get_json_object("props", "$.k").cast("int")
    return F.concat(
        F.lit('{"Search Term":"q'), k.cast("string"), F.lit('","resultCount":'), (k % 4).cast("string"),
        F.lit(',"apiKey":"abc'), k.cast("string"), F.lit('","Contact":"'), (F.col("user_id") * 100003).cast("string"),
        F.lit('","Note":"  v'), F.col("value").cast("string"), F.lit('  "}'))


@register("sanitize_metadata", with_(USAGE_EVENTS) + f""",
r AS (SELECT event_id, CAST(user_id AS BIGINT) AS uid, k, value FROM ev0),
c AS (SELECT event_id, k, value, CAST(uid * 100003 AS VARCHAR) AS contact FROM r)
SELECT CAST(event_id AS VARCHAR) AS event_id,
  '{{"apikey":"[redacted]","contact":"' ||
  CASE WHEN regexp_matches(contact, '{DIGIT_BLOB_PATTERN}') THEN '[redacted]' ELSE contact END ||
  '","note":"v' || CAST(value AS VARCHAR) || '","resultcount":' || CAST(k % 4 AS VARCHAR) ||
  ',"search_term":"q' || CAST(k AS VARCHAR) || '"}}' AS metadata_json
FROM c""")
def sanitize_metadata_q(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select(F.col("event_id").cast("string").alias("event_id"),
                     sanitize_metadata(_raw_meta_spark()).alias("metadata_json"))


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@register("sanitize_text", f"""
SELECT conv_id, turn, role,
       length(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '{_WS}', ' ', 'g'))) AS clean_chars,
       regexp_matches(text, '{DIGIT_BLOB_PATTERN}') OR regexp_matches(text, '\\b[^@\\s]+@[^@\\s]+\\.[^@\\s]+\\b') AS sensitive
FROM conversations""")
def sanitize_text(spark, sf):
    conv = read_table(spark, sf, "conversations")
    cleaned = clean_text("text", limit=2_000_000_000)
    return conv.select("conv_id", "turn", "role", F.length(cleaned).alias("clean_chars"),
                       looks_sensitive_text("text").alias("sensitive"))


def _resent(spark, sf):
    """The usage events plus a re-sent copy of every fifth event with another page (seq 1)."""
    ev = usage_events(spark, sf).withColumn("seq", F.lit(0))
    again = (ev.filter(F.col("event_id").cast("bigint") % 5 == 0)
             .withColumn("page", F.lit("/resent")).withColumn("seq", F.lit(1)))
    return ev.unionByName(again)


_RESENT_SQL = """resent AS (
  SELECT *, 0 AS seq FROM usage
  UNION ALL SELECT event_id, user_id, session_id, event_type, page_new AS page, component, metadata_json, ts, value, 1 AS seq
  FROM (SELECT *, '/resent' AS page_new FROM usage WHERE CAST(event_id AS BIGINT) % 5 = 0)),
dedup AS (SELECT * FROM resent QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1)"""


@register("event_upsert", with_(USAGE_EVENTS, _RESENT_SQL) + f"""
SELECT event_id, session_id, event_type, page, {_ts_sql('ts')} FROM dedup""")
def event_upsert(spark, sf):
    out = E.dedupe_events(_resent(spark, sf), "seq")
    return out.select("event_id", "session_id", "event_type", "page", _ts("ts"))


@register("event_upsert_sessions", with_(USAGE_EVENTS, _RESENT_SQL, _SESSION_SQL.format(src="dedup"))
          + f"SELECT {_SESSION_COLS} FROM sess")
def event_upsert_sessions(spark, sf):
    return _sessions_out(E.session_summary(E.dedupe_events(_resent(spark, sf), "seq")))


@register("session_sample", with_(USAGE_EVENTS) + """
SELECT event_id, session_id, event_type FROM usage
WHERE CAST('0x' || substr(md5(session_id), 1, 7) AS BIGINT) % 10000 < 2500""")
def session_sample(spark, sf):
    return E.sample_sessions(usage_events(spark, sf), 0.25).select("event_id", "session_id", "event_type")


@register("numbered_flows", with_(USAGE_EVENTS, _SESSION_SQL.format(src="usage")) + f"""
SELECT session_id, event_id, event_type, page, {_ts_sql('ts')},
       row_number() OVER w AS position,
       CASE WHEN COALESCE(page, '') <> '' THEN (SUM(CASE WHEN COALESCE(page, '') <> '' THEN 1 ELSE 0 END) OVER w)::BIGINT END AS page_position
FROM usage WHERE session_id IN (SELECT session_id FROM sess ORDER BY last_event_at DESC, session_id LIMIT 150)
WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)""")
def numbered_flows(spark, sf):
    """C14 with positions, beyond the default limit: the 150 latest sessions."""
    ev = usage_events(spark, sf)
    return E.numbered_flows(ev, limit=150).select("session_id", "event_id", "event_type", "page", _ts("ts"),
                                                  F.col("position").cast("bigint").alias("position"), "page_position")


# ---- S12, F14: events as they are posted ---------------------------------------------------

def _posted(spark, sf):
    """Posted documents, one a line, in two folders of files: the usage events by session, and a fifth of
    them sent again. Every fifth has no id, aliases alternate, every eleventh has a broken time."""
    n = F.col("event_id").cast("bigint")
    ev = usage_events(spark, sf)
    user, session = F.col("user_id"), F.col("session_id")
    event = F.struct(
        F.when(n % 5 != 0, F.col("event_id")).alias("eventId"),
        F.when(n % 3 == 0, user).alias("userId"), F.when(n % 3 != 0, user).alias("user_id"),
        F.when(n % 2 == 0, session).alias("sessionId"), F.when(n % 2 != 0, session).alias("session_id"),
        F.col("event_type").alias("eventType"), "page", "component",
        F.when(n % 11 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"))
    doc = F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("value")
    path = staging_path(spark, "posted")
    ev.groupBy("session_id").agg(doc).select("value").write.text(f"{path}/first")
    again = ev.filter(n % 5 == 0).groupBy("user_id").agg(doc).select("value")
    again.unionByName(spark.createDataFrame([('{"events": {}}',), ("no json",)], "value string")).write.text(f"{path}/again")
    raw, rejected = read_event_batches(spark, [f"{path}/first", f"{path}/again"], lines=True)
    return raw, rejected


@register("normalize_events", with_(USAGE_EVENTS) + f"""
SELECT DISTINCT CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN 'hashed' ELSE event_id END AS event_id,
       user_id, session_id, event_type, page, component, {_ts_sql('ts')}
FROM usage WHERE CAST(event_id AS BIGINT) % 11 <> 0""")
def normalize_events(spark, sf):
    """An event without an id that is sent twice, in two files, is one event."""
    events = E.dedupe_events(E.normalize_events(_posted(spark, sf)[0]))
    hashed = F.length("event_id") == 64
    return events.select(F.when(hashed, "hashed").otherwise(F.col("event_id")).alias("event_id"), "user_id", "session_id",
                         "event_type", "page", "component", _ts("ts"))


@register("event_quarantine", with_(USAGE_EVENTS) + """
SELECT session_id, event_type, 'not a time' AS given_ts, 'unparsable timestamp' AS reason
FROM usage WHERE CAST(event_id AS BIGINT) % 11 = 0
UNION ALL SELECT session_id, event_type, 'not a time', 'unparsable timestamp'
FROM usage WHERE CAST(event_id AS BIGINT) % 55 = 0
UNION ALL SELECT NULL, NULL, NULL, 'events must be a list' FROM range(2)""")
def event_quarantine(spark, sf):
    """What can't be taken in: events with a broken time, and documents without a list of events."""
    raw, rejected = _posted(spark, sf)
    none = F.lit(None).cast("string")
    return E.rejected_events(raw).select("session_id", "event_type", "given_ts", "reason").unionByName(
        rejected.select(none.alias("session_id"), none.alias("event_type"), none.alias("given_ts"), "reason"))
