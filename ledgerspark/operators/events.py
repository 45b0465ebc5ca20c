"""Usage events: F14 normalize, K5 dedupe by id, A12 sessions, A13-A16 reports, C14 flows,
T4 session sampling.

Metadata lookups parse the JSON once into a VARIANT and read typed values from it, so the
reference's "falsy value falls through to the next alias" rule (0, false, '', null, [], {})
is exact and stays in the JVM.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.sanitize import sanitize_metadata
from ledgerspark.functions.text import clean_text, normalize_key
from ledgerspark.session import staging_path

SEARCH_EVENTS = ("search_submitted", "search_zero_results", "search_abandoned")
NON_FEATURE_EVENTS = ("session_started", "session_ended", "page_view")
ISO_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _first(df: DataFrame, *names: str) -> Column:
    """First truthy of several optional raw fields (missing columns are skipped)."""
    cols = []
    for n in names:
        if n in df.columns:
            c = F.col(n).cast("string")
            cols.append(F.when(c != "", c))
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


READING = ("file", "seq", "arrival")  # where an event was read, no part of what was sent


def _event_columns(raw: DataFrame) -> DataFrame:
    """F14 over raw events, with the given time as text (``__given``) beside the parsed one."""
    payload = F.to_json(F.struct(*[F.col(c) for c in raw.columns if c not in READING]))
    event_id = clean_text(F.coalesce(_first(raw, "eventId", "event_id"), F.sha2(payload, 256)), 64)
    user = clean_text(F.coalesce(_first(raw, "userId", "user_id"), F.lit("anonymous")), 64)
    session = clean_text(F.coalesce(_first(raw, "sessionId", "session_id"),
                                    F.concat(F.lit("s-"), F.sha2(payload, 256))), 64)
    etype = normalize_key(F.coalesce(_first(raw, "eventType", "event_type"), F.lit("interaction")))
    page = clean_text(F.coalesce(_first(raw, "page"), F.lit("/")), 120)
    comp = _first(raw, "component")
    meta = F.col("metadata").cast("string") if "metadata" in raw.columns else F.lit(None).cast("string")
    given = clean_text(_first(raw, "ts", "timestamp"), 64)
    parsed = F.try_to_timestamp(F.regexp_replace(given, "Z$", "+00:00"))
    return raw.select(
        event_id.alias("event_id"),
        F.when(user == "", "anonymous").otherwise(user).alias("user_id"),
        session.alias("session_id"),
        F.when(etype == "", "interaction").otherwise(etype).alias("event_type"),
        F.when(page == "", "/").otherwise(page).alias("page"),
        F.when(comp.isNotNull(), clean_text(comp, 80)).alias("component"),
        meta.alias("__meta"),
        F.when(F.coalesce(given, F.lit("")) == "", F.current_timestamp()).otherwise(parsed).alias("ts"),
        given.alias("__given"),
        *[F.col(c) for c in READING if c in raw.columns],
    )


def normalize_events(raw: DataFrame) -> DataFrame:
    """camel/snake aliases, defaults (anonymous / interaction / '/'), length limits
    64/120/80, sanitized metadata (X1), timestamp default now. A missing id becomes a hash of
    what was sent (D11), wherever it was read, so a replayed event dedupes instead of getting a
    fresh random id. Events whose time can't be read are in ``rejected_events``."""
    good = _event_columns(raw).filter("ts is not null")
    return good.select("event_id", "user_id", "session_id", "event_type", "page", "component",
                       sanitize_metadata("__meta").alias("metadata_json"), "ts",
                       *[c for c in good.columns if c in ("seq", "arrival")])


def rejected_events(raw: DataFrame) -> DataFrame:
    """The events of ``raw`` whose time is given but can't be read, with that text and a reason."""
    bad = _event_columns(raw).filter("ts is null")
    return bad.select("event_id", "session_id", "event_type", F.col("__given").alias("given_ts"),
                      F.lit("unparsable timestamp").alias("reason"), *[c for c in bad.columns if c in READING])


def dedupe_events(events: DataFrame, order: str = "seq") -> DataFrame:
    """K5: insert-or-replace by ``event_id``: the last by ``order`` wins (partial aggregate)."""
    rest = [c for c in events.columns if c not in ("event_id", order)]
    return (events.groupBy("event_id")
            .agg(F.max_by(F.struct(*rest), F.col(order)).alias("__e"))
            .select("event_id", "__e.*"))


def session_summary(events: DataFrame) -> DataFrame:
    """Per session (events ordered by ts, event_id): user of the first event, start, last
    ``session_ended`` ts, count, first/last non-blank page, last event ts and
    duration = max(0, (ended or last) - start) seconds. One partial aggregate per session."""
    order = F.struct("ts", "event_id")
    has_page = F.coalesce(F.col("page"), F.lit("")) != ""
    g = events.groupBy("session_id").agg(
        F.min_by("user_id", order).alias("user_id"),
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("event_type") == "session_ended", F.col("ts"))).alias("ended_at"),
        F.count(F.lit(1)).alias("event_count"),
        F.min_by(F.when(has_page, F.col("page")), F.when(has_page, order)).alias("first_page"),
        F.max_by(F.when(has_page, F.col("page")), F.when(has_page, order)).alias("last_page"),
        F.max("ts").alias("last_event_at"),
    )
    end = F.coalesce("ended_at", "last_event_at")
    dur = (F.unix_micros(end) - F.unix_micros(F.col("started_at"))) / 1e6
    return g.withColumn("duration_seconds", F.greatest(dur, F.lit(0.0))) \
        .select("session_id", "user_id", "started_at", "ended_at", "duration_seconds", "event_count",
                "first_page", "last_page", "last_event_at")


def _clamp(limit, default: int) -> int:
    """At least one row; without a limit the default, and otherwise as many as the caller asks for."""
    return max(1, int(default if limit is None else limit))


def top_events(events: DataFrame, limit: int | None = 10) -> DataFrame:
    """Count by (event_type, component incl. NULL); count desc, type, component."""
    return (events.groupBy("event_type", "component").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("event_type"), F.asc_nulls_first("component"))
            .limit(_clamp(limit, 10)))


def feature_usage(events: DataFrame, limit: int | None = 20) -> DataFrame:
    """Count by (page, component, event_type) without session start/end and page views."""
    return (events.filter(~F.col("event_type").isin(*NON_FEATURE_EVENTS))
            .groupBy("page", "component", "event_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first("page"), F.asc_nulls_first("component"),
                     F.asc("event_type"))
            .limit(_clamp(limit, 20)))


# "<variant type>:<text>" of a falsy JSON value: "", false, [], {}, numeric zero (null/missing
# give NULL text and so are falsy too)
_FALSY = (r"^(STRING:|BOOLEAN:false|ARRAY<.*>:\[\]|OBJECT<.*>:\{\}"
          r"|(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)):[-+]?(0+\.?0*|\.0+)([eE][-+]?\d+)?)$")


def json_truthy(variant: Column, key: str) -> Column:
    """Text of ``$.key`` when truthy in the Python sense, else NULL (0, false, '', null, [], {})."""
    text = F.try_variant_get(variant, f"$.{key}", "string")
    tagged = F.concat(F.schema_of_variant(F.variant_get(variant, f"$.{key}", "variant")), F.lit(":"), text)
    return F.when(~tagged.rlike(_FALSY), text)


def _keep(pred: Column) -> Column:
    """A group-level keep flag. The predicate depends only on grouping keys, but testing it after
    the aggregate (as ``max``) stops Catalyst from pushing it below the projection, which would
    re-evaluate (inline) the JSON lookups a second time for every row."""
    return F.max(pred).alias("__keep")


def _first_truthy(df: DataFrame, out: str, keys: tuple[str, ...], limit: int) -> DataFrame:
    """Add ``out`` = cleaned first truthy value among ``keys`` (each key looked up once)."""
    tmp = [f"__{out}_{i}" for i in range(len(keys))]
    df = df.select("*", *[json_truthy(F.col("__v"), k).alias(t) for k, t in zip(keys, tmp)])
    return df.withColumn(out, clean_text(F.coalesce(*[F.col(t) for t in tmp], F.lit("")), limit)).drop(*tmp)


def _meta(events: DataFrame) -> DataFrame:
    return events.withColumn("__v", F.expr("try_parse_json(metadata_json)"))


def common_filters(events: DataFrame) -> DataFrame:
    """A15 filters: name = filter/field/name, value = value/selected/state (first truthy);
    both non-blank after cleaning -> count; count desc, name, value."""
    df = _meta(events.filter(F.col("event_type") == "filter_changed").select("metadata_json"))
    df = _first_truthy(df, "filter", ("filter", "field", "name"), 64)
    df = _first_truthy(df, "value", ("value", "selected", "state"), 80)
    return (df.groupBy("filter", "value")
            .agg(F.count(F.lit(1)).alias("count"), _keep((F.col("filter") != "") & (F.col("value") != "")))
            .filter("__keep").drop("__keep")
            .orderBy(F.desc("count"), "filter", "value"))


def common_sorts(events: DataFrame) -> DataFrame:
    """A15 sorts: sort/sortby/sort_by and direction/sortdir/sort_dir (default ``asc``)."""
    df = _meta(events.filter(F.col("event_type") == "sort_changed").select("metadata_json"))
    df = _first_truthy(df, "sort", ("sort", "sortby", "sort_by"), 64)
    df = _first_truthy(df, "direction", ("direction", "sortdir", "sort_dir"), 32)
    return (df.select("sort", F.when(F.col("direction") == "", "asc").otherwise(F.col("direction")).alias("direction"))
            .groupBy("sort", "direction").agg(F.count(F.lit(1)).alias("count"), _keep(F.col("sort") != ""))
            .filter("__keep").drop("__keep")
            .orderBy(F.desc("count"), "sort", "direction"))


def _zero_result(v: Column) -> Column:
    """``int(resultcount, or result_count when that is missing/null) == 0`` on a VARIANT."""
    rc = F.variant_get(v, "$.resultcount", "variant")
    node = F.coalesce(F.when(~F.is_variant_null(rc), rc), F.variant_get(v, "$.result_count", "variant"))
    tagged = F.concat(F.schema_of_variant(node), F.lit(":"), F.try_variant_get(node, "$", "string"))
    # false; a number whose integer part is 0; an integer string of zeros (surrounding spaces ok)
    zero = (r"^(BOOLEAN:false|(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)):[-+]?0*(\.\d*)?([eE]-\d+)?"
            r"|STRING:\s*[-+]?0+\s*)$")
    return F.coalesce(tagged.rlike(zero), F.lit(False))


def search_trends(events: DataFrame, limit: int | None = 20) -> DataFrame:
    """By query text (query/term/search): submitted, zero results (zero-result events plus
    submitted events whose result count is 0), abandoned, rates (3 dp, 0.0 when nothing was
    submitted), last seen, distinct sessions; submitted desc, zero desc, query."""
    t = F.col("event_type")
    df = _meta(events.filter(t.isin(*SEARCH_EVENTS)).select("event_type", "session_id", "ts", "metadata_json"))
    df = _first_truthy(df, "query", ("query", "term", "search"), 120)
    df = df.select("query", "event_type", "session_id", "ts",
                   ((t == "search_submitted") & _zero_result(F.col("__v"))).alias("zero_flag"))
    g = df.groupBy("query").agg(
        _keep(F.col("query") != ""),
        F.count_if(t == "search_submitted").alias("submitted"),
        (F.count_if(t == "search_zero_results") + F.count_if(F.col("zero_flag"))).alias("zero_results"),
        F.count_if(t == "search_abandoned").alias("abandoned"),
        F.max("ts").alias("last_seen"),
        F.count_distinct("session_id").alias("session_count"),
    ).filter("__keep")
    rate = lambda c: F.when(F.col("submitted") > 0, F.round(F.col(c) / F.col("submitted"), 3)).otherwise(0.0)
    return (g.select("query", "submitted", "zero_results", "abandoned", rate("zero_results").alias("zero_result_rate"),
                     rate("abandoned").alias("abandonment_rate"), "last_seen", "session_count")
            .orderBy(F.desc("submitted"), F.desc("zero_results"), "query")
            .limit(_clamp(limit, 20)))


def session_flows(events: DataFrame, sessions: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """C14: the latest ``limit`` sessions by last event, each with its events, in long
    form: one row per event, ordered within the flow by (ts, event_id).

    The top-k is a TakeOrderedAndProject; a key set of up to 100 rows is broadcast (a proven size
    bound) into one join, instead of one query per session. The flow stays
    long, so no session's events are packed into one value or sorted inside one task.
    """
    sessions = sessions if sessions is not None else session_summary(events)
    limit = _clamp(limit, 20)
    top = sessions.orderBy(F.desc("last_event_at"), F.asc("session_id")).limit(limit)
    flow = events.select("session_id", "ts", "event_id", "event_type", "page")
    return flow.join(F.broadcast(top) if limit <= 100 else top, "session_id", "inner")


def numbered_flows(events: DataFrame, sessions: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """C14 with the ``position`` (from 1) of every event in its session's flow, and ``page_position`` in
    the session's list of pages (NULL for an event without a page).

    The events of the chosen sessions are range-partitioned by (session, ts, event_id), so a session of
    any length is spread over tasks. Each numbers its own rows of a session; a prefix sum over one row
    per session and task adds what came before."""
    flow = session_flows(events, sessions, limit)
    keys = ["session_id", "ts", "event_id"]
    spread = (flow.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    path = staging_path(flow.sparkSession, "flows")
    spread.write.parquet(path)  # written once: rows and counts must see the same tasks
    spread = flow.sparkSession.read.schema(spread.schema).parquet(path)
    has_page = (F.coalesce("page", F.lit("")) != "").cast("long")
    earlier = Window.partitionBy("session_id").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (spread.groupBy("session_id", "__task").agg(F.count(F.lit(1)).alias("rows"), F.sum(has_page).alias("pages"))
              .select("session_id", "__task", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ("rows", "pages")]))
    here = Window.partitionBy("session_id", "__task").orderBy("__at")
    return spread.join(counts, ["session_id", "__task"]).select(
        *flow.columns, (F.col("__rows") + F.row_number().over(here)).alias("position"),
        F.when(has_page == 1, F.col("__pages") + F.sum(has_page).over(here)).alias("page_position"))


def sample_sessions(events: DataFrame, rate: float) -> DataFrame:
    """T4: keep a session with probability ``rate``, decided once per session id (stateless
    hash, so every batch and every executor agrees)."""
    bucket = F.conv(F.substring(F.md5("session_id"), 1, 7), 16, 10).cast("bigint") % 10000
    return events.filter(bucket < F.lit(int(round(rate * 10000))))
