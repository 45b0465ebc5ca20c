"""Registered streaming queries (step 8): each writes its input (derived from the driver
tables by Spark) into the shared checkpoint folder, runs the stream to completion with an
``availableNow`` trigger and returns the sink as a DataFrame. The oracle is the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.plans.event_queries import _SESSION_COLS, _SESSION_SQL, _sessions_out
from ledgerspark.plans.ledger_queries import UPSERT_RULES, _case_sql
from ledgerspark.plans.registry import QUERIES, ORACLES, register
from ledgerspark.plans.source_queries import AS_OF, _specs, write_statements
from ledgerspark.plans.sqlviews import LEDGER_ORDERS, USAGE_EVENTS, with_
from ledgerspark.session import staging_path
from ledgerspark.plans.statement_import import import_all
from ledgerspark.sinks.ledger import read_ledger, write_upsert
from ledgerspark.sources.tables import ledger_orders, usage_events
from ledgerspark.streaming import jobs


FILE_ROWS = 250_000  # most rows, on average, of a staged file


def _times(df, n_files):
    """By how much the files of a staged input, and those of a micro-batch, are multiplied: a file holds
    about ``FILE_ROWS`` rows at most, and there are as many micro-batches whatever the size."""
    return max(1, -(-df.count() // (n_files * FILE_ROWS)))


def _stage(df, spark, name, n_files=8, by=None):
    """The folder of the staged rows, and by how much their ``n_files`` files were multiplied."""
    path, times = staging_path(spark, name), _times(df, n_files)
    (df.repartitionByRange(n_files * times, by) if by else df.repartition(n_files * times)).write.parquet(path)
    return path, times


@register("stream_daily_spend", with_(LEDGER_ORDERS) + """
SELECT CAST(date AS VARCHAR) AS day, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger GROUP BY date""")
def stream_daily_spend(spark, sf):
    src, times = _stage(ledger_orders(spark, sf).select("date", "amount"), spark, "daily-src")
    sink, ck = staging_path(spark, "daily-sink"), staging_path(spark, "daily-ck")
    jobs.stream_daily_spend(spark, src, spark.read.parquet(src).schema, sink, ck, max_files=times)
    return jobs.read_daily_spend(spark, sink).select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                                                      F.col("total").cast("double").alias("total"), "transactions")


@register("stream_event_dedupe", with_(USAGE_EVENTS) + """
SELECT DISTINCT event_id, session_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM usage""")
def stream_event_dedupe(spark, sf):
    ev = usage_events(spark, sf).select("event_id", "session_id", "event_type", "ts")
    replay = ev.filter(F.col("event_id").cast("bigint") % 5 == 0)
    src, times = _stage(ev.unionByName(replay), spark, "events-src")
    sink, ck = staging_path(spark, "dedupe-sink"), staging_path(spark, "dedupe-ck")
    jobs.stream_event_dedupe(spark, src, spark.read.parquet(src).schema, sink, ck, max_files=2 * times)
    return spark.read.parquet(sink).select("event_id", "session_id", "event_type",
                                           F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("stream_event_corrections", with_(USAGE_EVENTS) + """
SELECT run, event_id, CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN '/corrected' ELSE page END AS page,
       strftime(CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM usage, (VALUES ('one batch'), ('many batches')) r(run)""")
def stream_event_corrections(spark, sf):
    """T2 with events that are sent again with an earlier time: the version sent last stays, whether
    both versions come in one micro-batch or in two."""
    n = F.col("event_id").cast("bigint")
    ev = usage_events(spark, sf).select("event_id", "page", "ts")
    src, times = _stage(ev, spark, "corrections-src", n_files=4)
    later = ev.filter(n % 5 == 0).select("event_id", F.lit("/corrected").alias("page"), (F.col("ts") - F.expr("INTERVAL 3 DAY")).alias("ts"))
    later.repartition(2 * times).write.mode("append").parquet(src)
    out = None
    for run, files in (("one batch", None), ("many batches", 2 * times)):
        sink = staging_path(spark, "corrections-sink")
        jobs.stream_event_dedupe(spark, src, spark.read.parquet(src).schema, sink, staging_path(spark, "corrections-ck"), files)
        rows = spark.read.parquet(sink).select(F.lit(run).alias("run"), "event_id", "page",
                                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("stream_month_spend", with_(LEDGER_ORDERS) + """
SELECT strftime(date, '%Y-%m') AS month, COALESCE(category, 'uncategorized') AS category,
       CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger GROUP BY 1, 2""")
def stream_month_spend(spark, sf):
    src, times = _stage(ledger_orders(spark, sf).select("date", "category", "amount"), spark, "months-src", n_files=4)
    sink = staging_path(spark, "months-sink")
    jobs.stream_month_spend(spark, src, spark.read.parquet(src).schema, sink, staging_path(spark, "months-ck"), max_files=times)
    return jobs.read_spend_totals(spark, sink).select("month", "category", F.col("total").cast("double").alias("total"), "transactions")


@register("event_upsert_stored", with_(USAGE_EVENTS) + """
SELECT DISTINCT event_id, session_id, event_type,
       strftime(CASE WHEN CAST(event_id AS BIGINT) % 10 = 0 THEN ts + INTERVAL 40 DAY ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM usage""")
def event_upsert_stored(spark, sf):
    """K5 through its writer, twice: the second batch moves every tenth event to another date."""
    from ledgerspark.sinks.events import write_events

    ev = usage_events(spark, sf).select("event_id", "session_id", "event_type", "ts")
    path = staging_path(spark, "events-stored")
    write_events(spark, path, ev)
    write_events(spark, path, ev.filter(F.col("event_id").cast("bigint") % 10 == 0)
                 .withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAY")))
    return spark.read.parquet(path).select("event_id", "session_id", "event_type",
                                           F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("stream_sessions", with_(USAGE_EVENTS, _SESSION_SQL.format(src="usage")) + f"SELECT {_SESSION_COLS} FROM sess")
def stream_sessions(spark, sf):
    ev = usage_events(spark, sf).drop("value")
    src, times = _stage(ev, spark, "sessions-src", n_files=6, by="ts")
    events_path, sessions_path = staging_path(spark, "sessions-events"), staging_path(spark, "sessions-out")
    jobs.stream_sessions(spark, src, spark.read.parquet(src).schema, events_path, sessions_path,
                         staging_path(spark, "sessions-ck"), max_files=3 * times)
    return _sessions_out(jobs.read_sessions(spark, sessions_path))


@register("stream_import", "WITH rt AS (" + ORACLES["statement_roundtrip"] + f""")
SELECT date, description, merchant, amount, {_case_sql(UPSERT_RULES)} AS category, provider FROM rt""")
def stream_import(spark, sf):
    src = write_statements(spark, sf, staging_path(spark, "import-src"), whole=True)
    ledger = staging_path(spark, "import-ledger")
    jobs.stream_statement_import(spark, src, ledger, staging_path(spark, "import-ck"), UPSERT_RULES,
                                 route_on="path", max_files=24)
    out = read_ledger(spark, ledger)
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                      F.col("amount").cast("double").alias("amount"), "category", "provider")


@register("stream_import_shared", with_(LEDGER_ORDERS) + """
SELECT DISTINCT CAST(date AS VARCHAR) AS date, merchant, CAST(amount AS DOUBLE) AS amount,
       CASE WHEN right(merchant, 1) < '4' THEN 'hometrust' WHEN right(merchant, 1) > '6' THEN 'tdvisa'
            WHEN year(date) % 2 = 0 THEN 'tdvisa' ELSE 'hometrust' END AS provider
FROM ledger WHERE provider = 'o'""")
def stream_import_shared(spark, sf):
    """T1 where charges occur in the files of two banks: the provider is that of the file whose name
    comes first (Home Trust in odd years, TD Visa in even ones), whatever the lines' numbers."""
    led = ledger_orders(spark, sf).filter("provider = 'o'")
    year, last = F.date_format("date", "yyyy"), F.substring("merchant", -1, 1)
    even = year % 2 == 0
    us = F.date_format("date", "MM/dd/yyyy")
    trust = led.filter(last <= "6").select(
        F.concat(F.when(even, "b").otherwise("a"), F.lit("-hometrust-"), year).alias("file"), F.lit(1).alias("pos"),
        F.concat_ws(",", us, "merchant", F.col("amount").cast("string")).alias("line"))
    visa = led.filter(last >= "4").select(
        F.concat(F.when(even, "a").otherwise("b"), F.lit("-tdvisa-"), year).alias("file"), F.lit(1).alias("pos"),
        F.concat_ws(",", us, "merchant", F.col("amount").cast("string"), F.lit(""), F.lit("0")).alias("line"))
    headers = trust.select("file").distinct().select("file", F.lit(0).alias("pos"), F.lit("Trans Date,Merchant Name,Amount").alias("line"))
    src, ledger = staging_path(spark, "shared-src"), staging_path(spark, "shared-ledger")
    (trust.unionByName(visa).unionByName(headers).repartition("file").sortWithinPartitions("file", "pos")
     .select("file", "line").write.partitionBy("file").text(src))
    jobs.stream_statement_import(spark, src, ledger, staging_path(spark, "shared-ck"), UPSERT_RULES, route_on="path")
    return read_ledger(spark, ledger).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "merchant",
                                             F.col("amount").cast("double").alias("amount"), "provider")


@register("import_job", "WITH rt AS (" + ORACLES["statement_roundtrip"] + "), rec AS (" + ORACLES["recurring_expand"] + "), man AS ("
          + with_(LEDGER_ORDERS) + f"""
  SELECT CAST(date AS VARCHAR) AS date, 'cash' AS description, merchant, CAST(amount AS DOUBLE) AS amount, 'manual' AS provider
  FROM ledger WHERE provider = 'p'),
u AS (SELECT date, description, merchant, amount, provider FROM rt
      UNION SELECT date, description, merchant, amount, provider FROM rec
      UNION SELECT date, description, merchant, amount, provider FROM man)
SELECT date, description, merchant, amount, {_case_sql(UPSERT_RULES)} AS category, provider FROM u""")
def import_job(spark, sf):
    """The whole import: statement files, manual entries and recurring rules -> dedupe -> categorize ->
    upsert -> the stored ledger. Some manual entries repeat charges of a statement, which stay its own;
    the job runs twice, as a rerun would, and the second run changes nothing."""
    src = write_statements(spark, sf, staging_path(spark, "job-src"))
    led = ledger_orders(spark, sf)
    cash = led.filter("provider = 'p'").select("date", F.lit("cash").alias("description"), "merchant", "amount")
    again = led.filter("provider = 'o' AND substring(merchant, -1, 1) = '3' AND description <> '2-HIGH'").select(
        "date", F.col("merchant").alias("description"), "merchant", "amount")
    manual = cash.unionByName(again).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                                            F.col("amount").cast("double").alias("amount"))
    path = staging_path(spark, "job-ledger")
    for _ in range(2):
        done = import_all(spark, src, manual, _specs(spark, sf), as_of=AS_OF, route_on="path")
        write_upsert(spark, path, done.ledger, UPSERT_RULES)
    return read_ledger(spark, path).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                                           F.col("amount").cast("double").alias("amount"), "category", "provider")


assert "statement_roundtrip" in QUERIES
