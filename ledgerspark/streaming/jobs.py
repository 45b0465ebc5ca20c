"""T1-T5 on Structured Streaming.

T1 statements: a stream of lines (files are split over tasks) whose micro-batches go through the
   batch loaders and the K1 upsert in ``foreachBatch``, in the order of file and line. K1 is
   idempotent (a key merge), so a replayed batch after a failure changes nothing.
T2 events: every micro-batch is merged by event id into the stored table (K5). Events arrive in the
   order of their files (time of writing, then name) and rows; that order is stored with them, so
   the last one sent wins however files fall into micro-batches.
T3 sessions: ``foreachBatch`` appends the batch's events to a bucketed event table, then
   recomputes only the touched sessions from their buckets (dynamic partition pruning) and
   appends the new summaries tagged with the batch id; readers take the latest per session. An
   event sent again under another session touches both: the old one is recomputed without it.
T5 rolling spend: every micro-batch writes its partial sums into a partition of its own; readers add
   them up. No watermark, so no row comes too late. Every ``COMPACT_EVERY`` batches the partials are
   added up into one base table and go, so that few partitions are stored at any time.
All sinks live under the shared checkpoint folder; the checkpoint location makes restarts
resume exactly where the last committed batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.events import dedupe_events, session_summary
from ledgerspark.schema import MONEY
from ledgerspark.operators.filters import category_or_uncategorized
from ledgerspark.sinks.ledger import table_exists
from ledgerspark.sinks.swap import delete, exists

SESSION_BUCKETS = 64
SUMMARY = ("user_id", "started_at", "ended_at", "duration_seconds", "event_count", "first_page", "last_page",
           "last_event_at")


def _run(writer, trigger_once: bool = True):
    q = (writer.trigger(availableNow=True) if trigger_once else writer).start()
    q.awaitTermination()
    return q


# ---- T1 -------------------------------------------------------------------------------

def stream_statement_import(spark: SparkSession, source: str, ledger_path: str, checkpoint: str, rules,
                            bank_keys=None, route_on: str = "name", max_files: int | None = None):
    """Import every new statement file under ``source`` into the ledger at ``ledger_path``. Rows
    of a micro-batch arrive in the order of their files' names and lines. Lines that can't be read and files of no known layout go to ``<ledger_path>-quarantine``, a
    partition per micro-batch, so a replay writes them once."""
    from ledgerspark.sinks.ledger import write_upsert
    from ledgerspark.sources.statements import lines_of, load_statements

    reader = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(source).select(F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("block"), "value")

    def handle(batch: DataFrame, batch_id: int) -> None:
        grid = lines_of(batch).persist()  # read by the header scan, the rows and the quarantine; released below
        res = load_statements(spark, None, bank_keys, route_on="files" if route_on == "path" else route_on, grid=grid)
        rows = res.rows.select("date", "description", "merchant", "amount", "provider",
                               F.col("file").alias("src_key"), F.col("pos").cast("bigint").alias("seq"))
        write_upsert(spark, ledger_path, rows, rules)
        unknown = res.unknown_files.select("file", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("line"),
                                           F.lit("unknown file").alias("reason"))
        (res.quarantine.select("file", "pos", "line", "reason").unionByName(unknown)
         .withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{ledger_path}-quarantine"))
        grid.unpersist()

    return _run(files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint))


# ---- T2 -------------------------------------------------------------------------------

def stream_event_dedupe(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                        max_files: int | None = None):
    """One row per event id, the last one sent. Every micro-batch is merged into ``sink`` by
    id (K5), so late and replayed events are neither lost nor doubled."""
    from ledgerspark.sinks.events import write_events

    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arrival = F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"))
    ev = reader.load(source).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrival", arrival)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_events(spark, sink, batch)

    return _run(ev.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint))


# ---- T3 -------------------------------------------------------------------------------

def _bucket(col: str = "session_id"):
    return F.pmod(F.xxhash64(col), F.lit(SESSION_BUCKETS)).cast("int")


def stream_sessions(spark: SparkSession, source: str, schema, events_path: str, sessions_path: str,
                    checkpoint: str, max_files: int | None = None):
    """Keep ``sessions_path`` current as events arrive (exact: touched sessions recomputed)."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ev = reader.load(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # one row per event id: of several in a batch the latest
        batch = (dedupe_events(batch.withColumn("seq", F.struct("ts", "session_id")), "seq").select(*batch.columns)
                 .withColumn("gone", F.lit(False)))
        if table_exists(spark, events_path):
            # an event sent again under another session leaves a mark in each session that held it
            held = spark.read.parquet(events_path).select("event_id", F.col("session_id").alias("held_by"))
            moved = (batch.join(held, "event_id").where(~F.col("held_by").eqNullSafe(F.col("session_id"))).distinct()
                     .withColumn("session_id", F.col("held_by")).withColumn("gone", F.lit(True)).drop("held_by"))
            batch = batch.unionByName(moved)
        batch = batch.withColumn("session_bucket", _bucket()).withColumn("batch_id", F.lit(batch_id)).persist()
        # a micro-batch is bounded by the trigger: cluster it by bucket so each bucket gets one file
        batch.repartition("session_bucket").write.mode("append").partitionBy("session_bucket").parquet(events_path)
        touched = batch.select("session_bucket").distinct()
        stored = spark.read.parquet(events_path).join(touched, "session_bucket", "left_semi")
        touched_ids = batch.select("session_id").distinct()
        events = stored.join(touched_ids, "session_id", "left_semi")
        # a replayed batch appends its events again: keep one copy per session and event id (latest batch)
        rest = [c for c in events.columns if c not in ("event_id", "session_id", "batch_id")]
        events = (events.groupBy("session_id", "event_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("e"))
                  .select("session_id", "event_id", "e.*").where("not gone"))
        # a session that lost all its events is written with no events, and readers leave it out
        summary = (touched_ids.alias("t").join(session_summary(events).alias("s"),
                                               F.expr("t.session_id <=> s.session_id"), "left")
                   .select("t.session_id", *[F.col(f"s.{c}") for c in SUMMARY], F.lit(batch_id).alias("batch_id"))
                   .withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("bigint"))))
        summary.write.mode("append").parquet(sessions_path)
        batch.unpersist()

    return _run(ev.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint))


def read_sessions(spark: SparkSession, sessions_path: str) -> DataFrame:
    """Latest summary per session (the highest batch id)."""
    s = spark.read.parquet(sessions_path)
    cols = [c for c in s.columns if c not in ("session_id", "batch_id")]
    return (s.groupBy("session_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
            .select("session_id", "s.*").where("event_count > 0"))


# ---- T5 -------------------------------------------------------------------------------

COMPACT_EVERY = 16  # micro-batches


def stream_spend_totals(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, by: dict,
                        max_files: int | None = None):
    """T5: total and number of transactions by the Columns of ``by`` (name -> Column over the source),
    kept as one partial per group and micro-batch. A replayed batch overwrites its own partition and
    no row comes too late, since readers add up all partials.

    ``sink/partials/batch_id=n`` holds the partials, ``sink/base-n`` the sums of all batches up to n. A base
    counts once it is complete (``_SUCCESS``); until then, and for batches behind it, readers take the
    partials, so a crash at any step loses and doubles nothing."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def handle(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(*[c.alias(n) for n, c in by.items()])
         .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("transactions"))
         .withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{sink}/partials"))
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1 and _base(spark, sink) < batch_id:
            read_spend_totals(spark, sink).write.mode("overwrite").parquet(f"{sink}/base-{batch_id}")
            for folder in _folders(spark, f"{sink}/partials"):
                if folder.startswith("batch_id=") and int(folder[9:]) <= batch_id:
                    delete(spark, f"{sink}/partials/{folder}")
            for folder in _folders(spark, sink):
                if folder.startswith("base-") and int(folder[5:]) < batch_id:
                    delete(spark, f"{sink}/{folder}")

    return _run(reader.load(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder: a few partitions and bases."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def _base(spark: SparkSession, sink: str) -> int:
    """The batch up to which a complete base holds the sums, -1 without one."""
    return max((int(f[5:]) for f in _folders(spark, sink) if f.startswith("base-") and exists(spark, f"{sink}/{f}/_SUCCESS")),
               default=-1)


def read_spend_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The groups' totals over all micro-batches."""
    base = _base(spark, sink)
    parts = [f"{sink}/partials/{f}" for f in _folders(spark, f"{sink}/partials")
             if f.startswith("batch_id=") and int(f[9:]) > base]
    rows = None
    for paths in ([f"{sink}/base-{base}"] if base >= 0 else [], parts):
        if paths:
            part = spark.read.parquet(*paths)
            rows = part if rows is None else rows.unionByName(part)
    keys = [c for c in rows.columns if c not in ("total", "transactions", "batch_id")]
    return rows.groupBy(*keys).agg(F.sum("total").cast(MONEY).alias("total"), F.sum("transactions").alias("transactions"))


def stream_daily_spend(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                       max_files: int | None = None):
    """T5 by day."""
    return stream_spend_totals(spark, source, schema, sink, checkpoint, {"day": F.col("date")}, max_files)


def read_daily_spend(spark: SparkSession, sink: str) -> DataFrame:
    """Day totals over all micro-batches."""
    return read_spend_totals(spark, sink)


def stream_month_spend(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                       max_files: int | None = None):
    """T5 by month and category (A2), blank categories as ``uncategorized``."""
    by = {"month": F.date_format("date", "yyyy-MM"), "category": category_or_uncategorized()}
    return stream_spend_totals(spark, source, schema, sink, checkpoint, by, max_files)
