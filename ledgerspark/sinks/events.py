"""K5: the event table, upserted by ``event_id`` (last sent wins), partitioned by event date.

Events may carry ``arrival`` (any orderable value, e.g. file time, file and row). It is stored with
them and decides between versions of an event, whatever batches they came in: a batch that is
replayed, or split in another way, gives the same table. Without it a later batch wins over an
earlier one, and ``seq`` decides inside a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.events import dedupe_events
from ledgerspark.session import staging_path
from ledgerspark.sinks.ledger import table_exists
from ledgerspark.sinks.swap import delete, recover, swap_in


def write_events(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Merge normalized ``events`` (with ``arrival``, or a ``seq`` order column, or neither) into the table
    at ``path``. The dates that the batch touches are rewritten, and those where its ids are stored
    already: an event that moves to another date leaves its old one."""
    if "seq" not in events.columns:
        events = events.withColumn("seq", F.lit(1).cast("bigint"))
    # The batch is read several times: from files, whose size bounds what a task reads of them, and of
    # which a step reads its own columns. (In memory, an event of a large file stays in one task.)
    held = staging_path(spark, "event-batch")
    events.withColumn("event_date", F.to_date("ts")).write.parquet(held)
    batch = spark.read.parquet(held)
    if batch.isEmpty():  # a table without a row could not be read again
        delete(spark, held)
        return
    first = not table_exists(spark, path)
    merged, moved = batch.withColumn("__new", F.lit(1)), None
    if not first:
        recover(spark, path)
        stored = spark.read.parquet(path)
        moved = stored.join(batch.select("event_id").distinct(), "event_id", "left_semi").select("event_date")
        touched = batch.select("event_date").union(moved).distinct()
        old = stored.join(touched, "event_date", "left_semi").withColumn("seq", F.lit(None).cast("bigint"))
        merged = old.withColumn("__new", F.lit(0)).unionByName(merged.select(*batch.columns, "__new"), allowMissingColumns=True)
    # the order of versions: a stored one without arrival comes before any that has one
    order = F.struct(*([F.col("arrival")] if "arrival" in merged.columns else []), "__new", "seq")
    out = (dedupe_events(merged.drop("event_date").withColumn("__order", order).drop("__new", "seq"), "__order")
           .withColumn("event_date", F.to_date("ts")))
    # written aside first: the table is no input of the swap
    aside = staging_path(spark, "event-upsert")
    out.write.parquet(aside)
    if first:
        (spark.read.parquet(aside).hint("rebalance", "event_date").write.partitionBy("event_date").parquet(path))
    else:
        fresh = spark.read.parquet(aside).select("event_date").distinct()
        emptied = [r.event_date for r in moved.distinct().join(fresh, "event_date", "left_anti").collect()]  # one row a date
        swap_in(spark, path, aside, "event_date", [f"event_date={day}" for day in emptied])
    delete(spark, held)
