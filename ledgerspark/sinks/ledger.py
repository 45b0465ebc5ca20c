"""K1-K4 writers.

K1 rewrites only the months a batch touches: the old rows of those months are selected by a
semi-join on the ``month`` partition column (dynamic partition pruning reads nothing else),
merged with the batch by key, and swapped in with dynamic partition overwrite (``sinks/swap.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.dedupe import ARRIVAL, KEY, LEDGER_COLS, dedupe_last, upsert
from ledgerspark.schema import LEDGER
from ledgerspark.session import staging_path
from ledgerspark.sinks import swap


TASK_ROWS = 500_000  # rows that a task of the merge sorts, on average


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is there. Only its absence counts as a first write; every other
    problem with it surfaces when it is read."""
    return swap.exists(spark, path)


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger; older files without ``provider`` read as NULL (mergeSchema)."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if "provider" not in df.columns:
        df = df.withColumn("provider", F.lit(None).cast("string"))
    return df.select(*LEDGER_COLS)


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` over tasks of about ``TASK_ROWS``: shuffled and stored partitions are bounded in bytes, of
    which a ledger row may take ten, and sorted in memory it takes hundreds. Not by key alone, so that
    rows of one key still collapse in several tasks."""
    by = [c for c in (*KEY, "provider", *ARRIVAL) if c in df.columns]
    return df.repartition(-(-rows // TASK_ROWS), *by) if rows > TASK_ROWS else df


def write_upsert(spark: SparkSession, path: str, batch: DataFrame, rules) -> None:
    """K1: merge ``batch`` into the month-partitioned ledger at ``path``."""
    batch = batch.persist()
    rows = batch.count()
    if not rows:  # a table without a row could not be read again
        batch.unpersist()
        return
    months = _with_month(batch).select("month").distinct()
    if not table_exists(spark, path):
        touched_old = spark.createDataFrame([], LEDGER)
    else:
        swap.recover(spark, path)
        stored = spark.read.option("mergeSchema", "true").parquet(path)  # an unreadable table fails the job
        if "provider" not in stored.columns:
            stored = stored.withColumn("provider", F.lit(None).cast("string"))
        # semi-join on the partition column: dynamic partition pruning reads touched months only
        touched_old = stored.join(months, "month", "left_semi").select(*LEDGER_COLS)
        touched_old = _spread(touched_old, touched_old.count())
    # The merged months are written aside first: the table is no input of the swap, and a swap that is
    # interrupted is finished from that copy.
    aside = staging_path(spark, "ledger-upsert")
    _with_month(upsert(touched_old, _spread(batch, rows), rules)).write.parquet(aside)
    swap.swap_in(spark, path, aside, "month")
    batch.unpersist()


def csv_rows(df: DataFrame) -> DataFrame:
    """K2 rows: trimmed text, amount to 2 dp, last row per (date, description, merchant, amount)."""
    trimmed = df.select(
        "date", F.trim("description").alias("description"), F.trim("merchant").alias("merchant"),
        F.round(F.col("amount"), 2).alias("amount"), "category",
        *[c for c in ("src_ord", "seq") if c in df.columns])
    for c in ("src_ord", "seq"):
        if c not in trimmed.columns:
            trimmed = trimmed.withColumn(c, F.lit(0))
    return dedupe_last(trimmed, KEY).select("date", "description", "merchant", "category", "amount")


def write_master_csv(df: DataFrame, path: str) -> None:
    """K2: one CSV folder per year (D7), rows sorted by date inside each file."""
    out = csv_rows(df).withColumn("year", F.year("date"))
    (out.repartitionByRange("year", "date").sortWithinPartitions("date")
     .write.mode("overwrite").option("header", True).partitionBy("year").csv(path))


def write_month_extract(df: DataFrame, path: str, sort: str = "abs") -> None:
    """K3: one folder per ``MMMM yyyy`` month, rows by abs(amount) (or amount) descending.

    A range partition on (month, key) splits a large month over several tasks whose files are
    in order (part-00000 holds the largest amounts), instead of one task per month."""
    from ledgerspark.functions.keys import month_key, month_label

    key = F.abs(F.col("amount")) if sort == "abs" else F.col("amount")
    out = df.withColumn("month", month_label("date")).withColumn("__mk", month_key("date")).withColumn("__k", key)
    (out.repartitionByRange("__mk", F.desc("__k")).sortWithinPartitions("__mk", F.desc("__k"))
     .select("month", "date", "description", "merchant", "category", "amount")
     .write.mode("overwrite").option("header", True).partitionBy("month").csv(path))
