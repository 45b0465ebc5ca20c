"""Unions with a source order, and order-dependent merges by key.

Every merge is a ``groupBy(key)`` with ``min_by``/``max_by`` over an explicit ordering struct
(source rank, position). Those are partial aggregates: each map task collapses its rows of a
key before the shuffle, so a key holding a third of all rows still ships one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.categorize import categorize

KEY = ("date", "description", "merchant", "amount")
LEDGER_COLS = ("date", "description", "merchant", "amount", "category", "provider")
ARRIVAL = {"src_ord": "int", "src_key": "string", "seq": "bigint"}  # order of arrival inside a batch


def union_sources(*sources: DataFrame, positions: list | None = None) -> DataFrame:
    """``unionByName`` with ``src_ord`` = argument position (files, then manual, then
    recurring: D10). A source without ``seq`` gets one from ``positions`` or 0."""
    out = None
    for idx, df in enumerate(sources):
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(0).cast("bigint"))
        df = df.withColumn("src_ord", F.lit(idx))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key=KEY, order=("src_ord", "seq")) -> DataFrame:
    """One row per key, the first by ``order`` wins (partial aggregate, no window)."""
    rest = [c for c in df.columns if c not in key]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*key).agg(picked).select(*key, "__first.*")


def dedupe_last(df: DataFrame, key=KEY, order=("src_ord", "seq")) -> DataFrame:
    """Last-wins counterpart of ``dedupe_first`` (K2, K5)."""
    rest = [c for c in df.columns if c not in key]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*key).agg(picked).select(*key, "__last.*")


def prepare_batch(batch: DataFrame, rules) -> DataFrame:
    """K1 input: categorize (before trimming), trim text, blank provider -> NULL."""
    df = categorize(batch, rules)
    prov = F.trim(F.col("provider"))
    return df.select(
        "date",
        F.trim("description").alias("description"),
        F.trim("merchant").alias("merchant"),
        "amount",
        "category",
        F.when(prov == "", F.lit(None)).otherwise(prov).alias("provider"),
        *[c for c in ARRIVAL if c in batch.columns],
    )


def upsert(existing: DataFrame, batch: DataFrame, rules) -> DataFrame:
    """K1 merge: insert new keys; on a key conflict category := newest, provider :=
    COALESCE(old, new) (first non-null in sequence). Old rows rank before the batch, whose rows
    rank by those of the ``ARRIVAL`` columns that it has (source, file, line)."""
    new = prepare_batch(batch, rules)
    value = {c: F.col(c).cast(t) if c in new.columns else F.lit(None).cast(t) for c, t in ARRIVAL.items()}
    old = existing.select(*LEDGER_COLS).withColumn(
        "__rank", F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(t).alias(c) for c, t in ARRIVAL.items()]))
    new = new.select(*LEDGER_COLS, F.struct(F.lit(1).alias("new"), *[v.alias(c) for c, v in value.items()]).alias("__rank"))
    both = old.unionByName(new)
    return (both.groupBy(*KEY)
            .agg(F.max_by("category", "__rank").alias("category"),
                 F.min_by("provider", F.when(F.col("provider").isNotNull(), F.col("__rank"))).alias("provider"))
            .select(*LEDGER_COLS))


def alldata_rows(df: DataFrame, amount_text: str = "amount") -> DataFrame:
    """K4/U4: ``month`` label + row, amounts coerced from text ('$', ',' stripped, bad -> 0.0),
    exact duplicates of (month, row) removed."""
    from ledgerspark.functions.keys import month_label
    from ledgerspark.functions.money import loose_amount

    return (df.select(month_label("date").alias("month"),
                      F.date_format("date", "yyyy-MM-dd").alias("date"),
                      "description", "merchant", "category",
                      loose_amount(F.col(amount_text)).alias("amount"))
            .dropDuplicates())
