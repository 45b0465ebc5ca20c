"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's target rate is ``target_rows * weight / rows``. Each document's count is drawn by
inverting the Poisson distribution with that mean at a uniform number hashed from (seed, id), so a
rerun gives the same counts. A mean above ``STEP`` is the sum of independent draws with a mean of
at most ``STEP`` each, which keeps exp(-mean) away from underflow. Documents are exploded by their count
and shuffled by a hash of (seed, id, copy).

Null sources form a source of their own; a null id draws like any other value; repeated rows draw
the same count; an empty table gives an empty result; other columns are carried unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import staged

STEP = 16


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 over the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, target_rows: int | None = None,
                 source_col: str = "source", temperature: float = 0.5) -> DataFrame:
    """``(source, n, rate, draws, cdf)``; ``weights(source, weight)`` or n ** temperature when none are given."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        weighted = (counts.join(w, counts["source"].eqNullSafe(w["__s"]), "left")
                    .select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    weighted = staged(weighted, "mix-weights")
    weight, count = weighted.agg(F.sum("weight"), F.sum("n")).first()
    rows = F.lit(float((count or 0) if target_rows is None else target_rows))
    mean = F.col("rate") / F.col("draws")
    return staged(
        weighted
        .withColumn("rate", rows * F.col("weight") / F.lit(weight) / F.col("n") if weight else F.lit(0.0))
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
        .withColumn("cdf", F.aggregate(
            F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")),
            F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cum")),
            lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["sum"] + s["p"] * mean / k).alias("sum"),
                                  F.concat(s["cum"], F.array(s["sum"] + s["p"] * mean / k)).alias("cum")),
            lambda s: s["cum"]))
        .select("source", "n", "rate", "draws", "cdf"), "mix-rates")


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 42, id_col: str = "doc_id",
              source_col: str = "source") -> DataFrame:
    """``(doc, copy, n_copies)``: every document once per drawn count, in shuffled order. ``doc``
    is a struct of the input columns. The rates table has one row per source and was written, so
    the planner broadcasts it only below its measured threshold."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.col(id_col).alias("__id"), F.col(source_col).alias("__source"))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), F.col("__id"), j))))
    drawn = (base.join(rates, base["__source"].eqNullSafe(rates["source"]))
             .select("doc", "__id", count.alias("n_copies")).where("n_copies > 0"))
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col("__id").cast("string"), F.lit("null")),
                            F.col("copy").cast("string")))
    keyed = copies.withColumn("__key", key)
    return keyed.repartition("__key").sortWithinPartitions("__key").select("doc", "copy", "n_copies")


def mix(docs: DataFrame, weights: DataFrame | None = None, target_rows: int | None = None, seed: int = 42,
        temperature: float = 0.5) -> DataFrame:
    """The replicated, shuffled rows with the input's columns."""
    return replicate(docs, source_rates(docs, weights, target_rows, temperature=temperature), seed).select("doc.*")
