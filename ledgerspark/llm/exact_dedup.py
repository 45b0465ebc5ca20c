"""Exact dedup: group by 128-bit content hash, keep the smallest stable id, compare bytes.

Texts are equal when identical after lower-casing A-Z. Null text counts as empty. A null id sorts
after every other id. Repeated rows (same id, same text) count one by one and exactly one stays.
An empty table gives an empty result; extra columns are carried and may have any name.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerspark.llm.common import ascii_lower, staged

_HASHES = StructType([StructField("hi", LongType()), StructField("lo", LongType()), StructField("sha", StringType())])


@pandas_udf(_HASHES)
def _content_hash(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        raw = (t or "").encode("utf-8").lower()  # bytes.lower changes A-Z only
        h = hashlib.md5(raw, usedforsecurity=False).digest()
        rows.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True),
                     hashlib.sha256(raw).hexdigest()))
    return pd.DataFrame(rows, columns=["hi", "lo", "sha"])


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           stable_id: Column | None = None) -> DataFrame:
    """``(row, id, ord, doc, hi, lo, sha)`` staged: ``row`` tells repeated rows apart, ``ord`` is
    the stable id whose smallest value stays, ``doc`` holds every input column."""
    order = F.col(id_col) if stable_id is None else stable_id
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"),
                       F.col(text_col).alias("text"), order.cast("bigint").alias("ord"))
    h = base.withColumn("h", _content_hash("text"))
    return staged(h.select(F.monotonically_increasing_id().alias("row"), "id", "ord", "doc",
                           "h.hi", "h.lo", "h.sha"), "exact-hash")


def classify(rows: DataFrame, text_field: str = "text") -> DataFrame:
    """``(row, id, keep_id, group_size, kept, sha)`` for every row of :func:`hashed`.

    Groups come from one aggregate on the 128-bit hash. Only rows of groups with two or more
    members have their bytes compared: they are grouped by (hash, text), so copies collapse before
    the shuffle, and a hash with two texts is a collision whose rows are classed by text instead.
    """
    order = F.struct(F.col("ord").isNull().alias("no"), F.col("ord"), F.col("row"), F.col("id"))
    ids = rows.select("row", "id", "ord", "hi", "lo", "sha")
    groups = (ids.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(order).alias("best"))
              .where("n > 1"))
    groups = staged(groups, "exact-groups")
    dup = (rows.join(groups.select("hi", "lo"), ["hi", "lo"], "left_semi")
           .select("hi", "lo", ascii_lower(F.coalesce(F.col(f"doc.{text_field}"), F.lit(""))).alias("norm")))
    texts = dup.groupBy("hi", "lo", "norm").agg(F.count("*").alias("n"))
    collided = staged(texts.groupBy("hi", "lo").agg(F.count("*").alias("texts")).where("texts > 1")
                      .select("hi", "lo"), "exact-collided")
    clean = groups.join(collided, ["hi", "lo"], "left_anti")
    g = clean.select("hi", "lo", "n", "best")
    plain = (ids.join(collided, ["hi", "lo"], "left_anti").join(g, ["hi", "lo"], "left")
             .select("row", "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
                     F.coalesce("n", F.lit(1)).alias("group_size"),
                     (F.col("n").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"), "sha"))
    odd = (rows.join(collided, ["hi", "lo"], "left_semi")
           .withColumn("norm", ascii_lower(F.coalesce(F.col(f"doc.{text_field}"), F.lit("")))))
    best = odd.groupBy("hi", "lo", "norm").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    split = (odd.select("row", "id", "hi", "lo", "norm", "sha").join(best, ["hi", "lo", "norm"])
             .select("row", "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                     (F.col("best.row") == F.col("row")).alias("kept"), "sha"))
    return plain.union(split)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 stable_id: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    out = classify(hashed(docs.select(id_col, text_col), id_col, text_col, stable_id), text_col)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
                      "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    stable_id: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    rows = hashed(docs, id_col, text_col, stable_id)
    gone = classify(rows, text_col).where("not kept").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")
