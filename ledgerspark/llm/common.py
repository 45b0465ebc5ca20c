"""Helpers shared by the corpus operators: staged tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import staging_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read back: cuts the
    lineage, survives lost executors and gives the planner measured sizes."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``, component = smallest reachable node.

    Rounds of contraction: every node hooks onto its smallest neighbour, pointers are jumped
    until they reach roots, edges are rewritten between roots. Each round at least halves the
    nodes that still have edges, and each is written to the shared folder. Nodes without an edge
    are not returned. Loops, repeated edges and nulls are ignored."""
    pairs = (edges.where("src <> dst")
             .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    live = staged(pairs, "cc-edges")
    labels = None
    while not live.isEmpty():
        hooks = (live.select(F.col("b").alias("node"), F.col("a").alias("up"))
                 .union(live.select(F.col("a").alias("node"), F.col("a").alias("up")))
                 .groupBy("node").agg(F.min("up").alias("up")))
        roots = staged(hooks, "cc-hooks")
        while True:
            up = roots.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
            jumped = staged(roots.join(up, roots["up"] == up["__n"])
                            .select("node", F.col("__u").alias("up"), (F.col("__u") != F.col("up")).alias("moved")),
                            "cc-jump")
            roots = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots.select("node", F.col("up").alias("component"))
        else:
            r = roots.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
            labels = staged(labels.join(r, labels["component"] == r["__n"], "left")
                            .select("node", F.coalesce("__u", "component").alias("component")), "cc-labels")
        ra = roots.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        rb = roots.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        live = staged(live.join(ra, "a").join(rb, "b").where("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                      "cc-edges")
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
