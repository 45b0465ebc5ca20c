"""C11 dimension search, over a ledger or over a stored text index of its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.keys import slug
from ledgerspark.operators.summaries import list_categories, list_providers, unique_merchants

TYPES = ("merchant", "category", "account")
GRAM = 3  # characters of the index's q-grams
BUCKETS = 64  # partitions of the index, by the hash of a q-gram


def dimensions(ledger: DataFrame, types=None) -> DataFrame:
    """(type_rank, type, id, label, aliases) of every merchant (with its first three categories),
    category and account."""
    wanted = set(types or TYPES)
    none = F.lit(None).cast("array<string>")
    parts = []
    for rank, (name, rows, col, aliases) in enumerate((
            ("merchant", unique_merchants, "merchant", F.slice("categories", 1, 3) if "merchant" in wanted else none),
            ("category", list_categories, "category", none), ("account", list_providers, "provider", none))):
        if name in wanted:
            parts.append(rows(ledger).select(F.lit(rank).alias("type_rank"), F.lit(name).alias("type"), slug(col).alias("id"),
                                             F.col(col).alias("label"), aliases.alias("aliases")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _best(found: DataFrame, limit: int | None) -> DataFrame:
    return found.orderBy("type_rank", "label").limit(max(1, int(limit or 10))).drop("type_rank")


def search_dimensions(ledger: DataFrame, query: str, types=None, limit: int | None = 10) -> DataFrame:
    """Case-insensitive substring over merchants, then categories, then accounts:
    type, id (slug), label, aliases (a merchant's first three categories)."""
    if not query:
        raise ValueError("query required")
    return _best(dimensions(ledger, types).filter(F.lower("label").contains(F.lower(F.lit(query)))), limit)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_text_index(path: str, ledger: DataFrame) -> None:
    """Store the ledger's dimensions and an inverted list of their labels' q-grams, in partitions by
    q-gram. It is as large as the distinct labels, whatever the number of ledger rows."""
    dims = dimensions(ledger)
    dims.write.mode("overwrite").parquet(f"{path}/dimensions")
    dims = ledger.sparkSession.read.parquet(f"{path}/dimensions")
    low = F.lower("label")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM))))
    lists = (dims.filter(F.length(low) >= GRAM).select("type_rank", "label", F.explode(grams).alias("gram"))
             .withColumn("bucket", _bucket(F.col("gram"))))
    (lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite")
     .partitionBy("bucket").parquet(f"{path}/grams"))


def search_text_index(spark: SparkSession, path: str, query: str, types=None, limit: int | None = 10) -> DataFrame:
    """``search_dimensions`` from the index: labels that hold every q-gram of the query (only the
    partitions and row groups of these are read), then tested exactly. Queries shorter than a
    q-gram go through the stored dimensions."""
    if not query:
        raise ValueError("query required")
    dims = spark.read.parquet(f"{path}/dimensions")
    low = spark.range(1).select(F.lower(F.lit(query))).first()[0]  # lower-cased as the labels are
    if len(low) >= GRAM:
        grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
        rows = spark.createDataFrame([(g,) for g in grams], "gram STRING").select("gram", _bucket(F.col("gram")).alias("b")).collect()
        held = spark.read.parquet(f"{path}/grams").filter(
            F.col("bucket").isin(*{r.b for r in rows}) & F.col("gram").isin(*grams))
        # every list names a label once
        labels = (held.groupBy("type_rank", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
                  .select("type_rank", "label"))
        dims = dims.join(labels, ["type_rank", "label"], "left_semi")
    wanted = F.col("type").isin(*(types or TYPES))
    return _best(dims.filter(wanted & F.lower("label").contains(low)).select("type_rank", "type", "id", "label", "aliases"), limit)
