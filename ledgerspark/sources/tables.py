"""Views that shape the driver's TPC-H-like tables into the LEDGER and EVENTS schemas.

``ledger_orders``  orders x customer: one spend row per order.
``ledger_lines``   lineitem x part: one spend row per line, categorized by keyword rules.
``usage_events``   events re-cast as UI usage events with sessions and JSON metadata.

The joins are plain equi-joins: Catalyst prunes columns and pushes filters into both scans, and
AQE turns them into broadcast joins only when the runtime size of the small side is under
``spark.sql.autoBroadcastJoinThreshold`` (a measured bound), else keeps a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.schema import MONEY

# ---- fixed values: keyword rules used to categorize `ledger_lines` ---------------------
# Ordered: the first category with a keyword contained in merchant or description wins.
CATEGORY_RULES: list[tuple[str, list[str]]] = [
    ("premium", ["brand#13"]),
    ("hardware", ["bolt", "rod"]),
    ("heavy", ["anvil", "plate"]),
    ("jewelry", ["ring"]),
    ("gadgets", ["widget", "gizmo"]),
]
# Driver event types re-cast as UI usage event types.
EVENT_TYPE_MAP = {
    "view": "page_view",
    "click": "filter_changed",
    "purchase": "search_submitted",
    "error": "search_zero_results",
    "signup": "sort_changed",
}
PAGES = ["/transactions", "/dashboard", "/insights", "/settings"]
COMPONENTS = ["FiltersPanel", "TransactionTable", "AppLayout"]
# ---------------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        .select(
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderpriority").alias("description"),
            F.col("c_name").alias("merchant"),
            F.col("o_totalprice").cast(MONEY).alias("amount"),
            F.expr("nullif(lower(c_mktsegment), 'household')").alias("category"),
            F.lower("o_orderstatus").alias("provider"),
        )
    )


def ledger_lines(spark: SparkSession, sf_dir: str, categorized: bool = True) -> DataFrame:
    from ledgerspark.operators.categorize import categorize

    lineitem = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    df = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey, "inner")
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("p_name").alias("description"),
            F.col("p_brand").alias("merchant"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
            F.lower("l_returnflag").alias("provider"),
        )
    )
    if categorized:
        df = categorize(df, CATEGORY_RULES)
    else:
        df = df.withColumn("category", F.lit(None).cast("string"))
    return df.select("date", "description", "merchant", "amount", "category", "provider")


def _pick(values: list[str], idx: Column) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENTS view: session = user and UTC day; metadata JSON built from the `k` prop."""
    # parse the JSON prop once; every derived column below reads the parsed value
    ev = read_table(spark, sf_dir, "events").withColumn("__k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("__k")
    etype = F.col("event_type")
    mapped = None
    for src, dst in EVENT_TYPE_MAP.items():
        mapped = F.when(etype == src, F.lit(dst)) if mapped is None else mapped.when(etype == src, F.lit(dst))
    mapped = mapped.otherwise(etype)
    mapped = (F.when((etype == "view") & (k % 10 == 9), F.lit("session_ended"))
              .when((etype == "error") & (k % 5 == 4), F.lit("search_abandoned"))
              .otherwise(mapped))
    ts = F.col("ts").cast("timestamp")
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))

    def s(x) -> Column:
        return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")

    meta = (
        F.when(etype == "click", F.when(
            k % 10 == 0,
            F.concat(F.lit('{"field":"f'), s(k % 4), F.lit('","selected":"v'), s(k % 3), F.lit('"}')),
        ).otherwise(F.concat(F.lit('{"filter":"f'), s(k % 4), F.lit('","value":"v'), s(k % 3), F.lit('"}'))))
        .when(etype == "signup", F.when(
            k % 7 == 0, F.concat(F.lit('{"sort":"s'), s(k % 3), F.lit('"}')),
        ).otherwise(F.concat(F.lit('{"direction":"'), F.when(k % 2 == 0, "asc").otherwise("desc"),
                             F.lit('","sort":"s'), s(k % 3), F.lit('"}'))))
        .when(etype == "purchase", F.concat(F.lit('{"query":"q'), s(k % 25),
                                            F.lit('","resultcount":'), s(k % 4), F.lit("}")))
        .when(etype == "error", F.concat(F.lit('{"query":"q'), s(k % 25), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"k":'), s(k), F.lit("}")))
    )
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        user.alias("user_id"),
        # the day of the stored wall-clock value (TIMESTAMP_NTZ): independent of the session zone
        F.concat(user, F.lit("-"), F.date_format(F.col("ts"), "yyyyMMdd")).alias("session_id"),
        mapped.alias("event_type"),
        _pick(PAGES, k % 4).alias("page"),
        F.when(etype == "view", F.lit(None).cast("string")).otherwise(_pick(COMPONENTS, k % 3)).alias("component"),
        meta.alias("metadata_json"),
        ts.alias("ts"),
        F.col("value").alias("value"),
    )
