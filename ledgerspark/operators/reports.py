"""Report tables: A17 rollup with subtotals, A18 pivot, A19 chart tables, K3 month extract rows,
C15 ledger text lines, C16 display tables.

The zero-filled month x category grid (J6) is a pivot over a fixed category list followed by an
unpivot: one aggregate, no cross join, and every month present in the data gets every category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.keys import month_key, month_label
from ledgerspark.functions.money import currency_text

# fixed values: categories the workbook charts always show (seeded with zero)
CHART_CATEGORIES = ["car", "groceries", "misc", "restaurants", "subscription"]


def month_category_rollup(ledger: DataFrame) -> DataFrame:
    """Category rows per month, a ``<Month yyyy> Total`` row per month and a last
    ``Grand Total`` row, from one ``rollup(month, category)``. ``level``: 0 leaf, 1 month, 3 grand."""
    df = ledger.select(month_key().alias("month"), month_label().alias("month_label"),
                       F.coalesce(F.col("category"), F.lit("")).alias("category"), "amount")
    r = (df.rollup("month", "category")
         .agg(F.sum("amount").cast("double").alias("total"), F.grouping_id().alias("level"),
              F.max("month_label").alias("month_label")))
    label = (F.when(F.col("level") == 0, F.col("month_label"))
             .when(F.col("level") == 1, F.concat(F.col("month_label"), F.lit(" Total")))
             .otherwise(F.lit("Grand Total")))
    return r.select(F.coalesce("month", F.lit("~")).alias("sort_month"), label.alias("label"),
                    F.when(F.col("level") == 0, F.col("category")).alias("category"), "total", "level")


def month_category_long(ledger: DataFrame) -> DataFrame:
    """A18 long form: month, category (NULL -> 'uncategorized'), total."""
    return (ledger.groupBy(month_key().alias("month"),
                           F.coalesce("category", F.lit("uncategorized")).alias("category"))
            .agg(F.sum("amount").cast("double").alias("total")))


def month_category_pivot(ledger: DataFrame, categories: list[str]) -> DataFrame:
    """A18 wide form: one row per month, one column per category plus ``total``. The category
    list is passed in (so Spark needs no extra job to discover pivot values)."""
    cat = F.coalesce("category", F.lit("uncategorized"))
    aggs = [F.coalesce(F.sum(F.when(cat == c, F.col("amount"))).cast("double"), F.lit(0.0)).alias(c)
            for c in categories]
    return ledger.groupBy(month_key().alias("month")).agg(*aggs, F.sum("amount").cast("double").alias("total"))


def chart_monthly(ledger: DataFrame) -> DataFrame:
    """Monthly totals in calendar order (label ``MMMM yyyy``)."""
    return (ledger.groupBy(month_key().alias("month"))
            .agg(F.max(month_label()).alias("label"), F.sum("amount").cast("double").alias("total"))
            .orderBy("month"))


def chart_category_month(ledger: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """For every month with data and every chart category (matched case-insensitively),
    the total or 0."""
    cats = list(categories or CHART_CATEGORIES)
    norm = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    wide = ledger.groupBy(month_key().alias("month")).agg(
        *[F.coalesce(F.sum(F.when(norm == c, F.col("amount"))).cast("double"), F.lit(0.0)).alias(c) for c in cats])
    return wide.unpivot(["month"], cats, "category", "total")


def chart_categories(ledger: DataFrame, seed: list[str] | None = None) -> DataFrame:
    """Category totals descending; blank categories dropped; ``seed`` categories appear with
    0 when absent (the workbook variant)."""
    cat = F.trim(F.coalesce("category", F.lit("")))
    out = (ledger.filter(cat != "").groupBy(cat.alias("category"))
           .agg(F.sum("amount").cast("double").alias("total")))
    if seed:
        seeded = ledger.sparkSession.createDataFrame([(c, 0.0) for c in seed], "category STRING, total DOUBLE")
        out = out.unionByName(seeded).groupBy("category").agg(F.sum("total").alias("total"))
    return out.orderBy(F.desc("total"), F.asc("category"))


def month_extract_rows(ledger: DataFrame, sort: str = "abs") -> DataFrame:
    """K3 rows: month label + row, ordered by month then abs(amount) (or amount) descending.
    The global order is a range-partitioned sort, not a per-month window."""
    key = F.abs(F.col("amount")) if sort == "abs" else F.col("amount")
    return (ledger.select(month_key().alias("month_key"), month_label().alias("month"), "date", "description",
                          "merchant", "category", "amount", key.alias("__k"))
            .orderBy("month_key", F.desc("__k"), "date", "merchant", "description").drop("__k"))


def text_lines(ledger: DataFrame) -> DataFrame:
    """``date | description | merchant | 0.00`` per row (the report input text)."""
    return ledger.select("date", F.concat_ws(" | ", F.date_format("date", "yyyy-MM-dd"), "description", "merchant",
                                             F.col("amount").cast("decimal(18,2)").cast("string")).alias("line"))


def transactions_table(page: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` rows of an ordered page as text, blanks named."""
    named = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    return page.limit(top).select(F.date_format("date", "yyyy-MM-dd").alias("date"), named("merchant", "Unknown").alias("merchant"),
                                  named("category", "uncategorized").alias("category"), currency_text("amount").alias("amount"),
                                  named("description", "").alias("description"))


def recurring_table(months: DataFrame, top: int = 8) -> DataFrame:
    """The first ``top`` rows of C4 as text."""
    return months.limit(top).select("merchant", currency_text("total").alias("total"), currency_text("average").alias("average"),
                                    F.col("transactions").cast("string").alias("transactions"),
                                    F.array_join("months", ", ").alias("months"))


def unusual_table(unusual: DataFrame, top: int = 8) -> DataFrame:
    """The first ``top`` rows of C7 as text."""
    merchant = F.coalesce(F.when(F.col("merchant") != "", F.col("merchant")), F.lit("Unknown"))
    return unusual.limit(top).select(F.date_format("date", "yyyy-MM-dd").alias("date"), merchant.alias("merchant"),
                                     currency_text("amount").alias("amount"), currency_text("merchant_average").alias("average"),
                                     currency_text("difference").alias("difference"))


def summary_table(by_category: DataFrame, top: int = 8) -> DataFrame:
    """The first ``top`` summary rows with currency text."""
    return by_category.limit(top).select("category", currency_text("total").alias("total_text"), "transactions")
