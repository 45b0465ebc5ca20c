"""Period comparisons.

Both periods come from ONE scan: each row is tagged ``in_a`` / ``in_b`` by date predicates and
a single ``groupBy(key)`` takes conditional sums. That is the full outer join of the two grouped
periods (a key missing on one side sums to 0) without a join or a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.filters import apply_filters, at_most, date_range
from ledgerspark.operators.summaries import compact_rows, group_key
from ledgerspark.schema import Filters


def _both_periods(ledger: DataFrame, a, b, **row_filters):
    in_a, in_b = date_range(*a), date_range(*b)
    rows = compact_rows(ledger, **row_filters).filter(in_a | in_b)
    return rows.withColumn("in_a", in_a).withColumn("in_b", in_b)


def period_totals(ledger: DataFrame, a, b, **row_filters) -> DataFrame:
    """C1 headline: one row with both totals and counts and ``delta_cents`` = A - B."""
    rows = _both_periods(ledger, a, b, **row_filters)
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("in_a"), F.col("amount_cents"))), F.lit(0)).alias("a_total_cents"),
        F.count(F.when(F.col("in_a"), 1)).alias("a_count"),
        F.coalesce(F.sum(F.when(F.col("in_b"), F.col("amount_cents"))), F.lit(0)).alias("b_total_cents"),
        F.count(F.when(F.col("in_b"), 1)).alias("b_count"),
    ).withColumn("delta_cents", F.col("a_total_cents") - F.col("b_total_cents"))


def compare_periods(ledger: DataFrame, a, b, group_by: str = "category", limit: int | None = None,
                    **row_filters) -> DataFrame:
    """C1 drivers (J1): per key current (A), baseline (B) and delta; abs(delta) descending.
    The label comes from A when the key has rows there, else from B."""
    if group_by == "none":
        return period_totals(ledger, a, b, **row_filters)
    rows = _both_periods(ledger, a, b, **row_filters)
    key, label = group_key(group_by)
    ia, ib = F.col("in_a"), F.col("in_b")
    order = F.struct("date", "label")
    out = (rows.select(key.alias("key"), label.alias("label"), "date", "amount_cents", "in_a", "in_b")
           .groupBy("key")
           .agg(F.min_by(F.when(ia, F.col("label")), F.when(ia, order)).alias("label_a"),
                F.min_by(F.when(ib, F.col("label")), F.when(ib, order)).alias("label_b"),
                F.coalesce(F.sum(F.when(ia, F.col("amount_cents"))), F.lit(0)).alias("current_cents"),
                F.coalesce(F.sum(F.when(ib, F.col("amount_cents"))), F.lit(0)).alias("baseline_cents"))
           .select("key", F.coalesce("label_a", "label_b").alias("label"), "current_cents", "baseline_cents",
                   (F.col("current_cents") - F.col("baseline_cents")).alias("delta_cents"))
           .orderBy(F.desc(F.abs(F.col("delta_cents"))), F.asc("key")))
    return at_most(out, limit)


def top_drivers(ledger: DataFrame, current, baseline, dimension: str = "category",
                limit: int | None = 10) -> DataFrame:
    """C1 drivers plus a reason: decrease if delta < 0; new if baseline = 0 and current > 0;
    else increase (a zero delta too)."""
    d = compare_periods(ledger, current, baseline, dimension, limit)
    reason = (F.when(F.col("delta_cents") < 0, F.lit("decrease"))
              .when((F.col("baseline_cents") == 0) & (F.col("current_cents") > 0), F.lit("new"))
              .otherwise(F.lit("increase")))
    return d.withColumn("reason_code", reason)


def period_breakdown(ledger: DataFrame, periods: dict, shared: Filters | None = None,
                     dimension: str = "category", top: int = 20) -> DataFrame:
    """Per labelled period, the top categories (or merchants) by total.

    The totals honour the merchant filter; the breakdowns ignore it (as the reference does).
    Periods are tagged in one scan; the top-N per period is a group limit over the grouped result.
    """
    base = apply_filters(ledger, (shared or Filters()).without_merchant(), with_merchant_amount=True)
    # a row may fall in two overlapping periods: explode the list of matching labels
    labels = F.array_compact(F.array(*[F.when(date_range(s, e), F.lit(lbl)) for lbl, (s, e) in periods.items()]))
    tagged = base.withColumn("period", F.explode(labels))
    keycol = F.coalesce(F.col(dimension), F.lit("uncategorized")) if dimension == "category" else F.col(dimension)
    grouped = (tagged.groupBy("period", keycol.alias(dimension))
               .agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("transactions")))
    # rank <= top is applied per task before the shuffle by period (a group limit): few rows travel
    best = Window.partitionBy("period").orderBy(F.desc("total"), F.asc(dimension))
    return grouped.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def period_totals_filtered(ledger: DataFrame, periods: dict, shared: Filters | None = None) -> DataFrame:
    """C9 totals per labelled period (merchant filter honoured), one scan."""
    base = apply_filters(ledger, shared or Filters(), with_merchant_amount=True)
    labels = F.array_compact(F.array(*[F.when(date_range(s, e), F.lit(lbl)) for lbl, (s, e) in periods.items()]))
    return (base.withColumn("period", F.explode(labels)).groupBy("period")
            .agg(F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total"),
                 F.count(F.lit(1)).alias("transactions")))


def comparison_card(totals: DataFrame, a_label: str, b_label: str) -> DataFrame:
    """delta = B - A; pct = abs(delta) / A * 100 (0 when A = 0); trend up/down/flat."""
    from ledgerspark.functions.money import currency_text

    t = totals.groupBy().agg(
        F.coalesce(F.max(F.when(F.col("period") == a_label, F.col("total"))), F.lit(0.0)).alias("a_total"),
        F.coalesce(F.max(F.when(F.col("period") == b_label, F.col("total"))), F.lit(0.0)).alias("b_total"))
    delta = F.col("b_total") - F.col("a_total")
    return t.select(
        "a_total", "b_total", delta.alias("delta"),
        F.when(F.col("a_total") != 0, F.abs(delta) / F.col("a_total") * 100).otherwise(F.lit(0.0)).alias("pct"),
        F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat").alias("trend"),
        F.when(delta > 0, "Increase").when(delta < 0, "Decrease").otherwise("No change").alias("delta_label"),
        currency_text(F.col("a_total")).alias("left_value"), currency_text(F.col("b_total")).alias("right_value"),
    ).withColumn("delta_value", F.concat(
        F.when(F.col("delta") > 0, "+").when(F.col("delta") < 0, "-").otherwise(""),
        currency_text(F.abs(F.col("delta"))), F.lit(" ("), F.format_number(F.col("pct"), 1), F.lit("%)")))
