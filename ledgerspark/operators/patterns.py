"""Spending patterns: W1 gaps, C3/C4 recurring charges, C5-C7 anomalies, C8 category insight.

Per-merchant statistics are a ``groupBy(merchant)`` (partial aggregation) joined back to the
rows by merchant (J3), never a ``Window.partitionBy(merchant)``: a merchant holding a third of
all rows would put them all in one task, while the aggregate ships one partial row per task
and AQE's skew-join handling splits the hot side of the join-back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.keys import month_key
from ledgerspark.operators.filters import apply_filters, at_most, flagged
from ledgerspark.operators.summaries import compact_rows, group_totals, whole
from ledgerspark.schema import Filters

SENSITIVITY = {"low": 2.0, "medium": 1.5, "high": 1.0}   # fixed values: anomaly factors
MIN_SPIKE_CENTS = 2500                                    # fixed value: 25.00 floor


def charge_gaps(ledger: DataFrame, merchant: str = "merchant") -> DataFrame:
    """Days since the previous charge of the same merchant (NULL for the first).

    A merchant may hold a third of all rows, so no window runs over rows: the gap depends on the
    merchant's days only. Days come from an aggregate (one row per merchant and day) and the window
    runs over them. Equal rows are counted, so that only one copy of a day's first charge (by
    amount, description, then the other columns) gets the gap; the day's other charges get 0.
    """
    rest = list(dict.fromkeys(["amount", "description", *[c for c in ledger.columns if c not in (merchant, "date")]]))
    rows = ledger.groupBy(merchant, "date", *rest).agg(F.count(F.lit(1)).alias("__n"))
    days = rows.groupBy(F.col(merchant).alias("__m"), F.col("date").alias("__d")).agg(F.min(F.struct(*rest)).alias("__first"))
    days = days.withColumn("__prev", F.lag("__d").over(Window.partitionBy("__m").orderBy("__d")))
    out = rows.join(days, rows[merchant].eqNullSafe(days["__m"]) & rows["date"].eqNullSafe(days["__d"]))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    opens = (F.col("__copy") == 1) & F.struct(*rest).eqNullSafe(F.col("__first"))
    return out.select(*ledger.columns, F.datediff("date", F.when(opens, F.col("__prev")).otherwise(F.col("date"))).alias("gap_days"))


def recurring(ledger: DataFrame, start=None, end=None, min_occurrences: int = 3,
              include_inactive: bool = False, limit: int | None = 50) -> DataFrame:
    """Merchants with >= ``min_occurrences`` charges; cadence from the mean day gap.

    The mean of consecutive gaps telescopes to (last - first) / (n - 1), so one aggregate
    gives it. Inactive (dropped) when ``end`` is given and end - last > max(2 * gap, 45).
    """
    from ledgerspark.functions.dates import as_date

    rows = compact_rows(ledger, start, end)
    order = F.struct("date", "amount_cents", "description", "category")
    g = (rows.groupBy("merchant")
         .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
              F.sum("amount_cents").alias("sum_cents"),
              F.max_by("amount_cents", order).alias("last_amount_cents"),
              F.max_by("category", order).alias("category"))
         .filter(F.col("n") >= min_occurrences))
    gap = F.when(F.col("n") > 1, F.expr("datediff(last, first) div (n - 1)")).otherwise(F.lit(0))
    g = g.withColumn("avg_gap", gap.cast("int"))
    if not include_inactive and as_date(end):
        stale = F.datediff(F.lit(as_date(end)), F.col("last")) > F.greatest(F.col("avg_gap") * 2, F.lit(45))
        g = g.filter(~stale)
    cadence = (F.when(F.col("avg_gap").between(25, 35), F.lit("monthly"))
               .when(F.col("avg_gap").between(5, 9), F.lit("weekly")).otherwise(F.lit("irregular")))
    conf = F.round(F.least(F.lit(0.95), F.col("n") / F.lit(float(max(min_occurrences, 1))) * F.lit(0.3)), 2)
    out = g.select(
        "merchant", cadence.alias("cadence"),
        F.expr("sum_cents div n").alias("avg_amount_cents"), "last_amount_cents",
        F.date_format("last", "yyyy-MM-dd").alias("last_date"), conf.alias("confidence"), "category",
    ).orderBy(F.desc("confidence"), F.desc("avg_amount_cents"), F.asc("merchant"))
    return at_most(out, limit)


def recurring_months(ledger: DataFrame, filters: Filters | None = None, limit: int | None = 20,
                     flag: bool = False) -> DataFrame:
    """C4: merchants (blank -> 'unknown') seen >= 2 times in >= 2 distinct months: count, sorted
    months, mean, total, latest date; by number of months then total, descending. ``flag`` adds
    ``truncated``: whether there are more than ``limit``."""
    df = apply_filters(ledger, filters, with_merchant_amount=True)
    m = F.coalesce(F.when(F.col("merchant") == "", None).otherwise(F.col("merchant")), F.lit("unknown"))
    g = (df.groupBy(m.alias("merchant"))
         .agg(F.count(F.lit(1)).alias("transactions"),
              F.sort_array(F.collect_set(month_key())).alias("months"),
              F.sum("amount").alias("sum_amount"),
              F.max("date").alias("latest"))
         .filter((F.size("months") >= 2) & (F.col("transactions") >= 2)))
    out = g.select(
        "merchant", "transactions", "months",
        (F.col("sum_amount").cast("double") / F.col("transactions")).alias("average"),
        F.col("sum_amount").cast("double").alias("total"),
        F.date_format("latest", "yyyy-MM-dd").alias("latest_date"),
    ).orderBy(F.desc(F.size("months")), F.desc("total"), F.asc("merchant"))
    return flagged(out, limit) if flag else at_most(out, limit)


def _merchant_stats(rows: DataFrame, value: str, key: Column) -> DataFrame:
    return (rows.groupBy(key.alias("__m"))
            .agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__sum"),
                 F.stddev_pop(F.col(value).cast("double")).alias("__sd"))
            .filter(F.col("__n") >= 2))


def anomalies_transactions(ledger: DataFrame, start, end, sensitivity: str = "medium",
                           limit: int | None = 10) -> DataFrame:
    """A charge is a spike when cents > int(mean) + int(max(pstdev * factor, 2500)) over
    its merchant's charges in range (merchants with >= 2 charges)."""
    factor = SENSITIVITY.get(sensitivity, 1.5)
    rows = compact_rows(ledger, start, end)
    stats = _merchant_stats(rows, "amount_cents", F.col("merchant"))
    j = rows.join(stats, rows["merchant"] == stats["__m"], "inner")
    expected = F.expr("__sum div __n")
    threshold = expected + F.greatest(F.col("__sd") * factor, F.lit(float(MIN_SPIKE_CENTS))).cast("bigint")
    out = (j.filter(F.col("amount_cents") > threshold)
           .select("id", F.col("merchant").alias("label"), expected.alias("expected_cents"),
                   F.col("amount_cents").alias("actual_cents"),
                   (F.col("amount_cents") - expected).alias("delta_cents"),
                   F.lit(0.7).alias("confidence"), F.lit("transaction_spike").alias("explanation_code"))
           .orderBy(F.desc("delta_cents"), F.asc("id")))
    return at_most(out, limit)


def anomalies_groups(ledger: DataFrame, start, end, dimension: str = "category",
                     sensitivity: str = "medium", limit: int | None = 10) -> DataFrame:
    """Group totals (all groups, D1) vs int(mean) + max(pstdev * factor, 2500) across groups.
    The cross-group statistics are one scalar subquery over the groups, whose exchange it reuses."""
    factor = SENSITIVITY.get(sensitivity, 1.5)
    groups = group_totals(compact_rows(ledger, start, end), dimension)
    stats = whole(groups, n=F.count(F.lit(1)),
                  expected=F.expr("CAST(COALESCE(sum(total_cents), 0) div greatest(count(1), 1) AS BIGINT)"),
                  spread=F.when(F.count(F.lit(1)) > 1, F.stddev_pop(F.col("total_cents").cast("double"))).otherwise(F.lit(0.0)))
    n, expected, spread = stats["n"], stats["expected"], stats["spread"]
    thr = expected.cast("double") + F.greatest(spread * factor, F.lit(float(MIN_SPIKE_CENTS)))
    out = (groups.filter((n > 0) & (F.col("total_cents").cast("double") > thr))
           .select("label", expected.alias("expected_cents"), F.col("total_cents").alias("actual_cents"),
                   (F.col("total_cents") - expected).alias("delta_cents"), F.lit(0.65).alias("confidence"),
                   F.lit(f"{dimension}_spike").alias("explanation_code"))
           .orderBy(F.desc("delta_cents"), F.asc("label")))
    return at_most(out, limit)


def unusual_spend(ledger: DataFrame, filters: Filters | None = None, limit: int | None = 20,
                  flag: bool = False) -> DataFrame:
    """Rows above mean + max(1.5 * pstdev, 0.5 * mean, 25) of their merchant (>= 2 rows;
    blank merchant -> 'unknown'), by difference descending. ``flag`` adds ``truncated``."""
    df = apply_filters(ledger, filters, with_merchant_amount=True)
    m = F.coalesce(F.when(F.col("merchant") == "", None).otherwise(F.col("merchant")), F.lit("unknown"))
    df = df.withColumn("__mk", m)
    stats = _merchant_stats(df, "amount", F.col("__mk"))
    j = df.join(stats, df["__mk"] == stats["__m"], "inner")
    mean = F.col("__sum").cast("double") / F.col("__n")
    amt = F.col("amount").cast("double")
    thr = mean + F.greatest(F.col("__sd") * 1.5, mean * 0.5, F.lit(25.0))
    out = (j.filter(amt > thr)
           .select("date", "description", "merchant", "amount", "category", "provider",
                   mean.alias("merchant_average"), (amt - mean).alias("difference"))
           .orderBy(F.desc("difference"), F.asc("date"), F.asc("merchant"), F.asc("description")))
    return flagged(out, limit) if flag else at_most(out, limit)


# ---- C8: category insight ---------------------------------------------------------------

def _category_rows(ledger: DataFrame, category: str, start=None, end=None) -> DataFrame:
    if not category:
        raise ValueError("category must be provided")
    return apply_filters(ledger, Filters(start=start, end=end, category=category), with_merchant_amount=False)


def _cells(ledger: DataFrame, category: str, start=None, end=None) -> DataFrame:
    """The category's sums by merchant and month, from which all sections but the top charges derive."""
    return (_category_rows(ledger, category, start, end).groupBy("merchant", month_key().alias("period"))
            .agg(F.sum("amount").alias("sum"), F.count(F.lit(1)).alias("n")))


def _merchants(cells: DataFrame) -> DataFrame:
    return cells.groupBy("merchant").agg(F.sum("sum").alias("sum"), F.sum("n").alias("transactions"),
                                         F.count("period").alias("periods"))


def _top_merchants(merchants: DataFrame, top: int) -> tuple[DataFrame, Column, Column]:
    """The top merchants with their share, the category's total and its number of charges."""
    all_of = whole(merchants, total=F.coalesce(F.sum("sum").cast("double"), F.lit(0.0)), n=F.coalesce(F.sum("transactions"), F.lit(0)))
    total = all_of["total"]
    out = (merchants.select("merchant", F.col("sum").cast("double").alias("total"), "transactions")
           .orderBy(F.desc("total"), F.asc("merchant")).limit(top)
           .withColumn("spend_share", F.when(total != 0, F.col("total") / total).otherwise(F.lit(0.0))))
    return out, total, all_of["n"]


def insight_merchants(ledger: DataFrame, category: str, start=None, end=None, top: int = 5) -> DataFrame:
    rows = _category_rows(ledger, category, start, end)
    merchants = rows.groupBy("merchant").agg(F.sum("amount").alias("sum"), F.count(F.lit(1)).alias("transactions"))
    return _top_merchants(merchants, top)[0]


def insight_months(ledger: DataFrame, category: str, start=None, end=None, max_periods: int = 12) -> DataFrame:
    """The last ``max_periods`` months (a top-k by period descending, no global sort)."""
    rows = _category_rows(ledger, category, start, end)
    g = (rows.groupBy(month_key().alias("period"))
         .agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("transactions")))
    return g.orderBy(F.desc("period")).limit(max_periods) if max_periods > 0 else g


def insight_top_transactions(ledger: DataFrame, category: str, start=None, end=None, top: int = 5) -> DataFrame:
    rows = _category_rows(ledger, category, start, end)
    return (rows.orderBy(F.desc("amount"), F.asc("date"), F.asc("merchant"), F.asc("description")).limit(top)
            .select(F.date_format("date", "yyyy-MM-dd").alias("date"), "merchant",
                    F.col("amount").cast("double").alias("amount")))


def insight_findings(ledger: DataFrame, category: str, start=None, end=None, top_merchants: int = 5,
                     max_periods: int = 12, max_opportunities: int = 3) -> DataFrame:
    """C8 findings, only when the category total > 0: merchant concentration (top share >= 0.30),
    high frequency (among the top merchants: n >= 3 and n >= max(1, int(0.4 * count))), recent
    spike (> 1 kept month and last month > 1.2 * total / kept months). Columns: rank, type,
    merchant, period, value."""
    cells = _cells(ledger, category, start, end)
    found, total, count = _top_merchants(_merchants(cells), top_merchants)
    merchants = found.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("total"), F.asc("merchant"))))
    months = cells.groupBy("period").agg(F.sum("sum").cast("double").alias("total"), F.sum("n").alias("transactions"))
    months = months.orderBy(F.desc("period")).limit(max_periods) if max_periods > 0 else months
    conc = (merchants.filter((F.col("pos") == 1) & (total > 0) & (F.col("spend_share") >= 0.3))
            .select(F.lit(1).alias("rank"), F.lit("merchant_concentration").alias("type"), "merchant",
                    F.lit(None).cast("string").alias("period"), F.round("spend_share", 4).alias("value")))
    freq = (merchants.agg(F.max_by(F.struct("merchant", "transactions"),
                                   F.struct("transactions", (-F.col("pos")).alias("p"))).alias("m"))
            .select("m.*")
            .filter((total > 0) & (F.col("transactions") >= 3)
                    & (F.col("transactions") >= F.greatest(F.lit(1), F.floor(count * 0.4))))
            .select(F.lit(2).alias("rank"), F.lit("high_frequency_merchant").alias("type"), "merchant",
                    F.lit(None).cast("string").alias("period"), F.col("transactions").cast("double").alias("value")))
    # few months: the last one and their number from one small aggregate
    last = months.agg(F.count(F.lit(1)).alias("kept"), F.max(F.struct("period", "total", "transactions")).alias("m"))
    spike = (last.filter((F.col("kept") > 1) & (total > 0) & (F.col("m.total") > total / F.col("kept") * 1.2))
             .select(F.lit(3).alias("rank"), F.lit("recent_spike").alias("type"),
                     F.lit(None).cast("string").alias("merchant"), "m.period", F.col("m.total").alias("value")))
    out = conc.unionByName(freq).unionByName(spike)
    return out.orderBy("rank").limit(max_opportunities) if max_opportunities > 0 else out
