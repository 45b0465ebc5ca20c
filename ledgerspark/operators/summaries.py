"""Aggregations A1-A11, A20: each is one hash aggregate with partial (map-side) aggregation.

Grand totals that a share needs are scalar subqueries over the groups (``whole``): they reuse the
groups' exchange, so there is one scan of the rows, no cross join and no global window.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.dates import as_date
from ledgerspark.functions.keys import iso_week_key, month_key, period_key, slug, tx_id
from ledgerspark.functions.money import cents
from ledgerspark.operators.filters import (
    apply_filters, at_most, category_or_uncategorized, date_range, id_filter, money_bound, text_search,
)
from ledgerspark.schema import Filters

UNCATEGORIZED = "uncategorized"


def _total(col: str = "amount") -> Column:
    """SUM of DECIMAL money, exact, reported as DOUBLE; 0.0 on empty input."""
    return F.coalesce(F.sum(col).cast("double"), F.lit(0.0))


def summarize_by_category(ledger: DataFrame, filters: Filters | None = None) -> DataFrame:
    """A1: by ``coalesce(category,'uncategorized')``: total, transactions; total desc."""
    df = apply_filters(ledger, filters, with_merchant_amount=False)
    return (df.groupBy(category_or_uncategorized().alias("category"))
            .agg(_total().alias("total"), F.count(F.lit(1)).alias("transactions"))
            .orderBy(F.desc("total"), F.asc("category")))


def summarize_by_period(ledger: DataFrame, period: str = "month", filters: Filters | None = None) -> DataFrame:
    """A2: by month ``YYYY-MM`` / quarter ``YYYY-Qn`` / year ``YYYY``; period ascending."""
    if period not in ("month", "quarter", "year"):
        raise ValueError(f"invalid period {period!r}")
    df = apply_filters(ledger, filters, with_merchant_amount=False)
    return (df.groupBy(period_key(period).alias("period"))
            .agg(_total().alias("total"), F.count(F.lit(1)).alias("transactions"))
            .orderBy("period"))


def summarize_by_merchant(ledger: DataFrame, filters: Filters | None = None, limit: int | None = None) -> DataFrame:
    """A3: by merchant: total, transactions; total desc (the dashboard keeps the top 15)."""
    df = apply_filters(ledger, filters, with_merchant_amount=False)
    out = (df.groupBy("merchant")
           .agg(_total().alias("total"), F.count(F.lit(1)).alias("transactions"))
           .orderBy(F.desc("total"), F.asc("merchant")))
    return at_most(out, limit)


def overview(ledger: DataFrame, filters: Filters | None = None) -> DataFrame:
    """A4: one row: transactions, total (0.0), average (0.0), first/last date (NULL if empty)."""
    df = apply_filters(ledger, filters, with_merchant_amount=True)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("transactions"),
        _total().alias("total"),
        F.coalesce(F.sum("amount").cast("double") / n, F.lit(0.0)).alias("average"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
    )


def unique_merchants(ledger: DataFrame) -> DataFrame:
    """A5: merchant -> sorted distinct categories (NULL -> 'uncategorized', '' dropped).

    A merchant whose categories are all blank disappears. Merchant ascending.
    """
    cat = category_or_uncategorized()
    return (ledger.select("merchant", cat.alias("category"))
            .filter(F.col("category") != "")
            .groupBy("merchant")
            .agg(F.sort_array(F.collect_set("category")).alias("categories"))
            .orderBy("merchant"))


def list_providers(ledger: DataFrame) -> DataFrame:
    """Distinct non-blank providers, sorted."""
    return (ledger.select("provider")
            .filter(F.col("provider").isNotNull() & (F.trim("provider") != ""))
            .distinct().orderBy("provider"))


def list_categories(ledger: DataFrame) -> DataFrame:
    """Distinct ``coalesce(category,'uncategorized')``, blank dropped, sorted."""
    return (ledger.select(category_or_uncategorized().alias("category"))
            .filter(F.col("category") != "")
            .distinct().orderBy("category"))


# ---- compact rows (integer cents, slug ids) ------------------------------------------

def compact_rows(ledger: DataFrame, start=None, end=None, category_ids=None, merchant_ids=None,
                 account_ids=None, search: str | None = None, min_cents: int | None = None,
                 max_cents: int | None = None) -> DataFrame:
    """The compact-tool row set: all rows in range (no 1000-row cap, D1), id and text filters
    applied before anything is cut (D2), with ``id``, ``amount_cents``, ``account`` and the
    compact ``category`` (NULL or '' -> 'uncategorized')."""
    df = ledger
    if start and end and as_date(start) > as_date(end):
        raise ValueError("startDate must be before endDate")
    rng = date_range(start, end)
    if rng is not None:
        df = df.filter(rng)
    if min_cents is not None:
        df = df.filter(F.col("amount") >= money_bound(Decimal(min_cents) / 100, ROUND_CEILING))
    if max_cents is not None:
        df = df.filter(F.col("amount") <= money_bound(Decimal(max_cents) / 100, ROUND_FLOOR))
    if search and search.strip():
        df = df.filter(text_search(search))
    df = id_filter(df, category_ids, "category")
    df = id_filter(df, merchant_ids, "merchant")
    df = id_filter(df, account_ids, "provider")
    return df.select(
        "date", "description", "merchant", "amount", "provider",
        category_or_uncategorized(blank_too=True).alias("category"),
        tx_id().alias("id"),
        cents("amount").alias("amount_cents"),
        F.coalesce(F.col("provider"), F.lit("")).alias("account"),
    )


def group_key(group_by: str) -> tuple[Column, Column]:
    """(key, label) of a compact row for ``category / merchant / account / month / week``."""
    if group_by == "month":
        lab = month_key()
        return lab, lab
    if group_by == "week":
        lab = iso_week_key()
        return lab, lab
    if group_by == "account":
        lab = F.coalesce(F.when(F.col("account") == "", None).otherwise(F.col("account")), F.lit("unknown"))
        return slug(lab), lab
    if group_by == "merchant":
        lab = F.coalesce(F.when(F.col("merchant") == "", None).otherwise(F.col("merchant")), F.lit("unknown"))
        return slug(lab), lab
    if group_by == "category":
        lab = F.col("category")
        return slug(lab), lab
    raise ValueError(f"invalid groupBy {group_by!r}")


def share_pct(grand: Column, col: str = "total_cents") -> Column:
    """round(100 * group / grand, 1), 0.0 when the grand total is 0 (computed in DOUBLE)."""
    return F.when(grand != 0, F.round(F.col(col).cast("double") * F.lit(100.0) / grand.cast("double"), 1)) \
        .otherwise(F.lit(0.0))


def whole(grouped: DataFrame, **values: Column) -> dict[str, Column]:
    """Aggregates over all groups of ``grouped`` as scalars for use beside the groups themselves. They
    ask for every column of the groups, so both need the very same aggregate, and Spark runs it once
    and reads its exchange twice: one scan of the rows, and no global window over the groups."""
    rest = [F.max(F.col(c)).alias(f"__{c}") for c in grouped.columns]
    one = grouped.agg(F.struct(*[v.alias(n) for n, v in values.items()], *rest).alias("all")).scalar()
    return {n: one[n] for n in values}


def group_totals(rows: DataFrame, group_by: str) -> DataFrame:
    """Groups of compact rows: key, label (first seen by date), total_cents, count."""
    key, label = group_key(group_by)
    return (rows.select(key.alias("key"), label.alias("label"), "date", "amount_cents")
            .groupBy("key")
            .agg(F.min_by("label", F.struct("date", "label")).alias("label"),
                 F.sum("amount_cents").alias("total_cents"),
                 F.count(F.lit(1)).alias("count")))


def group_rows(rows: DataFrame, group_by: str) -> DataFrame:
    """``group_totals`` with share_pct."""
    grouped = group_totals(rows, group_by)
    grand = whole(grouped, total=F.coalesce(F.sum("total_cents"), F.lit(0)))["total"]
    return grouped.withColumn("share_pct", share_pct(grand))


def spend_summary(ledger: DataFrame, group_by: str = "category", start=None, end=None,
                  comparison: str | None = None, limit: int | None = None, **row_filters) -> DataFrame:
    """A7 (and J2 when ``comparison`` is given): groups ordered by total desc.

    The comparison uses one scan over both ranges with conditional sums instead of a join.
    """
    from ledgerspark.functions.dates import comparison_range

    comp = comparison_range(start, end, comparison) if (comparison and start and end) else None
    if comp is None:
        out = group_rows(compact_rows(ledger, start, end, **row_filters), group_by)
    else:
        cur = date_range(start, end)
        base = date_range(*comp)
        rows = compact_rows(ledger, **row_filters).filter(cur | base)
        key, label = group_key(group_by)
        grouped = (rows.select(key.alias("key"), label.alias("label"), "date", "amount_cents",
                               cur.alias("in_cur"), base.alias("in_base"))
                   .groupBy("key")
                   .agg(F.min_by(F.when(F.col("in_cur"), F.col("label")),
                                 F.when(F.col("in_cur"), F.struct("date", "label"))).alias("label"),
                        F.sum(F.when(F.col("in_cur"), F.col("amount_cents"))).alias("total_cents"),
                        F.count(F.when(F.col("in_cur"), F.lit(1))).alias("count"),
                        F.coalesce(F.sum(F.when(F.col("in_base"), F.col("amount_cents"))), F.lit(0)).alias("base_cents"))
                   .filter(F.col("count") > 0))
        grand = whole(grouped, total=F.coalesce(F.sum("total_cents"), F.lit(0)))["total"]
        out = (grouped.withColumn("share_pct", share_pct(grand))
               .withColumn("delta_cents", F.col("total_cents") - F.col("base_cents"))
               .drop("base_cents"))
    out = out.orderBy(F.desc("total_cents"), F.asc("key"))
    return at_most(out, limit)


def merchant_summary(ledger: DataFrame, search: str, start=None, end=None, limit: int = 10) -> DataFrame:
    """Merchants whose name contains ``search`` (case-insensitive): totals, truncated average,
    first/last date; total desc, cut at ``limit``."""
    if not search:
        raise ValueError("merchantSearch required")
    rows = compact_rows(ledger, start, end, search=search) \
        .filter(F.lower(F.col("merchant")).contains(search.lower()))
    lim = max(1, int(limit or 10))
    return (rows.groupBy("merchant")
            .agg(F.sum("amount_cents").alias("total_cents"),
                 F.count(F.lit(1)).alias("count"),
                 F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
                 F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"))
            .select(slug("merchant").alias("id"), F.col("merchant").alias("label"), "total_cents", "count",
                    F.expr("total_cents div count").alias("avg_cents"), "first_date", "last_date")
            .orderBy(F.desc("total_cents"), F.asc("label"))
            .limit(lim))


def merchant_transactions(ledger: DataFrame, search: str, start=None, end=None, limit: int = 10, rows: int = 10) -> DataFrame:
    """A8 with ``includeTransactions``: the first ``rows`` charges by date of each merchant that
    ``merchant_summary`` returns, as ``(id, date, merchant, description, amount_cents, rank)``. ``rank <= rows``
    is applied before the shuffle too (a group limit), so a merchant ships a few rows per task."""
    found = merchant_summary(ledger, search, start, end, limit).select(F.col("label").alias("__merchant"))
    hits = compact_rows(ledger, start, end, search=search).filter(F.lower(F.col("merchant")).contains(search.lower()))
    first = Window.partitionBy("merchant").orderBy("date", "id", "amount_cents")
    return (hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= rows)
            .join(found, F.col("merchant") == F.col("__merchant"), "left_semi")
            .select("id", F.date_format("date", "yyyy-MM-dd").alias("date"), "merchant", "description", "amount_cents", "rank"))


def category_summary(ledger: DataFrame, start=None, end=None, category_ids=None,
                     comparison: str | None = None, limit: int | None = None) -> DataFrame:
    """A7 by category with an id filter."""
    return spend_summary(ledger, "category", start, end, comparison, limit, category_ids=category_ids)


def group_transactions(ledger: DataFrame, key: str, filters: Filters) -> DataFrame:
    """A10: when a merchant filter is present, group the filtered rows by ``key``
    (category or merchant; NULL/'' -> 'uncategorized'): total, transactions; total desc."""
    df = apply_filters(ledger, filters, with_merchant_amount=True)
    label = F.coalesce(F.when(F.col(key) == "", None).otherwise(F.col(key)), F.lit(UNCATEGORIZED))
    return (df.groupBy(label.alias(key))
            .agg(_total().alias("total"), F.count(F.lit(1)).alias("transactions"))
            .orderBy(F.desc("total"), F.asc(key)))


def profile(ledger: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Date range, row count and distinct category / merchant / provider counts in one pass.

    Counts follow A5/A6: categories exclude '', merchants need one non-blank category,
    providers are non-blank. Exact ``count(DISTINCT)`` by default (Spark plans the three in one
    Expand, tripling rows before the shuffle); ``approx=True`` uses HyperLogLog++ sketches
    (``approx_count_distinct``, relative error ``rsd``), which merge map-side and ship one small
    sketch per task instead.
    """
    cat = category_or_uncategorized()
    distinct = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return ledger.agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("end_date"),
        F.count(F.lit(1)).alias("transaction_count"),
        distinct(F.when(cat != "", cat)).alias("category_count"),
        distinct(F.when(cat != "", F.col("merchant"))).alias("merchant_count"),
        distinct(F.when(F.trim("provider") != "", F.col("provider"))).alias("account_count"),
    )


def top_category_share(ledger: DataFrame, filters: Filters | None = None, top: int = 5) -> DataFrame:
    """Top categories with their share of all filtered spend and a bar width relative to
    the largest (at least 2 %)."""
    df = apply_filters(ledger, filters, with_merchant_amount=False)
    groups = df.groupBy(category_or_uncategorized().alias("category")).agg(F.sum("amount").alias("sum"))
    money = F.coalesce(F.col("sum").cast("double"), F.lit(0.0))
    all_of = whole(groups, grand=F.coalesce(F.sum("sum").cast("double"), F.lit(0.0)),
                   biggest=F.greatest(F.coalesce(F.max(money), F.lit(1.0)), F.lit(1.0)))
    grand, biggest = all_of["grand"], all_of["biggest"]
    top_df = groups.select("category", money.alias("total")).orderBy(F.desc("total"), F.asc("category")).limit(top)
    return top_df.select(
        "category", "total",
        F.when(grand > 0, F.col("total") * 100.0 / grand).otherwise(F.lit(0.0)).alias("share_pct"),
        F.greatest(F.col("total") * 100.0 / biggest, F.lit(2.0)).alias("width_pct"),
    )
