"""Ledger predicates as Columns, so Catalyst pushes them into the Parquet scan."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.dates import as_date
from ledgerspark.functions.keys import slug
from ledgerspark.schema import MONEY, Filters

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def date_range(start=None, end=None, col: str = "date") -> Column | None:
    """Inclusive bounds, each optional."""
    preds = []
    if as_date(start):
        preds.append(F.col(col) >= F.lit(as_date(start)))
    if as_date(end):
        preds.append(F.col(col) <= F.lit(as_date(end)))
    return reduce(lambda a, b: a & b, preds) if preds else None


def merchant_like(text: str, col: str = "merchant") -> Column:
    """P5: SQL ``LIKE '%text%'`` with ASCII-only case folding; user ``%``/``_`` stay wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return _ascii_lower(F.col(col)).like(pattern.translate(str.maketrans(_UPPER, _LOWER)))


def merchant_regex(pattern: str, col: str = "merchant") -> Column:
    """Case-insensitive regex search."""
    return F.coalesce(F.col(col), F.lit("")).rlike("(?i)" + pattern)


def exclude_category(value: str, col: str = "category") -> Column:
    """``lower(trim(coalesce(category,''))) != lower(trim(value))``."""
    return F.lower(F.trim(F.coalesce(F.col(col), F.lit("")))) != value.strip().lower()


def month_filter(month: str, col: str = "date") -> Column:
    """Rows in ``YYYY-MM`` (a range predicate, so it prunes files and partitions)."""
    from ledgerspark.functions.dates import add_months

    year, mon = (int(x) for x in month.split("-"))
    first = as_date(f"{year:04d}-{mon:02d}-01")
    return (F.col(col) >= F.lit(first)) & (F.col(col) < F.lit(add_months(first, 1)))


def money_bound(value, rounding: str) -> Column:
    """An amount bound in the ledger's own DECIMAL type, so that it reaches the Parquet scan. Bounds
    with more than two places move to the next amount inside the range."""
    return F.lit(Decimal(str(value)).quantize(Decimal("0.01"), rounding)).cast(MONEY)


def flagged(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of an ordered frame with ``truncated``: whether it holds more. One top-k
    of ``limit + 1`` rows, whose order the position column keeps; the window runs over those only."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    top = df.limit(limit + 1)
    whole = Window.partitionBy()
    top = top.withColumn("__at", F.monotonically_increasing_id())
    return (top.withColumn("truncated", F.count(F.lit(1)).over(whole) > limit)
            .withColumn("__n", F.row_number().over(whole.orderBy("__at"))).filter(F.col("__n") <= limit)
            .drop("__n", "__at"))


def at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; all of them without a limit. A limit below 1 is an error."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return df.limit(limit)


def predicates(f: Filters, with_merchant_amount: bool = True) -> list[Column]:
    """The filter builder. The short form (summaries) has no merchant/amount predicates."""
    preds: list[Column] = []
    rng = date_range(f.start, f.end)
    if rng is not None:
        preds.append(rng)
    cats = f.selected_categories()
    if cats:
        preds.append(F.col("category").isin(cats))
    if f.exclude_category:
        preds.append(exclude_category(f.exclude_category))
    if f.provider:
        preds.append(F.col("provider") == f.provider)
    if with_merchant_amount:
        if f.merchant:
            preds.append(merchant_like(f.merchant))
        if f.min_amount is not None:
            preds.append(F.col("amount") >= money_bound(f.min_amount, ROUND_CEILING))
        if f.max_amount is not None:
            preds.append(F.col("amount") <= money_bound(f.max_amount, ROUND_FLOOR))
        if f.merchant_regex:
            preds.append(merchant_regex(f.merchant_regex))
    return preds


def apply_filters(df: DataFrame, f: Filters | None, with_merchant_amount: bool = True) -> DataFrame:
    if f is None:
        return df
    preds = predicates(f, with_merchant_amount)
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def id_filter(df: DataFrame, ids, col: str, blank_label: str = "uncategorized") -> DataFrame:
    """Keep a row when slug(col) or the raw label is in ``ids``.

    ``ids`` is an argument list of the caller and becomes one hashed set, whatever its length.
    """
    values = [str(x).strip() for x in (ids or []) if str(x).strip()]
    if not values:
        return df
    label = category_or_uncategorized(col, blank_too=True) if col == "category" \
        else F.coalesce(F.col(col), F.lit(""))
    return df.filter(slug(label).isin(values) | label.isin(values))


def text_search(query: str) -> Column:
    """P10: substring of ``lower(merchant + ' ' + description + ' ' + category + ' ' + provider)``."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in
                                     ("merchant", "description", "category", "provider")]))
    return hay.contains(query.strip().lower())


def category_or_uncategorized(col: str = "category", blank_too: bool = False) -> Column:
    """NULL -> 'uncategorized' (and blank too, in the compact-row form)."""
    c = F.col(col)
    if blank_too:
        c = F.when(c == "", F.lit(None)).otherwise(c)
    return F.coalesce(c, F.lit("uncategorized"))
