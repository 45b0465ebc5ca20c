"""Multi-section plans over one ledger: C12 insight context, C13 query bundle, A21 dashboard.

The reference re-runs a capped query per section; here every section is a lazy DataFrame over
one ledger. With ``persist=True`` the ledger is cached once for all sections and the cached frame
is returned under ``"_ledger"``, so the caller can ``unpersist()`` it when done. ``tall`` stacks sections into one
``(section, rank, label, value)`` frame (each section is already a small top-k).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.dates import comparison_range
from ledgerspark.operators import compare, patterns, summaries
from ledgerspark.operators.paging import query_transactions
from ledgerspark.schema import Filters

# fixed values: default section limits
INSIGHT_LIMITS = {"topCategories": 8, "topMerchants": 8, "drivers": 8, "anomalies": 5, "recurring": 8}
INSIGHT_SECTIONS = ("totals", "top_categories", "top_merchants", "drivers", "anomalies", "recurring")
# the bundle size cap
MAX_BUNDLE = 5


def insight_context(ledger: DataFrame, start, end, comparison: str | None = "previous_period",
                    include=None, limits: dict | None = None, persist: bool = False) -> dict[str, DataFrame]:
    wanted = set(include or INSIGHT_SECTIONS)
    lim = {**INSIGHT_LIMITS, **(limits or {})}
    out: dict[str, DataFrame] = {}
    if persist:
        ledger = out["_ledger"] = ledger.persist(StorageLevel.MEMORY_AND_DISK)
    if "totals" in wanted:
        out["totals"] = summaries.spend_summary(ledger, "month", start, end, limit=12)
    if "top_categories" in wanted:
        out["top_categories"] = summaries.spend_summary(ledger, "category", start, end, limit=lim["topCategories"])
    if "top_merchants" in wanted:
        out["top_merchants"] = summaries.spend_summary(ledger, "merchant", start, end, limit=lim["topMerchants"])
    comp = comparison_range(start, end, comparison) if comparison else None
    if comp and "drivers" in wanted:
        out["drivers"] = compare.top_drivers(ledger, (start, end), comp, "category", lim["drivers"])
    if "anomalies" in wanted:
        out["anomalies"] = patterns.anomalies_transactions(ledger, start, end, "medium", lim["anomalies"])
    if "recurring" in wanted:
        out["recurring"] = patterns.recurring(ledger, start, end, 3, False, 50).limit(lim["recurring"])
    return out


def tall(sections: dict[str, DataFrame]) -> DataFrame:
    """Stack sections as ``(section, rank, label, value)``; ``value`` is the section's headline
    integer (cents)."""
    spec = {
        "totals": ("label", "total_cents", [F.desc("total_cents"), F.asc("key")]),
        "top_categories": ("label", "total_cents", [F.desc("total_cents"), F.asc("key")]),
        "top_merchants": ("label", "total_cents", [F.desc("total_cents"), F.asc("key")]),
        "drivers": ("label", "delta_cents", [F.desc(F.abs(F.col("delta_cents"))), F.asc("key")]),
        "anomalies": ("label", "delta_cents", [F.desc("delta_cents"), F.asc("id")]),
        "recurring": ("merchant", "avg_amount_cents",
                      [F.desc("confidence"), F.desc("avg_amount_cents"), F.asc("merchant")]),
    }
    out = None
    for name, df in sections.items():
        if name.startswith("_"):
            continue
        label, value, order = spec[name]
        # each section is a small top-k, so a window without partitioning is one tiny task
        part = df.select(F.lit(name).alias("section"),
                         F.row_number().over(Window.orderBy(*order)).alias("rank"),
                         F.col(label).cast("string").alias("label"), F.col(value).cast("bigint").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _anomalies(ledger: DataFrame, start=None, end=None, dimension: str = "transaction", **how) -> DataFrame:
    """Spikes among charges (C5), or among the groups of a dimension."""
    if dimension == "transaction":
        return patterns.anomalies_transactions(ledger, start, end, **how)
    return patterns.anomalies_groups(ledger, start, end, dimension, **how)


def query_bundle(ledger: DataFrame, requests: list[dict], persist: bool = False) -> dict[str, DataFrame]:
    """Up to five named compact summaries from an allow-list, over one persisted ledger."""
    from ledgerspark.operators.search import search_dimensions

    if len(requests) > MAX_BUNDLE:
        raise ValueError(f"at most {MAX_BUNDLE} queries per bundle")
    out: dict[str, DataFrame] = {}
    if persist:
        ledger = out["_ledger"] = ledger.persist(StorageLevel.MEMORY_AND_DISK)
    tools = {
        "spend_summary": lambda a: summaries.spend_summary(ledger, **a),
        "category_summary": lambda a: summaries.category_summary(ledger, **a),
        "merchant_summary": lambda a: summaries.merchant_summary(ledger, **a),
        "compare_periods": lambda a: compare.compare_periods(ledger, **a),
        "top_drivers": lambda a: compare.top_drivers(ledger, **a),
        "recurring_transactions": lambda a: patterns.recurring(ledger, **a),
        "recurring": lambda a: patterns.recurring(ledger, **a),
        "anomalies": lambda a: _anomalies(ledger, **a),
        "search_dimensions": lambda a: search_dimensions(ledger, **a),
    }
    for i, req in enumerate(requests):
        tool = req.get("tool")
        if tool not in tools:
            raise ValueError(f"tool not allowed in bundle: {tool}")
        out[req.get("name") or f"{tool}_{i}"] = tools[tool](dict(req.get("args") or {}))
    return out


def dashboard(ledger: DataFrame, filters: Filters, page: int = 1, page_size: int = 200,
              sort_by: str = "date", sort_dir: str = "desc", persist: bool = False) -> dict[str, DataFrame]:
    """Overview, categories, periods, merchants (top 15), all-time categories (house rule
    only) and one page of rows, all over one persisted ledger."""
    out: dict[str, DataFrame] = {}
    if persist:
        ledger = out["_ledger"] = ledger.persist(StorageLevel.MEMORY_AND_DISK)
    return out | {
        "overview": summaries.overview(ledger, filters),
        "categories": summaries.summarize_by_category(ledger, filters),
        "periods": summaries.summarize_by_period(ledger, "month", filters),
        "merchants": summaries.summarize_by_merchant(ledger, filters, limit=15),
        "all_time_categories": summaries.summarize_by_category(
            ledger, Filters(exclude_category=filters.exclude_category)),
        "transactions": query_transactions(ledger, filters, sort_by, sort_dir, limit=page_size,
                                           offset=(max(1, page) - 1) * page_size),
    }
