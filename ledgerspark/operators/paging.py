"""Sorted, paged lookups. ``orderBy -> offset -> limit`` plans as one
TakeOrderedAndProject (a per-partition top-(offset+limit) then a merge), never a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.filters import apply_filters, flagged
from ledgerspark.operators.summaries import compact_rows
from ledgerspark.schema import Filters

SORT_COLUMNS = ("date", "amount", "merchant", "category", "description", "provider")
KEYSET = ("date", "id", "amount_cents", "description", "merchant", "provider", "category")
TIE_BREAKERS = ("date", "merchant", "description", "amount", "category", "provider")

# ---- fixed values: per-surface limits ---------------------------------------------------
PAGE_MAX, PAGE_DEFAULT = 1000, 200          # dashboard page
TOOL_ROWS_MAX, TOOL_ROWS_DEFAULT = 100, 25  # compact row tools
ASSIST_RAW, ASSIST_AGG = 50, 20             # assistant tools
FIELD_ALLOWLIST = ("id", "date", "amountCents", "merchant", "category", "account", "description", "notes")
DEFAULT_FIELDS = ("id", "date", "amountCents", "merchant", "category")
# -----------------------------------------------------------------------------------------


def clamp(value, default: int, max_value: int, min_value: int = 1) -> int:
    """Argument clamps."""
    if value is None:
        return default
    return max(min_value, min(int(value), max_value))


def order_columns(sort_by: str = "date", sort_dir: str = "asc", group_by: str | None = None):
    sort_col = sort_by if sort_by in SORT_COLUMNS else "date"
    group_col = group_by if group_by in SORT_COLUMNS else None
    if group_col == sort_col:
        group_col = None
    desc = str(sort_dir).lower() == "desc"
    cols = []
    if group_col:
        cols.append(F.col(group_col).asc_nulls_first())
    cols.append(F.col(sort_col).desc_nulls_last() if desc else F.col(sort_col).asc_nulls_first())
    used = {sort_col, group_col}
    cols += [F.col(c).asc_nulls_first() for c in TIE_BREAKERS if c not in used]
    return cols


def query_transactions(ledger: DataFrame, filters: Filters | None = None, sort_by: str = "date",
                       sort_dir: str = "asc", group_by: str | None = None, limit: int = PAGE_DEFAULT,
                       offset: int = 0) -> DataFrame:
    """O1: filter (regex included, before the slice) -> order -> offset -> limit (1..1000)."""
    lim = clamp(limit, PAGE_DEFAULT, PAGE_MAX)
    off = max(0, int(offset or 0))
    df = apply_filters(ledger, filters, with_merchant_amount=True)
    df = df.select("date", "description", "merchant", "amount", "category", "provider")
    return df.orderBy(*order_columns(sort_by, sort_dir, group_by)).offset(off).limit(lim)


def numbered_page(ledger: DataFrame, filters: Filters | None = None, sort_by: str = "date",
                  sort_dir: str = "asc", group_by: str | None = None, limit: int = PAGE_DEFAULT,
                  offset: int = 0) -> DataFrame:
    """The O1 page with ``row`` = offset + position, numbered after the slice (<= 1000 rows,
    so the unpartitioned window runs over the page only)."""
    from pyspark.sql import Window

    page = query_transactions(ledger, filters, sort_by, sort_dir, group_by, limit, offset)
    w = Window.orderBy(*order_columns(sort_by, sort_dir, group_by))
    return page.withColumn("row", F.row_number().over(w) + F.lit(max(0, int(offset or 0))))


def get_transactions(ledger: DataFrame, filters: Filters | None = None, sort_by: str = "date",
                     sort_dir: str = "asc", limit: int | None = None) -> DataFrame:
    """O3: at most 50 rows plus a ``truncated`` flag (true when 50 rows came back)."""
    lim = clamp(limit, ASSIST_RAW, ASSIST_RAW)
    page = query_transactions(ledger, filters, sort_by, sort_dir, limit=lim)
    n = page.select(F.count(F.lit(1))).scalar()
    return page.withColumn("truncated", n >= ASSIST_RAW)


def find_page(ledger: DataFrame, start, end, limit: int | None = None, cursor: str | None = None,
              fields=None, **row_filters) -> DataFrame:
    """O2: a page of compact rows by date plus ``next_cursor`` and ``total_approx``.

    The cursor is the offset as text (parity with the reference). The page fetches
    ``limit + 1`` rows to learn whether another page exists.
    """
    if not start or not end:
        raise ValueError("startDate/endDate required")
    lim = clamp(limit, TOOL_ROWS_DEFAULT, TOOL_ROWS_MAX)
    off = int(cursor or 0)
    selected = list(fields or DEFAULT_FIELDS)
    bad = [x for x in selected if x not in FIELD_ALLOWLIST]
    if bad:
        raise ValueError(f"unsupported field {bad[0]}")
    rows = compact_rows(ledger, start, end, **row_filters)
    order = [F.col(c).asc_nulls_first() for c in KEYSET]  # ids are cut: rows of one id need an order, too
    fetched = rows.orderBy(*order).offset(off).limit(lim + 1)
    fetched = fetched.withColumn("__n", F.count(F.lit(1)).over(_whole()))
    fetched = fetched.withColumn("__pos", F.row_number().over(_whole().orderBy(*order)))
    page = fetched.filter(F.col("__pos") <= lim)
    has_next = F.col("__n") > lim
    mapping = {"id": F.col("id"), "date": F.date_format("date", "yyyy-MM-dd"), "amountCents": F.col("amount_cents"),
               "merchant": F.col("merchant"), "category": F.col("category"), "account": F.col("account"),
               "description": F.col("description")}
    cols = [mapping[x].alias(x) for x in selected if x != "notes"]
    return page.select(
        *cols,
        F.when(has_next, F.lit(str(off + lim))).alias("next_cursor"),
        (F.lit(off) + F.least(F.col("__n"), F.lit(lim)) + F.when(has_next, 1).otherwise(0)).cast("bigint").alias("total_approx"),
    )


def _whole():
    """A window over an already-limited (<= 101 rows) frame; safe to run in one task."""
    from pyspark.sql import Window

    return Window.partitionBy()


def keyset_page(ledger: DataFrame, after_date=None, after_id: str | None = None, limit: int = TOOL_ROWS_DEFAULT,
                start=None, end=None, last=None, seen: int = 1, **row_filters) -> DataFrame:
    """O2 for deep paging, in the order of all columns (``KEYSET``, date and id first).

    ``last`` is the last row of the page before (a Row or mapping with the KEYSET columns) and
    ``seen`` how many rows equal to it were shown so far (1, unless the ledger holds equal rows). The
    page starts from that row by a predicate and passes over those ``seen``, so every row is shown
    once and page N costs the same as page 1 (a pushed-down date bound plus a top-k), where an
    offset grows with depth. ``after_date`` and ``after_id`` alone start after that date and id.
    """
    from ledgerspark.functions.dates import as_date

    rows = compact_rows(ledger, start, end, **row_filters)
    skip = 0
    if last is not None:
        types = dict(rows.select(*KEYSET).dtypes)
        mark = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in KEYSET])
        rows = rows.filter(F.struct(*KEYSET) >= mark)
        if last["date"] is not None:
            rows = rows.filter(F.col("date") >= F.lit(as_date(last["date"])))
        skip = seen
    elif after_date is not None:
        d = F.lit(as_date(after_date))
        rows = rows.filter((F.col("date") > d) | ((F.col("date") == d) & (F.col("id") > F.lit(after_id or ""))))
    return rows.orderBy(*KEYSET).offset(skip).limit(clamp(limit, TOOL_ROWS_DEFAULT, TOOL_ROWS_MAX))


def top_merchants(ledger: DataFrame, filters: Filters | None = None, limit: int | None = None,
                  flag: bool = False) -> DataFrame:
    """Top merchants (<= 20); n + 1 rows, so the caller learns of more, or with ``flag`` n rows with
    ``truncated``."""
    from ledgerspark.operators.summaries import group_transactions, summarize_by_merchant

    n = clamp(limit, ASSIST_AGG, ASSIST_AGG)
    if filters is not None and filters.merchant:
        out = group_transactions(ledger, "merchant", filters)
    else:
        out = summarize_by_merchant(ledger, filters.without_merchant() if filters else None)
    return flagged(out, n) if flag else out.limit(n + 1)
