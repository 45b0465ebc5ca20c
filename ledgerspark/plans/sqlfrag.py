"""DuckDB SQL fragments mirroring the Column functions (for oracle text only)."""


def slug_sql(x: str, empty: str = "uncategorized") -> str:
    s = (f"regexp_replace(regexp_replace(lower(COALESCE({x}, '')), '[^a-z0-9]+', '_', 'g'), "
         f"'^_+|_+$', '', 'g')")
    return f"(CASE WHEN {s} = '' THEN '{empty}' ELSE {s} END)"


def compact_cte(where: str = "TRUE", src: str = "ledger", name: str = "rows") -> str:
    return f"""{name} AS (
  SELECT date, description, merchant, amount, provider,
         COALESCE(NULLIF(category, ''), 'uncategorized') AS category,
         CAST(amount * 100 AS BIGINT) AS amount_cents, COALESCE(provider, '') AS account
  FROM {src} WHERE {where})"""


def key_label(group_by: str) -> tuple[str, str]:
    if group_by == "month":
        return "strftime(date, '%Y-%m')", "strftime(date, '%Y-%m')"
    if group_by == "week":
        return "strftime(date, '%G-W%V')", "strftime(date, '%G-W%V')"
    if group_by == "account":
        lab = "COALESCE(NULLIF(account, ''), 'unknown')"
        return slug_sql(lab), lab
    if group_by == "merchant":
        lab = "COALESCE(NULLIF(merchant, ''), 'unknown')"
        return slug_sql(lab), lab
    return slug_sql("category"), "category"


def first_label(label: str = "label") -> str:
    """Label of the earliest row (ties by label), like ``min_by(label, struct(date, label))``."""
    return f"substr(min(CAST(date AS VARCHAR) || '|' || {label}), 12)"


def share_sql(total: str, grand: str) -> str:
    return f"CASE WHEN {grand} <> 0 THEN round(CAST({total} AS DOUBLE) * 100.0 / CAST({grand} AS DOUBLE), 1) ELSE 0.0 END"
