"""Registered compact-summary and comparison queries (step 3: A7-A11, A20, J1-J2, C1-C2, C9-C10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.dates import comparison_range
from ledgerspark.operators import compare as C
from ledgerspark.operators import summaries as A
from ledgerspark.plans.registry import register
from ledgerspark.plans.sqlfrag import compact_cte, first_label, key_label, share_sql, slug_sql
from ledgerspark.plans.sqlviews import LEDGER_LINES, LEDGER_ORDERS, with_
from ledgerspark.schema import Filters
from ledgerspark.sources.tables import ledger_lines, ledger_orders

R_START, R_END = "1996-01-01", "1998-12-31"


def _summary_sql(view: str, group_by: str, where: str, limit: int | None = None) -> str:
    key, lab = key_label(group_by)
    lim = f"ORDER BY total_cents DESC, key LIMIT {limit}" if limit else ""
    return with_(view, compact_cte(where)) + f""",
grand AS (SELECT COALESCE(SUM(amount_cents), 0) AS g FROM rows)
SELECT key, label, total_cents, count, {share_sql('total_cents', '(SELECT g FROM grand)')} AS share_pct FROM (
  SELECT {key} AS key, {first_label(lab)} AS label, SUM(amount_cents) AS total_cents, COUNT(*) AS count
  FROM rows GROUP BY 1) {lim}"""


_RANGE = f"date >= DATE '{R_START}' AND date <= DATE '{R_END}'"


@register("spend_summary_share", _summary_sql(LEDGER_ORDERS, "merchant", _RANGE, 20))
def spend_summary_share(spark, sf):
    return A.spend_summary(ledger_orders(spark, sf), "merchant", R_START, R_END, limit=20)


@register("spend_summary_week", _summary_sql(LEDGER_LINES, "week", "date >= DATE '1998-01-01' AND date <= DATE '1999-12-31'"))
def spend_summary_week(spark, sf):
    return A.spend_summary(ledger_lines(spark, sf), "week", "1998-01-01", "1999-12-31")


@register("spend_summary_account", _summary_sql(LEDGER_ORDERS, "account", "contains(lower(merchant || ' ' || description || ' ' || COALESCE(category, '') || ' ' || COALESCE(provider, '')), 'urgent')"))
def spend_summary_account(spark, sf):
    return A.spend_summary(ledger_orders(spark, sf), "account", search=" URGENT ")


_D_START, _D_END = "1998-01-01", "1998-03-31"
_D_BASE = comparison_range(_D_START, _D_END, "previous_period")


def _delta_sql() -> str:
    key, lab = key_label("category")
    cur = f"date >= DATE '{_D_START}' AND date <= DATE '{_D_END}'"
    base = f"date >= DATE '{_D_BASE[0]}' AND date <= DATE '{_D_BASE[1]}'"
    return with_(LEDGER_ORDERS, compact_cte(cur, name="cur_rows"), compact_cte(base, name="base_rows")) + f""",
grand AS (SELECT COALESCE(SUM(amount_cents), 0) AS g FROM cur_rows),
cur AS (SELECT {key} AS key, {first_label(lab)} AS label, SUM(amount_cents) AS total_cents, COUNT(*) AS count
        FROM cur_rows GROUP BY 1),
base AS (SELECT {key} AS key, SUM(amount_cents) AS base_cents FROM base_rows GROUP BY 1)
SELECT cur.key, label, total_cents, count, {share_sql('total_cents', '(SELECT g FROM grand)')} AS share_pct,
       total_cents - COALESCE(base_cents, 0) AS delta_cents
FROM cur LEFT JOIN base ON cur.key = base.key"""


@register("spend_summary_delta", _delta_sql())
def spend_summary_delta(spark, sf):
    return A.spend_summary(ledger_orders(spark, sf), "category", _D_START, _D_END, comparison="previous_period")


@register("merchant_summary", with_(LEDGER_ORDERS, compact_cte(
    "contains(lower(merchant || ' ' || description || ' ' || COALESCE(category, '') || ' ' || COALESCE(provider, '')), 'customer#00000012') "
    "AND contains(lower(merchant), 'customer#00000012')")) + f"""
SELECT {slug_sql('merchant')} AS id, merchant AS label, SUM(amount_cents) AS total_cents, COUNT(*) AS count,
       SUM(amount_cents) // COUNT(*) AS avg_cents, CAST(MIN(date) AS VARCHAR) AS first_date,
       CAST(MAX(date) AS VARCHAR) AS last_date
FROM rows GROUP BY merchant ORDER BY total_cents DESC, label LIMIT 10""")
def merchant_summary(spark, sf):
    return A.merchant_summary(ledger_orders(spark, sf), "Customer#00000012")


_CAT_IDS = ["machinery", "AUTOMOBILE", "uncategorized", "  "]
_CAT_LABEL = "COALESCE(NULLIF(category, ''), 'uncategorized')"


@register("category_summary", _summary_sql(
    LEDGER_ORDERS, "category",
    f"date >= DATE '1997-01-01' AND date <= DATE '1997-12-31' AND ("
    f"{slug_sql(_CAT_LABEL)} IN ('machinery', 'AUTOMOBILE', 'uncategorized') "
    f"OR {_CAT_LABEL} IN ('machinery', 'AUTOMOBILE', 'uncategorized'))"))
def category_summary(spark, sf):
    return A.category_summary(ledger_orders(spark, sf), "1997-01-01", "1997-12-31", category_ids=_CAT_IDS)


@register("merchant_filtered_groups", with_(LEDGER_ORDERS) + """
SELECT COALESCE(NULLIF(category, ''), 'uncategorized') AS category, CAST(SUM(amount) AS DOUBLE) AS total,
       COUNT(*) AS transactions
FROM ledger WHERE lower(merchant) LIKE '%#0000002%' AND provider = 'f' GROUP BY 1""")
def merchant_filtered_groups(spark, sf):
    return A.group_transactions(ledger_orders(spark, sf), "category", Filters(merchant="#0000002", provider="f"))


@register("profile", with_(LEDGER_LINES) + """
SELECT CAST(MIN(date) AS VARCHAR) AS start_date, CAST(MAX(date) AS VARCHAR) AS end_date,
       COUNT(*) AS transaction_count,
       COUNT(DISTINCT COALESCE(category, 'uncategorized')) FILTER (WHERE COALESCE(category, 'uncategorized') <> '') AS category_count,
       COUNT(DISTINCT merchant) FILTER (WHERE COALESCE(category, 'uncategorized') <> '') AS merchant_count,
       COUNT(DISTINCT provider) FILTER (WHERE trim(provider) <> '') AS account_count
FROM ledger""")
def profile(spark, sf):
    return A.profile(ledger_lines(spark, sf))


@register("top_category_share", with_(LEDGER_ORDERS) + """,
f AS (SELECT * FROM ledger WHERE lower(trim(COALESCE(category, ''))) <> 'house' AND date >= DATE '1997-01-01'),
g AS (SELECT CAST(SUM(amount) AS DOUBLE) AS grand FROM f),
c AS (SELECT COALESCE(category, 'uncategorized') AS category, CAST(SUM(amount) AS DOUBLE) AS total FROM f
      GROUP BY 1 ORDER BY total DESC, category LIMIT 5)
SELECT category, total, round(CASE WHEN (SELECT grand FROM g) > 0 THEN total * 100.0 / (SELECT grand FROM g) ELSE 0.0 END, 4) AS share_pct,
       round(greatest(total * 100.0 / greatest((SELECT max(total) FROM c), 1.0), 2.0), 4) AS width_pct
FROM c""")
def top_category_share(spark, sf):
    out = A.top_category_share(ledger_orders(spark, sf), Filters.dashboard(start="1997-01-01"))
    return out.select("category", "total", F.round("share_pct", 4).alias("share_pct"), F.round("width_pct", 4).alias("width_pct"))


_A = ("1998-01-01", "1998-06-30")
_B = ("1997-01-01", "1997-06-30")


def _drivers_sql(group_by: str, limit: int, reason: bool = False, a=_A, b=_B, view: str = LEDGER_ORDERS) -> str:
    _A, _B = a, b  # noqa: N806
    key, lab = key_label(group_by)
    extra = (""", CASE WHEN delta_cents < 0 THEN 'decrease' WHEN baseline_cents = 0 AND current_cents > 0 THEN 'new'
       ELSE 'increase' END AS reason_code""" if reason else "")
    return with_(view, compact_cte(f"date >= DATE '{_A[0]}' AND date <= DATE '{_A[1]}'", name="a_rows"),
                 compact_cte(f"date >= DATE '{_B[0]}' AND date <= DATE '{_B[1]}'", name="b_rows")) + f""",
a AS (SELECT {key} AS key, {first_label(lab)} AS label, SUM(amount_cents) AS t FROM a_rows GROUP BY 1),
b AS (SELECT {key} AS key, {first_label(lab)} AS label, SUM(amount_cents) AS t FROM b_rows GROUP BY 1),
j AS (SELECT COALESCE(a.key, b.key) AS key, COALESCE(a.label, b.label) AS label,
             COALESCE(a.t, 0) AS current_cents, COALESCE(b.t, 0) AS baseline_cents
      FROM a FULL OUTER JOIN b ON a.key = b.key)
SELECT key, label, current_cents, baseline_cents, current_cents - baseline_cents AS delta_cents{extra}
FROM j ORDER BY abs(current_cents - baseline_cents) DESC, key LIMIT {limit}"""


@register("compare_periods", _drivers_sql("merchant", 50))
def compare_periods(spark, sf):
    return C.compare_periods(ledger_orders(spark, sf), _A, _B, "merchant", limit=50)


@register("compare_totals", with_(LEDGER_ORDERS) + f"""
SELECT COALESCE(SUM(CASE WHEN date BETWEEN DATE '{_A[0]}' AND DATE '{_A[1]}' THEN CAST(amount * 100 AS BIGINT) END), 0) AS a_total_cents,
       COUNT(CASE WHEN date BETWEEN DATE '{_A[0]}' AND DATE '{_A[1]}' THEN 1 END) AS a_count,
       COALESCE(SUM(CASE WHEN date BETWEEN DATE '{_B[0]}' AND DATE '{_B[1]}' THEN CAST(amount * 100 AS BIGINT) END), 0) AS b_total_cents,
       COUNT(CASE WHEN date BETWEEN DATE '{_B[0]}' AND DATE '{_B[1]}' THEN 1 END) AS b_count,
       COALESCE(SUM(CASE WHEN date BETWEEN DATE '{_A[0]}' AND DATE '{_A[1]}' THEN CAST(amount * 100 AS BIGINT) END), 0)
       - COALESCE(SUM(CASE WHEN date BETWEEN DATE '{_B[0]}' AND DATE '{_B[1]}' THEN CAST(amount * 100 AS BIGINT) END), 0) AS delta_cents
FROM ledger""")
def compare_totals(spark, sf):
    return C.compare_periods(ledger_orders(spark, sf), _A, _B, "none")


@register("top_drivers", _drivers_sql("category", 10, reason=True))
def top_drivers(spark, sf):
    return C.top_drivers(ledger_orders(spark, sf), _A, _B, "category", limit=10)


_PERIODS = {"a": ("1997-01-01", "1997-06-30"), "b": ("1997-04-01", "1997-12-31")}
_SHARED = Filters(provider="f", merchant="customer#0000001")


@register("period_breakdown", with_(LEDGER_ORDERS) + """,
f AS (SELECT * FROM ledger WHERE provider = 'f'),
t AS (SELECT 'a' AS period, * FROM f WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'
      UNION ALL SELECT 'b' AS period, * FROM f WHERE date BETWEEN DATE '1997-04-01' AND DATE '1997-12-31'),
g AS (SELECT period, merchant, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions FROM t GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY total DESC, merchant) AS rank FROM g)
WHERE rank <= 20""")
def period_breakdown(spark, sf):
    return C.period_breakdown(ledger_orders(spark, sf), _PERIODS, _SHARED, "merchant", top=20)


@register("period_totals", with_(LEDGER_ORDERS) + """,
f AS (SELECT * FROM ledger WHERE provider = 'f' AND lower(merchant) LIKE '%customer#0000001%'),
t AS (SELECT 'a' AS period, * FROM f WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'
      UNION ALL SELECT 'b' AS period, * FROM f WHERE date BETWEEN DATE '1997-04-01' AND DATE '1997-12-31')
SELECT period, COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS total, COUNT(*) AS transactions FROM t GROUP BY 1""")
def period_totals(spark, sf):
    return C.period_totals_filtered(ledger_orders(spark, sf), _PERIODS, _SHARED)


@register("comparison_card", with_(LEDGER_ORDERS) + """,
f AS (SELECT * FROM ledger WHERE provider = 'f' AND lower(merchant) LIKE '%customer#0000001%'),
x AS (SELECT COALESCE(CAST(SUM(amount) FILTER (WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AS DOUBLE), 0.0) AS a_total,
             COALESCE(CAST(SUM(amount) FILTER (WHERE date BETWEEN DATE '1997-04-01' AND DATE '1997-12-31') AS DOUBLE), 0.0) AS b_total
      FROM f)
SELECT a_total, b_total, b_total - a_total AS delta,
       round(CASE WHEN a_total <> 0 THEN abs(b_total - a_total) / a_total * 100 ELSE 0.0 END, 4) AS pct,
       CASE WHEN b_total > a_total THEN 'up' WHEN b_total < a_total THEN 'down' ELSE 'flat' END AS trend
FROM x""")
def comparison_card(spark, sf):
    totals = C.period_totals_filtered(ledger_orders(spark, sf), _PERIODS, _SHARED)
    card = C.comparison_card(totals, "a", "b")
    return card.select("a_total", "b_total", "delta", F.round("pct", 4).alias("pct"), "trend")
