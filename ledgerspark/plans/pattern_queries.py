"""Registered pattern queries (step 4: W1, C3-C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import patterns as X
from ledgerspark.plans.registry import register
from ledgerspark.plans.sqlfrag import compact_cte, slug_sql
from ledgerspark.plans.sqlviews import LEDGER_LINES, LEDGER_ORDERS, with_
from ledgerspark.schema import Filters
from ledgerspark.sources.tables import ledger_lines, ledger_orders

PY_FLOAT_SQL = "regexp_replace(CAST(amount AS VARCHAR), '(\\.\\d)0$', '\\1')"
TX_ID_SQL = ("substr(" + slug_sql(
    "CAST(date AS VARCHAR) || '|' || merchant || '|' || " + PY_FLOAT_SQL + " || '|' || description") + ", 1, 64)")


@register("charge_gaps", with_(LEDGER_ORDERS) + """
SELECT merchant, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, description,
       date_diff('day', lag(date) OVER (PARTITION BY merchant ORDER BY date, amount, description), date) AS gap_days
FROM ledger""")
def charge_gaps(spark, sf):
    return (X.charge_gaps(ledger_orders(spark, sf))
            .select("merchant", F.date_format("date", "yyyy-MM-dd").alias("date"),
                    F.col("amount").cast("double").alias("amount"), "description", "gap_days"))


def _recurring_sql(view: str, start: str, end: str, min_n: int, include_inactive: bool, limit: int) -> str:
    inactive = "" if include_inactive else \
        f"AND NOT (date_diff('day', last, DATE '{end}') > greatest(avg_gap * 2, 45))"
    return with_(view, compact_cte(f"date >= DATE '{start}' AND date <= DATE '{end}'")) + f""",
lastrow AS (SELECT merchant, amount_cents AS last_amount_cents, category FROM rows
            QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY date DESC, amount_cents DESC,
                                       description DESC, category DESC) = 1),
g AS (SELECT merchant, COUNT(*) AS n, MIN(date) AS first, MAX(date) AS last, SUM(amount_cents) AS s
      FROM rows GROUP BY 1 HAVING COUNT(*) >= {min_n}),
g2 AS (SELECT *, CAST(CASE WHEN n > 1 THEN date_diff('day', first, last) // (n - 1) ELSE 0 END AS INTEGER) AS avg_gap FROM g)
SELECT g2.merchant,
       CASE WHEN avg_gap BETWEEN 25 AND 35 THEN 'monthly' WHEN avg_gap BETWEEN 5 AND 9 THEN 'weekly' ELSE 'irregular' END AS cadence,
       s // n AS avg_amount_cents, last_amount_cents, CAST(last AS VARCHAR) AS last_date,
       round(least(0.95, n / {float(max(min_n, 1))} * 0.3), 2) AS confidence, category
FROM g2 JOIN lastrow ON g2.merchant = lastrow.merchant
WHERE TRUE {inactive}
ORDER BY confidence DESC, avg_amount_cents DESC, merchant LIMIT {limit}"""


@register("recurring", _recurring_sql(LEDGER_ORDERS, "1995-01-01", "1999-12-31", 3, False, 50))
def recurring(spark, sf):
    return X.recurring(ledger_orders(spark, sf), "1995-01-01", "1999-12-31", 3, False, 50)


@register("recurring_brands", _recurring_sql(LEDGER_LINES, "1997-01-01", "1997-12-31", 3, True, 50))
def recurring_brands(spark, sf):
    return X.recurring(ledger_lines(spark, sf), "1997-01-01", "1997-12-31", 3, True, 50)


@register("recurring_months", with_(LEDGER_ORDERS) + """
SELECT merchant, COUNT(*) AS transactions,
       array_to_string(list_sort(list_distinct(list(strftime(date, '%Y-%m')))), ',') AS months,
       round(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 4) AS average, CAST(SUM(amount) AS DOUBLE) AS total,
       CAST(MAX(date) AS VARCHAR) AS latest_date
FROM (SELECT COALESCE(NULLIF(merchant, ''), 'unknown') AS merchant, date, amount FROM ledger WHERE provider = 'f')
GROUP BY 1 HAVING COUNT(DISTINCT strftime(date, '%Y-%m')) >= 2 AND COUNT(*) >= 2
ORDER BY COUNT(DISTINCT strftime(date, '%Y-%m')) DESC, total DESC, merchant LIMIT 20""")
def recurring_months(spark, sf):
    out = X.recurring_months(ledger_orders(spark, sf), Filters(provider="f"), limit=20)
    return out.select("merchant", "transactions", F.array_join("months", ",").alias("months"),
                      F.round("average", 4).alias("average"), "total", "latest_date")


def _anomalies_tx_sql(view: str, start: str, end: str, factor: float, limit: int) -> str:
    return with_(view, compact_cte(f"date >= DATE '{start}' AND date <= DATE '{end}'")) + f""",
rows2 AS (SELECT *, {TX_ID_SQL} AS id FROM rows),
st AS (SELECT merchant, COUNT(*) AS n, SUM(amount_cents) AS s, stddev_pop(CAST(amount_cents AS DOUBLE)) AS sd
       FROM rows2 GROUP BY 1 HAVING COUNT(*) >= 2)
SELECT id, rows2.merchant AS label, s // n AS expected_cents, amount_cents AS actual_cents,
       amount_cents - s // n AS delta_cents, 0.7 AS confidence, 'transaction_spike' AS explanation_code
FROM rows2 JOIN st ON rows2.merchant = st.merchant
WHERE amount_cents > s // n + CAST(trunc(greatest(sd * {factor}, 2500.0)) AS BIGINT)
ORDER BY delta_cents DESC, id LIMIT {limit}"""


@register("anomalies_tx", _anomalies_tx_sql(LEDGER_LINES, "1997-01-01", "1997-12-31", 1.5, 10))
def anomalies_tx(spark, sf):
    return X.anomalies_transactions(ledger_lines(spark, sf), "1997-01-01", "1997-12-31", "medium", 10)


@register("anomalies_group", with_(LEDGER_ORDERS, compact_cte("date >= DATE '1997-01-01' AND date <= DATE '1997-12-31'")) + f""",
g AS (SELECT {slug_sql("COALESCE(NULLIF(merchant, ''), 'unknown')")} AS key,
             substr(min(CAST(date AS VARCHAR) || '|' || COALESCE(NULLIF(merchant, ''), 'unknown')), 12) AS label,
             SUM(amount_cents) AS total_cents FROM rows GROUP BY 1),
s AS (SELECT SUM(total_cents) // greatest(COUNT(*), 1) AS e,
             CASE WHEN COUNT(*) > 1 THEN stddev_pop(CAST(total_cents AS DOUBLE)) ELSE 0.0 END AS sd FROM g)
SELECT label, e AS expected_cents, total_cents AS actual_cents, total_cents - e AS delta_cents,
       0.65 AS confidence, 'merchant_spike' AS explanation_code
FROM g, s WHERE CAST(total_cents AS DOUBLE) > CAST(e AS DOUBLE) + greatest(sd * 2.0, 2500.0)
ORDER BY delta_cents DESC, label LIMIT 10""")
def anomalies_group(spark, sf):
    return X.anomalies_groups(ledger_orders(spark, sf), "1997-01-01", "1997-12-31", "merchant", "low", 10)


@register("unusual_spend", with_(LEDGER_LINES) + """,
f AS (SELECT *, COALESCE(NULLIF(merchant, ''), 'unknown') AS mk FROM ledger
      WHERE date >= DATE '1998-01-01' AND date <= DATE '1998-12-31'),
st AS (SELECT mk, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean,
              stddev_pop(CAST(amount AS DOUBLE)) AS sd FROM f GROUP BY 1 HAVING COUNT(*) >= 2)
SELECT CAST(date AS VARCHAR) AS date, description, merchant, CAST(amount AS DOUBLE) AS amount, category, provider,
       round(mean, 4) AS merchant_average, round(CAST(amount AS DOUBLE) - mean, 4) AS difference
FROM f JOIN st ON f.mk = st.mk
WHERE CAST(amount AS DOUBLE) > mean + greatest(sd * 1.5, mean * 0.5, 25.0)
ORDER BY CAST(amount AS DOUBLE) - mean DESC, date, merchant, description LIMIT 20""")
def unusual_spend(spark, sf):
    out = X.unusual_spend(ledger_lines(spark, sf), Filters(start="1998-01-01", end="1998-12-31"), limit=20)
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                      F.col("amount").cast("double").alias("amount"), "category", "provider",
                      F.round("merchant_average", 4).alias("merchant_average"),
                      F.round("difference", 4).alias("difference"))


_CI = ("premium", "1996-01-01", "1998-12-31")
_CI_WHERE = f"category = '{_CI[0]}' AND date >= DATE '{_CI[1]}' AND date <= DATE '{_CI[2]}'"


@register("category_insight_merchants", with_(LEDGER_ORDERS) + f""",
f AS (SELECT * FROM ledger WHERE category = 'machinery' AND date >= DATE '{_CI[1]}' AND date <= DATE '{_CI[2]}'),
t AS (SELECT COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS t FROM f)
SELECT merchant, total, transactions, round(CASE WHEN (SELECT t FROM t) <> 0 THEN total / (SELECT t FROM t) ELSE 0.0 END, 6) AS spend_share
FROM (SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions FROM f GROUP BY 1
      ORDER BY total DESC, merchant LIMIT 5)""")
def category_insight_merchants(spark, sf):
    out = X.insight_merchants(ledger_orders(spark, sf), "machinery", _CI[1], _CI[2], 5)
    return out.select("merchant", "total", "transactions", F.round("spend_share", 6).alias("spend_share"))


@register("category_insight_months", with_(LEDGER_LINES) + f"""
SELECT strftime(date, '%Y-%m') AS period, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger WHERE {_CI_WHERE} GROUP BY 1 ORDER BY period DESC LIMIT 12""")
def category_insight_months(spark, sf):
    return X.insight_months(ledger_lines(spark, sf), *_CI, max_periods=12)


@register("category_insight_top", with_(LEDGER_LINES) + f"""
SELECT CAST(date AS VARCHAR) AS date, merchant, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE {_CI_WHERE}
ORDER BY amount DESC, date, merchant, description LIMIT 5""")
def category_insight_top(spark, sf):
    return X.insight_top_transactions(ledger_lines(spark, sf), *_CI, top=5)


@register("category_insight_findings", with_(LEDGER_LINES) + f""",
f AS (SELECT * FROM ledger WHERE {_CI_WHERE}),
tot AS (SELECT COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS t, COUNT(*) AS c FROM f),
m AS (SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS n FROM f GROUP BY 1
      ORDER BY total DESC, merchant LIMIT 5),
mp AS (SELECT *, row_number() OVER (ORDER BY total DESC, merchant) AS pos FROM m),
mo AS (SELECT strftime(date, '%Y-%m') AS period, CAST(SUM(amount) AS DOUBLE) AS total FROM f GROUP BY 1
       ORDER BY period DESC LIMIT 12),
conc AS (SELECT 1 AS rank, 'merchant_concentration' AS type, merchant, CAST(NULL AS VARCHAR) AS period,
                round(total / (SELECT t FROM tot), 4) AS value
         FROM mp WHERE pos = 1 AND (SELECT t FROM tot) > 0 AND total / (SELECT t FROM tot) >= 0.3),
freq AS (SELECT 2 AS rank, 'high_frequency_merchant' AS type, merchant, CAST(NULL AS VARCHAR) AS period,
                CAST(n AS DOUBLE) AS value
         FROM (SELECT * FROM mp ORDER BY n DESC, pos LIMIT 1)
         WHERE (SELECT t FROM tot) > 0 AND n >= 3 AND n >= greatest(1, floor((SELECT c FROM tot) * 0.4))),
spike AS (SELECT 3 AS rank, 'recent_spike' AS type, CAST(NULL AS VARCHAR) AS merchant, period, total AS value
          FROM (SELECT * FROM mo ORDER BY period DESC LIMIT 1)
          WHERE (SELECT COUNT(*) FROM mo) > 1 AND (SELECT t FROM tot) > 0
            AND total > (SELECT t FROM tot) / (SELECT COUNT(*) FROM mo) * 1.2)
SELECT * FROM (SELECT * FROM conc UNION ALL SELECT * FROM freq UNION ALL SELECT * FROM spike) ORDER BY rank LIMIT 3""")
def category_insight_findings(spark, sf):
    return X.insight_findings(ledger_lines(spark, sf), *_CI)
