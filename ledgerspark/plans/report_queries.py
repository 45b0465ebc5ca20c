"""Registered report, search, paging and bundle queries (step 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.dates import comparison_range
from ledgerspark.operators import reports as R
from ledgerspark.operators import summaries as A
from ledgerspark.operators.paging import find_page
from ledgerspark.operators.search import search_dimensions
from ledgerspark.plans import bundles
from ledgerspark.plans.pattern_queries import TX_ID_SQL, _anomalies_tx_sql, _recurring_sql
from ledgerspark.plans.registry import ORACLES, register
from ledgerspark.plans.sqlfrag import compact_cte, slug_sql
from ledgerspark.plans.sqlviews import LEDGER_LINES, LEDGER_ORDERS, with_
from ledgerspark.plans.summary_queries import _drivers_sql, _summary_sql
from ledgerspark.session import staging_path
from ledgerspark.sources.tables import ledger_lines, ledger_orders

ORDER_CATEGORIES = ["automobile", "building", "furniture", "machinery", "uncategorized"]
CHART_CATS = ["hardware", "jewelry", "misc", "toys"]


@register("month_category_rollup", with_(LEDGER_ORDERS) + """,
d AS (SELECT strftime(date, '%Y-%m') AS month, strftime(date, '%B %Y') AS month_label,
             COALESCE(category, '') AS category, amount FROM ledger),
r AS (SELECT month, category, CAST(SUM(amount) AS DOUBLE) AS total, GROUPING(month, category) AS level,
             max(month_label) AS month_label FROM d GROUP BY ROLLUP (month, category))
SELECT COALESCE(month, '~') AS sort_month,
       CASE WHEN level = 0 THEN month_label WHEN level = 1 THEN month_label || ' Total' ELSE 'Grand Total' END AS label,
       CASE WHEN level = 0 THEN category END AS category, total, level
FROM r""")
def month_category_rollup(spark, sf):
    return R.month_category_rollup(ledger_orders(spark, sf))


@register("month_category_pivot", with_(LEDGER_ORDERS) + "SELECT strftime(date, '%Y-%m') AS month, " + ", ".join(
    f"COALESCE(CAST(SUM(amount) FILTER (WHERE COALESCE(category, 'uncategorized') = '{c}') AS DOUBLE), 0.0) AS {c}"
    for c in ORDER_CATEGORIES) + ", CAST(SUM(amount) AS DOUBLE) AS total FROM ledger GROUP BY 1")
def month_category_pivot(spark, sf):
    return R.month_category_pivot(ledger_orders(spark, sf), ORDER_CATEGORIES)


@register("month_category_long", with_(LEDGER_LINES) + """
SELECT strftime(date, '%Y-%m') AS month, COALESCE(category, 'uncategorized') AS category,
       CAST(SUM(amount) AS DOUBLE) AS total FROM ledger GROUP BY 1, 2""")
def month_category_long(spark, sf):
    return R.month_category_long(ledger_lines(spark, sf))


@register("chart_monthly", with_(LEDGER_ORDERS) + """
SELECT strftime(date, '%Y-%m') AS month, max(strftime(date, '%B %Y')) AS label, CAST(SUM(amount) AS DOUBLE) AS total
FROM ledger GROUP BY 1""")
def chart_monthly(spark, sf):
    return R.chart_monthly(ledger_orders(spark, sf))


@register("chart_category_month", with_(LEDGER_LINES) + """,
m AS (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM ledger),
c AS (SELECT unnest(['""" + "', '".join(CHART_CATS) + """']) AS category),
t AS (SELECT strftime(date, '%Y-%m') AS month, lower(trim(COALESCE(category, ''))) AS category,
             CAST(SUM(amount) AS DOUBLE) AS total FROM ledger GROUP BY 1, 2)
SELECT m.month, c.category, COALESCE(t.total, 0.0) AS total
FROM m CROSS JOIN c LEFT JOIN t ON t.month = m.month AND t.category = c.category""")
def chart_category_month(spark, sf):
    return R.chart_category_month(ledger_lines(spark, sf), CHART_CATS)


@register("chart_categories", with_(LEDGER_LINES) + """,
t AS (SELECT trim(COALESCE(category, '')) AS category, CAST(SUM(amount) AS DOUBLE) AS total FROM ledger
      WHERE trim(COALESCE(category, '')) <> '' GROUP BY 1
      UNION ALL SELECT unnest(['car', 'groceries', 'misc']) AS category, 0.0 AS total)
SELECT category, SUM(total) AS total FROM t GROUP BY 1""")
def chart_categories(spark, sf):
    return R.chart_categories(ledger_lines(spark, sf), seed=["car", "groceries", "misc"])


@register("month_extract", with_(LEDGER_ORDERS) + """
SELECT strftime(date, '%Y-%m') AS month_key, strftime(date, '%B %Y') AS month, CAST(date AS VARCHAR) AS date,
       description, merchant, category, CAST(amount AS DOUBLE) AS amount FROM ledger""")
def month_extract(spark, sf):
    return (R.month_extract_rows(ledger_orders(spark, sf))
            .select("month_key", "month", F.date_format("date", "yyyy-MM-dd").alias("date"), "description",
                    "merchant", "category", F.col("amount").cast("double").alias("amount")))


@register("text_lines", with_(LEDGER_LINES) + """
SELECT CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) || ' | ' || description || ' | ' || merchant || ' | '
       || CAST(amount AS VARCHAR) AS line FROM ledger""")
def text_lines(spark, sf):
    return R.text_lines(ledger_lines(spark, sf)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "line")


@register("summary_table", with_(LEDGER_ORDERS) + """
SELECT category, '$' || format('{:,.2f}', total) AS total_text, transactions FROM (
  SELECT COALESCE(category, 'uncategorized') AS category, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
  FROM ledger WHERE provider = 'o' GROUP BY 1 ORDER BY total DESC, category LIMIT 8)""")
def summary_table(spark, sf):
    from ledgerspark.schema import Filters

    return R.summary_table(A.summarize_by_category(ledger_orders(spark, sf), Filters(provider="o")))


@register("search_dimensions", with_(LEDGER_LINES) + f""",
um AS (SELECT merchant, list_sort(list_distinct(list(COALESCE(category, 'uncategorized')))) AS cats FROM ledger
       WHERE COALESCE(category, 'uncategorized') <> '' GROUP BY 1),
u AS (
  SELECT 0 AS type_rank, 'merchant' AS type, {slug_sql('merchant')} AS id, merchant AS label,
         array_to_string(cats[1:3], ',') AS aliases FROM um WHERE contains(lower(merchant), 'brand#1')
  UNION ALL
  SELECT DISTINCT 1, 'category', {slug_sql('category')}, category, NULL FROM
    (SELECT COALESCE(category, 'uncategorized') AS category FROM ledger) WHERE category <> '' AND contains(lower(category), 'brand#1')
  UNION ALL
  SELECT DISTINCT 2, 'account', {slug_sql('provider')}, provider, NULL FROM ledger
    WHERE provider IS NOT NULL AND trim(provider) <> '' AND contains(lower(provider), 'brand#1'))
SELECT type, id, label, aliases FROM u ORDER BY type_rank, label LIMIT 10""")
def search_dimensions_q(spark, sf):
    out = search_dimensions(ledger_lines(spark, sf), "Brand#1", limit=10)
    return out.select("type", "id", "label", F.array_join("aliases", ",").alias("aliases"))


@register("search_index", ORACLES["search_dimensions"])
def search_index(spark, sf):
    """C11 from a stored text index: the search itself reads no ledger row."""
    from ledgerspark.operators.search import search_text_index, write_text_index

    path = staging_path(spark, "text-index")
    write_text_index(path, ledger_lines(spark, sf))
    return search_text_index(spark, path, "Brand#1").select("type", "id", "label", F.array_join("aliases", ",").alias("aliases"))


@register("find_page", with_(LEDGER_ORDERS, compact_cte("date >= DATE '1997-01-01' AND date <= DATE '1997-12-31'")) + f""",
p AS (SELECT {TX_ID_SQL} AS id, CAST(date AS VARCHAR) AS date, amount_cents AS "amountCents", merchant, category,
             date AS d, amount_cents FROM rows
      ORDER BY d, id, amount_cents LIMIT 26 OFFSET 50),
n AS (SELECT COUNT(*) AS n FROM p)
SELECT id, date, "amountCents", merchant, category,
       CASE WHEN (SELECT n FROM n) > 25 THEN '75' END AS next_cursor,
       CAST(50 + least((SELECT n FROM n), 25) + CASE WHEN (SELECT n FROM n) > 25 THEN 1 ELSE 0 END AS BIGINT) AS total_approx
FROM (SELECT *, row_number() OVER (ORDER BY d, id, amount_cents) AS pos FROM p) WHERE pos <= 25""")
def find_page_q(spark, sf):
    return find_page(ledger_orders(spark, sf), "1997-01-01", "1997-12-31", limit=25, cursor="50")


_IC = ("1998-01-01", "1998-06-30")
_IC_BASE = comparison_range(*_IC, "previous_period")
_IC_RANGE = f"date >= DATE '{_IC[0]}' AND date <= DATE '{_IC[1]}'"


def _section(name: str, sql: str, label: str, value: str, order: str) -> str:
    return (f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {order}) AS rank, CAST({label} AS VARCHAR) AS label, "
            f"CAST({value} AS BIGINT) AS value FROM ({sql})")


@register("insight_context", " UNION ALL ".join([
    _section("totals", _summary_sql(LEDGER_ORDERS, "month", _IC_RANGE, 12), "label", "total_cents", "total_cents DESC, key"),
    _section("top_categories", _summary_sql(LEDGER_ORDERS, "category", _IC_RANGE, 8), "label", "total_cents",
             "total_cents DESC, key"),
    _section("top_merchants", _summary_sql(LEDGER_ORDERS, "merchant", _IC_RANGE, 8), "label", "total_cents",
             "total_cents DESC, key"),
    _section("drivers", _drivers_sql("category", 8, True, _IC, _IC_BASE), "label", "delta_cents",
             "abs(delta_cents) DESC, key"),
    _section("anomalies", _anomalies_tx_sql(LEDGER_ORDERS, *_IC, 1.5, 5), "label", "delta_cents", "delta_cents DESC, id"),
    _section("recurring", _recurring_sql(LEDGER_ORDERS, *_IC, 3, False, 8), "merchant", "avg_amount_cents",
             "confidence DESC, avg_amount_cents DESC, merchant"),
]))
def insight_context(spark, sf):
    # one query, one plan: no persist (a persisted view would outlive the call)
    return bundles.tall(bundles.insight_context(ledger_orders(spark, sf), *_IC, "previous_period", persist=False))


_TEXT = "CASE WHEN {0} < 0 THEN '$-' ELSE '$' END || format('{{:,.2f}}', abs({0}))"


@register("assistant_tables", f"""
SELECT 'transactions' AS section, date AS c1, merchant AS c2, category AS c3, {_TEXT.format('amount')} AS c4, description AS c5 FROM (
  """ + with_(LEDGER_ORDERS) + f"""
  SELECT CAST(date AS VARCHAR) AS date, COALESCE(NULLIF(merchant, ''), 'Unknown') AS merchant, COALESCE(category, 'uncategorized') AS category,
         CAST(amount AS DOUBLE) AS amount, description
  FROM ledger WHERE provider = 'o' ORDER BY ledger.date, ledger.merchant, description, ledger.amount, ledger.category NULLS FIRST LIMIT 10)
UNION ALL SELECT 'recurring', merchant, {_TEXT.format('total')}, {_TEXT.format('average')}, CAST(transactions AS VARCHAR), replace(months, ',', ', ')
FROM (SELECT * FROM ({ORACLES['recurring_months']}) ORDER BY length(months) DESC, total DESC, merchant LIMIT 8)
UNION ALL SELECT 'unusual', date, merchant, {_TEXT.format('amount')}, {_TEXT.format('merchant_average')}, {_TEXT.format('difference')}
FROM (SELECT * FROM ({ORACLES['unusual_spend']}) ORDER BY difference DESC, date, merchant, description LIMIT 8)""")
def assistant_tables(spark, sf):
    """The tables of transactions, recurring merchants and unusual charges, as text, stacked."""
    from ledgerspark.operators import paging
    from ledgerspark.operators import patterns as X
    from ledgerspark.schema import Filters

    orders, lines = ledger_orders(spark, sf), ledger_lines(spark, sf)
    tables = {"transactions": R.transactions_table(paging.get_transactions(orders, Filters(provider="o"))),
              "recurring": R.recurring_table(X.recurring_months(orders, Filters(provider="f"))),
              "unusual": R.unusual_table(X.unusual_spend(lines, Filters(start="1998-01-01", end="1998-12-31")))}
    out = None
    for name, t in tables.items():
        part = t.toDF("c1", "c2", "c3", "c4", "c5").select(F.lit(name).alias("section"), "c1", "c2", "c3", "c4", "c5")
        out = part if out is None else out.unionByName(part)
    return out


@register("truncated_flags", with_(LEDGER_ORDERS) + """
SELECT 'merchants' AS tool, 20 AS rows, COUNT(DISTINCT merchant) > 20 AS truncated FROM ledger
UNION ALL SELECT 'merchants, all', COUNT(DISTINCT category), false FROM ledger WHERE category IS NOT NULL
UNION ALL SELECT 'recurring', 3, COUNT(*) > 3 FROM (SELECT merchant FROM ledger GROUP BY 1
  HAVING COUNT(DISTINCT strftime(date, '%Y-%m')) >= 2)""")
def truncated_flags(spark, sf):
    """How many rows come back and whether there are more (as many categories as merchants: none left)."""
    from ledgerspark.operators import paging
    from ledgerspark.operators import patterns as X

    led = ledger_orders(spark, sf)
    few = led.filter("category IS NOT NULL").withColumn("merchant", F.col("category"))
    results = {"merchants": paging.top_merchants(led, flag=True), "merchants, all": paging.top_merchants(few, flag=True),
               "recurring": X.recurring_months(led, limit=3, flag=True)}
    out = None
    for name, t in results.items():
        part = t.agg(F.count(F.lit(1)).alias("rows"), F.max("truncated").alias("truncated")).select(F.lit(name).alias("tool"), "rows", "truncated")
        out = part if out is None else out.unionByName(part)
    return out


@register("query_bundle", with_(LEDGER_ORDERS) + f"""
SELECT name, label, value FROM (
  SELECT 'spikes' AS name, label, delta_cents AS value FROM ({ORACLES['anomalies_group']})
  UNION ALL SELECT 'merchants', label, total_cents FROM ({ORACLES['merchant_summary']}))""")
def query_bundle(spark, sf):
    """Two tools of one bundle, anomalies by a dimension among them."""
    from ledgerspark.plans.bundles import query_bundle as bundle

    sections = bundle(ledger_orders(spark, sf), [
        {"tool": "anomalies", "name": "spikes", "args": {
            "start": "1997-01-01", "end": "1997-12-31", "dimension": "merchant", "sensitivity": "low", "limit": 10}},
        {"tool": "merchant_summary", "name": "merchants", "args": {"search": "Customer#00000012"}}])
    spikes = sections["spikes"].select(F.lit("spikes").alias("name"), "label", F.col("delta_cents").alias("value"))
    return spikes.unionByName(sections["merchants"].select(F.lit("merchants").alias("name"), "label", F.col("total_cents").alias("value")))


@register("merchant_transactions", with_(LEDGER_ORDERS, compact_cte(
    "contains(lower(merchant || ' ' || description || ' ' || COALESCE(category, '') || ' ' || COALESCE(provider, '')), 'customer#00000012') "
    "AND contains(lower(merchant), 'customer#00000012')")) + f""",
top AS (SELECT merchant FROM rows GROUP BY merchant ORDER BY SUM(amount_cents) DESC, merchant LIMIT 10)
SELECT {TX_ID_SQL} AS id, CAST(date AS VARCHAR) AS date, merchant, description, amount_cents,
       CAST(row_number() OVER (PARTITION BY merchant ORDER BY date, {TX_ID_SQL}, amount_cents) AS INTEGER) AS rank
FROM rows WHERE merchant IN (SELECT merchant FROM top) QUALIFY rank <= 3""")
def merchant_transactions(spark, sf):
    """A8 with sample rows: three charges of each merchant."""
    return A.merchant_transactions(ledger_orders(spark, sf), "Customer#00000012", rows=3)
