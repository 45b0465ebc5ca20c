"""Registered ledger queries (steps 0-3 of the build plan): filters, summaries, paging,
categorization, dedupe/upsert, compact summaries and period comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.dates import quick_range
from ledgerspark.functions.money import amount_bucket
from ledgerspark.operators import filters as P
from ledgerspark.operators import paging, summaries as A
from ledgerspark.plans.registry import ORACLES, register
from ledgerspark.plans.sqlviews import LEDGER_LINES, LEDGER_ORDERS, with_
from ledgerspark.schema import Filters
from ledgerspark.sources.tables import ledger_lines, ledger_orders

# ---- query parameters ------------------------------------------------------------------
START, END = "1996-01-01", "1998-12-31"
AS_OF = "1998-06-15"


def _rows_out(df):
    """Row-level ledger output with text dates and DOUBLE amounts (oracle-comparable)."""
    return df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                     F.col("amount").cast("double").alias("amount"), "category", "provider")


ROWS_SQL = "CAST(date AS VARCHAR) AS date, description, merchant, CAST(amount AS DOUBLE) AS amount, category, provider"


@register("spend_by_category", with_(LEDGER_ORDERS) + f"""
SELECT COALESCE(category, 'uncategorized') AS category, CAST(SUM(amount) AS DOUBLE) AS total,
       COUNT(*) AS transactions
FROM ledger WHERE date >= DATE '{START}' AND date <= DATE '{END}'
GROUP BY 1""")
def spend_by_category(spark, sf):
    return A.summarize_by_category(ledger_orders(spark, sf), Filters(start=START, end=END))


def _period_sql(expr: str, where: str) -> str:
    return with_(LEDGER_ORDERS) + f"""
SELECT {expr} AS period, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger {where} GROUP BY 1"""


@register("spend_by_month", _period_sql("strftime(date, '%Y-%m')", "WHERE provider = 'f'"))
def spend_by_month(spark, sf):
    return A.summarize_by_period(ledger_orders(spark, sf), "month", Filters(provider="f"))


@register("spend_by_quarter", _period_sql(
    "strftime(date, '%Y') || '-Q' || CAST(quarter(date) AS VARCHAR)",
    "WHERE category IN ('machinery', 'building')"))
def spend_by_quarter(spark, sf):
    return A.summarize_by_period(ledger_orders(spark, sf), "quarter",
                                 Filters(categories=[" machinery", "building", "", "machinery"]))


@register("spend_by_year", _period_sql("strftime(date, '%Y')", ""))
def spend_by_year(spark, sf):
    return A.summarize_by_period(ledger_orders(spark, sf), "year")


@register("spend_by_merchant", with_(LEDGER_ORDERS) + f"""
SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger WHERE date >= DATE '{START}' GROUP BY 1""")
def spend_by_merchant(spark, sf):
    return A.summarize_by_merchant(ledger_orders(spark, sf), Filters(start=START))


@register("overview", with_(LEDGER_ORDERS) + f"""
SELECT COUNT(*) AS transactions, COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS total,
       COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 0.0) AS average,
       CAST(MIN(date) AS VARCHAR) AS first_date, CAST(MAX(date) AS VARCHAR) AS last_date
FROM ledger
WHERE date >= DATE '{START}' AND date <= DATE '{END}' AND provider = 'o'
  AND amount >= 100000.0 AND amount <= 300000.0""")
def overview(spark, sf):
    return A.overview(ledger_orders(spark, sf),
                      Filters(start=START, end=END, provider="o", min_amount=100000, max_amount=300000))


@register("overview_regex", with_(LEDGER_ORDERS) + """
SELECT COUNT(*) AS transactions, COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS total,
       COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 0.0) AS average,
       CAST(MIN(date) AS VARCHAR) AS first_date, CAST(MAX(date) AS VARCHAR) AS last_date
FROM ledger WHERE regexp_matches(merchant, '(?i)customer#0+1[0-4]\\d$')""")
def overview_regex(spark, sf):
    return A.overview(ledger_orders(spark, sf), Filters(merchant_regex=r"customer#0+1[0-4]\d$"))


@register("unique_merchants", with_(LEDGER_LINES) + """
SELECT merchant, array_to_string(list_sort(list_distinct(list(COALESCE(category, 'uncategorized')))), ',') AS categories
FROM ledger WHERE COALESCE(category, 'uncategorized') <> '' GROUP BY merchant""")
def unique_merchants(spark, sf):
    return (A.unique_merchants(ledger_lines(spark, sf))
            .select("merchant", F.array_join("categories", ",").alias("categories")))


@register("list_categories", with_(LEDGER_ORDERS) + """
SELECT DISTINCT COALESCE(category, 'uncategorized') AS category FROM ledger""")
def list_categories(spark, sf):
    return A.list_categories(ledger_orders(spark, sf))


@register("list_providers", with_(LEDGER_LINES) + """
SELECT DISTINCT provider FROM ledger WHERE provider IS NOT NULL AND trim(provider) <> ''""")
def list_providers(spark, sf):
    return A.list_providers(ledger_lines(spark, sf))


@register("filtered_transactions", with_(LEDGER_ORDERS) + f"""
SELECT {ROWS_SQL} FROM ledger
WHERE date >= DATE '{START}' AND date <= DATE '{END}' AND category IN ('automobile', 'furniture')
  AND amount >= 50000.0
ORDER BY amount DESC, date, merchant, description LIMIT 200 OFFSET 10""")
def filtered_transactions(spark, sf):
    f = Filters(start=START, end=END, categories=["automobile", "furniture"], min_amount=50000)
    return _rows_out(paging.query_transactions(ledger_orders(spark, sf), f, sort_by="amount",
                                               sort_dir="desc", limit=200, offset=10))


@register("merchant_like", with_(LEDGER_ORDERS) + f"""
SELECT {ROWS_SQL} FROM ledger WHERE lower(merchant) LIKE '%r#00000012%'""")
def merchant_like(spark, sf):
    return _rows_out(P.apply_filters(ledger_orders(spark, sf), Filters(merchant="R#00000012")))


@register("merchant_regex", with_(LEDGER_ORDERS) + f"""
SELECT {ROWS_SQL} FROM ledger WHERE regexp_matches(merchant, '(?i)customer#0+(7|8)7\\d$')
ORDER BY date, merchant, description, amount LIMIT 300 OFFSET 5""")
def merchant_regex(spark, sf):
    return _rows_out(paging.query_transactions(ledger_orders(spark, sf), Filters(merchant_regex=r"customer#0+(7|8)7\d$"),
                                               sort_by="date", limit=300, offset=5))


@register("exclude_category", with_(LEDGER_ORDERS) + """
SELECT COALESCE(category, 'uncategorized') AS category, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger WHERE lower(trim(COALESCE(category, ''))) <> 'machinery' GROUP BY 1""")
def exclude_category(spark, sf):
    return A.summarize_by_category(ledger_orders(spark, sf), Filters(exclude_category=" Machinery "))


@register("exclude_blank_category", with_(LEDGER_ORDERS) + """
SELECT COALESCE(category, 'uncategorized') AS category, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger WHERE lower(trim(COALESCE(category, ''))) <> '' GROUP BY 1""")
def exclude_blank_category(spark, sf):
    return A.summarize_by_category(ledger_orders(spark, sf), Filters(exclude_category="   "))


@register("grouped_sort_page", with_(LEDGER_ORDERS) + f"""
SELECT {ROWS_SQL} FROM ledger WHERE date >= DATE '{START}'
ORDER BY category ASC NULLS FIRST, amount DESC, date, merchant, description LIMIT 100 OFFSET 50""")
def grouped_sort_page(spark, sf):
    return _rows_out(paging.query_transactions(ledger_orders(spark, sf), Filters(start=START), sort_by="amount",
                                               sort_dir="desc", group_by="category", limit=100, offset=50))


@register("month_filter", with_(LEDGER_ORDERS) + f"""
SELECT {ROWS_SQL} FROM ledger WHERE strftime(date, '%Y-%m') = '1997-02'""")
def month_filter(spark, sf):
    return _rows_out(ledger_orders(spark, sf).filter(P.month_filter("1997-02")))


_QR = quick_range("last_3m", AS_OF)


@register("quick_range", with_(LEDGER_ORDERS) + f"""
SELECT strftime(date, '%Y-%m') AS period, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions
FROM ledger WHERE date >= DATE '{_QR[0]}' AND date <= DATE '{_QR[1]}' GROUP BY 1""")
def quick_range_q(spark, sf):
    start, end = quick_range("last_3m", AS_OF)
    return A.summarize_by_period(ledger_orders(spark, sf), "month", Filters(start=start, end=end))


@register("amount_buckets", with_(LEDGER_LINES) + """
SELECT CASE WHEN abs(amount) < 25 THEN 'under_25' WHEN abs(amount) < 100 THEN 'under_100'
            WHEN abs(amount) < 250 THEN 'under_250' ELSE '250_plus' END AS bucket,
       COUNT(*) AS transactions, CAST(SUM(amount) AS DOUBLE) AS total
FROM ledger GROUP BY 1""")
def amount_buckets(spark, sf):
    return (ledger_lines(spark, sf).groupBy(amount_bucket().alias("bucket"))
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("double").alias("total")))


# ---- step 2: categorization, dedupe, upsert, extracts -------------------------------------
from ledgerspark.operators import dedupe as U  # noqa: E402
from ledgerspark.operators.categorize import categorize  # noqa: E402
from ledgerspark.session import staging_path
from ledgerspark.sinks.ledger import csv_rows, read_ledger, write_upsert  # noqa: E402

# fixed values: rules for the order ledger in the upsert query
UPSERT_RULES = [("urgent", ["urgent"]), ("club", ["customer#0000001"]), ("other", [""])]


def _many_rules():
    """A large rule set built from a rule (hundreds of keywords): brand digits and
    part-name words spread over seven categories; one keyword per brand number."""
    rules: dict[str, list[str]] = {}
    for i in range(300):
        rules.setdefault(f"group{i % 7}", []).append(f"brand#{i}")
    rules.setdefault("words", []).extend(["anvil", "widget"])
    return list(rules.items())


def _case_sql(rules, merchant="merchant", description="description") -> str:
    parts = []
    for cat, kws in rules:
        if not kws:
            continue
        conds = " OR ".join("TRUE" if kw == "" else
                            f"contains(lower({merchant}), '{kw.lower()}') OR contains(lower({description}), '{kw.lower()}')"
                            for kw in kws)
        parts.append(f"WHEN {conds} THEN '{cat}'")
    return "CASE " + " ".join(parts) + " ELSE 'misc' END"


@register("categorize", with_(LEDGER_LINES) + """
SELECT category, COUNT(*) AS transactions, CAST(SUM(amount) AS DOUBLE) AS total FROM ledger GROUP BY 1""")
def categorize_q(spark, sf):
    return (ledger_lines(spark, sf).groupBy("category")
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("double").alias("total")))


@register("categorize_many_rules", with_(LEDGER_LINES) + f"""
SELECT {_case_sql(_many_rules())} AS category, merchant, COUNT(*) AS transactions
FROM ledger GROUP BY 1, 2""")
def categorize_many_rules(spark, sf):
    df = categorize(ledger_lines(spark, sf, categorized=False), _many_rules())
    return df.groupBy("category", "merchant").agg(F.count(F.lit(1)).alias("transactions"))


MANY_KEYWORDS = 50_000


def _customer_rules() -> list[tuple[str, list[str]]]:
    """50,000 keywords, one a customer number, in 97 categories; a first rule overlaps with them."""
    by = [(f"cat-{g}", [f"customer#{k:09d}" for k in range(g, MANY_KEYWORDS, 97)]) for g in range(97)]
    return [("vip", ["0077", "URGENT"]), *by, ("rest", ["5-low"])]


@register("categorize_50k_rules", with_(LEDGER_ORDERS) + f"""
SELECT CASE WHEN contains(merchant, '0077') OR contains(lower(description), 'urgent') THEN 'vip'
            WHEN CAST(right(merchant, 9) AS INTEGER) < {MANY_KEYWORDS} THEN 'cat-' || CAST(right(merchant, 9) AS INTEGER) % 97
            WHEN description = '5-LOW' THEN 'rest' ELSE 'misc' END AS category,
       merchant, COUNT(*) AS transactions
FROM ledger GROUP BY 1, 2""")
def categorize_50k_rules(spark, sf):
    """J4 through the keyword index."""
    df = categorize(ledger_orders(spark, sf), _customer_rules())
    return df.groupBy("category", "merchant").agg(F.count(F.lit(1)).alias("transactions"))


# A copy of the 1997 rows with another category arrives first (src_ord 0); originals second.
_DUP_SQL = with_(LEDGER_ORDERS) + """, allr AS (
  SELECT date, description, merchant, amount, 'copied' AS category, provider, 0 AS src_ord FROM ledger
  WHERE date >= DATE '1997-01-01' AND date <= DATE '1997-12-31'
  UNION ALL SELECT date, description, merchant, amount, category, provider, 1 AS src_ord FROM ledger)
"""


@register("dedupe_first", _DUP_SQL + """
SELECT CAST(date AS VARCHAR) AS date, description, merchant, CAST(amount AS DOUBLE) AS amount, category, provider
FROM allr QUALIFY row_number() OVER (PARTITION BY date, description, merchant, amount ORDER BY src_ord) = 1""")
def dedupe_first(spark, sf):
    led = ledger_orders(spark, sf)
    copy = led.filter(P.date_range("1997-01-01", "1997-12-31")).withColumn("category", F.lit("copied"))
    return _rows_out(U.dedupe_first(U.union_sources(copy, led)))


def _upsert_batch_sql() -> str:
    return """batch AS (
  SELECT date, description || ' ' AS description, merchant, amount, '  ' AS provider, 1 AS seq FROM ledger
  WHERE date >= DATE '1997-03-01' AND date <= DATE '1997-06-30'
  UNION ALL
  SELECT date, description, merchant, amount + 1, 'new' AS provider, 2 AS seq FROM ledger
  WHERE date >= DATE '1997-05-01' AND date <= DATE '1997-08-31')"""


def _upsert_batch(led):
    a = (led.filter(P.date_range("1997-03-01", "1997-06-30"))
         .select("date", F.concat("description", F.lit(" ")).alias("description"), "merchant", "amount",
                 F.lit("  ").alias("provider"), F.lit(1).cast("bigint").alias("seq")))
    b = (led.filter(P.date_range("1997-05-01", "1997-08-31"))
         .select("date", "description", "merchant", (F.col("amount") + 1).cast("decimal(18,2)").alias("amount"),
                 F.lit("new").alias("provider"), F.lit(2).cast("bigint").alias("seq")))
    return a.unionByName(b)


@register("ledger_upsert", with_(LEDGER_ORDERS, _upsert_batch_sql()) + f""",
prepared AS (
  SELECT date, trim(description) AS description, trim(merchant) AS merchant, amount,
         {_case_sql(UPSERT_RULES)} AS category, NULLIF(trim(provider), '') AS provider, seq FROM batch),
allr AS (SELECT date, description, merchant, amount, category, provider, 0 AS seq FROM ledger
         UNION ALL SELECT * FROM prepared)
SELECT CAST(date AS VARCHAR) AS date, description, merchant, CAST(amount AS DOUBLE) AS amount,
       arg_max(category, seq) AS category,
       arg_min(provider, seq) FILTER (WHERE provider IS NOT NULL) AS provider
FROM allr GROUP BY date, description, merchant, amount""")
def ledger_upsert(spark, sf):
    led = ledger_orders(spark, sf)
    return _rows_out(U.upsert(led, _upsert_batch(led), UPSERT_RULES))


@register("ledger_upsert_stored", ORACLES["ledger_upsert"])
def ledger_upsert_stored(spark, sf):
    """K1 through its writer: a batch merged into a stored, month-partitioned ledger."""
    led = ledger_orders(spark, sf)
    path = staging_path(spark, "ledger-stored")
    led.withColumn("month", F.date_format("date", "yyyy-MM")).write.partitionBy("month").parquet(path)
    write_upsert(spark, path, _upsert_batch(led), UPSERT_RULES)
    return _rows_out(read_ledger(spark, path))


@register("csv_last_wins", _DUP_SQL + """
SELECT CAST(date AS VARCHAR) AS date, trim(description) AS description, trim(merchant) AS merchant,
       category, CAST(round(amount, 2) AS DOUBLE) AS amount
FROM allr QUALIFY row_number() OVER (PARTITION BY date, trim(description), trim(merchant), round(amount, 2)
                                     ORDER BY src_ord DESC) = 1""")
def csv_last_wins(spark, sf):
    led = ledger_orders(spark, sf)
    copy = led.filter(P.date_range("1997-01-01", "1997-12-31")).withColumn("category", F.lit("copied"))
    out = csv_rows(U.union_sources(copy, led))
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant", "category",
                      F.col("amount").cast("double").alias("amount"))


@register("alldata_dedupe", with_(LEDGER_ORDERS) + """, txt AS (
  SELECT date, description, merchant, category, '$' || format('{:,.2f}', CAST(amount AS DOUBLE)) AS amount_text FROM ledger
  UNION ALL SELECT date, description, merchant, category, '$' || format('{:,.2f}', CAST(amount AS DOUBLE)) FROM ledger
  WHERE provider = 'p'
  UNION ALL SELECT date, description, merchant, category, 'n/a' FROM ledger WHERE provider = 'p')
SELECT DISTINCT strftime(date, '%B %Y') AS month, CAST(date AS VARCHAR) AS date, description, merchant, category,
       COALESCE(TRY_CAST(replace(replace(trim(amount_text), '$', ''), ',', '') AS DOUBLE), 0.0) AS amount
FROM txt""")
def alldata_dedupe(spark, sf):
    from ledgerspark.functions.money import currency_text

    led = ledger_orders(spark, sf)
    txt = led.select("date", "description", "merchant", "category", currency_text("amount").alias("amount_text"))
    pending = led.filter(F.col("provider") == "p")
    again = pending.select("date", "description", "merchant", "category", currency_text("amount").alias("amount_text"))
    bad = pending.select("date", "description", "merchant", "category", F.lit("n/a").alias("amount_text"))
    return U.alldata_rows(txt.unionByName(again).unionByName(bad), "amount_text")


# ---- W4, O4, X3 -----------------------------------------------------------------------------

@register("numbered_page", with_(LEDGER_ORDERS) + f"""
SELECT {ROWS_SQL}, row_number() OVER (ORDER BY amount ASC, date, merchant, description) + 40 AS row FROM (
  SELECT * FROM ledger WHERE provider = 'p' ORDER BY amount ASC, date, merchant, description LIMIT 25 OFFSET 40)""")
def numbered_page(spark, sf):
    out = paging.numbered_page(ledger_orders(spark, sf), Filters(provider="p"), sort_by="amount", limit=25, offset=40)
    return out.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
        F.col("amount").cast("double").alias("amount"), "category", "provider", "row")


@register("top_merchants", with_(LEDGER_LINES) + """
SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS transactions FROM ledger
WHERE category = 'hardware' GROUP BY 1 ORDER BY total DESC, merchant LIMIT 21""")
def top_merchants(spark, sf):
    return paging.top_merchants(ledger_lines(spark, sf), Filters(category="hardware"))


@register("sql_functions", with_(LEDGER_ORDERS) + """
SELECT regexp_replace(regexp_replace(lower(merchant), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS merchant_id,
       strftime(date, '%Y') || '-Q' || CAST(quarter(date) AS VARCHAR) AS quarter,
       strftime(date, '%G-W%V') AS week, SUM(CAST(amount * 100 AS BIGINT)) AS total_cents
FROM ledger WHERE date >= DATE '1998-01-01' GROUP BY 1, 2, 3""")
def sql_functions(spark, sf):
    from ledgerspark.functions.sql import register_sql_functions

    register_sql_functions(spark)
    ledger_orders(spark, sf).createOrReplaceTempView("ledger_orders_v")
    return spark.sql("""
        SELECT slug(merchant) AS merchant_id, period_key(date, 'quarter') AS quarter, period_key(date, 'week') AS week,
               SUM(cents(amount)) AS total_cents
        FROM ledger_orders_v WHERE date >= DATE '1998-01-01' GROUP BY 1, 2, 3""")
