"""Report tables (fixture §4), sinks (K1-K3) and properties of the merges."""

import os

from pyspark.sql import functions as F

from ledgerspark.operators import dedupe as U
from ledgerspark.operators import reports as R
from ledgerspark.sinks.ledger import read_ledger, write_master_csv, write_month_extract, write_upsert

REPORT = [("2024-03-01", "Dinner", "Bistro", 20, None, "restaurants"), ("2024-01-05", "Food", "Mart", 10, None, "groceries"),
          ("2024-02-10", "Lunch", "Deli", 4, None, "restaurants"), ("2024-01-15", "Food", "Mart", 15, None, "groceries"),
          ("2024-02-20", "Thing", "Store", 8, None, "other")]


def test_chart_tables(ledger_factory):
    led = ledger_factory(REPORT)
    assert [(r.label, r.total) for r in R.chart_monthly(led).collect()] == \
        [("January 2024", 25.0), ("February 2024", 12.0), ("March 2024", 20.0)]
    grid = {(r.month, r.category): r.total for r in R.chart_category_month(led, ["restaurants", "groceries"]).collect()}
    assert [grid[(m, "restaurants")] for m in ("2024-01", "2024-02", "2024-03")] == [0.0, 4.0, 20.0]
    assert [grid[(m, "groceries")] for m in ("2024-01", "2024-02", "2024-03")] == [25.0, 0.0, 0.0]
    cats = [(r.category, r.total) for r in R.chart_categories(led).collect()]
    assert cats == [("groceries", 25.0), ("restaurants", 24.0), ("other", 8.0)]
    seeded = dict((r.category, r.total) for r in R.chart_categories(led, seed=["car", "misc"]).collect())
    assert seeded["car"] == 0.0 and seeded["groceries"] == 25.0


def test_rollup_subtotals(ledger_factory):
    led = ledger_factory([("2025-05-01", "a", "m", 50, None, "x"), ("2025-05-02", "b", "m", 29.12, None, "y")])
    rows = {r.label: r.total for r in R.month_category_rollup(led).collect()}
    assert rows["May 2025 Total"] == 79.12 and rows["Grand Total"] == 79.12


def test_rollup_leaves_sum_to_grand_total(ledger_factory):
    led = ledger_factory(REPORT)
    rows = R.month_category_rollup(led).collect()
    leaves = sum(r.total for r in rows if r.level == 0)
    grand = [r.total for r in rows if r.level == 3][0]
    assert abs(leaves - grand) < 1e-9 and grand == 57.0


def test_pivot_and_text_lines(ledger_factory):
    led = ledger_factory(REPORT)
    p = {r.month: r for r in R.month_category_pivot(led, ["groceries", "restaurants"]).collect()}
    assert p["2024-01"].groceries == 25.0 and p["2024-02"].restaurants == 4.0 and p["2024-02"].total == 12.0
    lines = sorted(r.line for r in R.text_lines(led).collect())
    assert lines[0] == "2024-01-05 | Food | Mart | 10.00"


def test_month_extract_order(ledger_factory):
    led = ledger_factory([("2025-05-01", "a", "m", -90), ("2025-05-02", "b", "m", 50), ("2025-05-03", "c", "m", 70)])
    assert [float(r.amount) for r in R.month_extract_rows(led).collect()] == [-90.0, 70.0, 50.0]


def test_dedupe_first_is_idempotent(ledger_factory):
    led = ledger_factory([("2025-01-01", "a", "m", 1, "p1"), ("2025-01-02", "b", "m", 2, "p1")])
    u = U.union_sources(led, led.withColumn("provider", F.lit("p2")))
    once = U.dedupe_first(u)
    twice = U.dedupe_first(U.union_sources(once.drop("src_ord", "seq"), once.drop("src_ord", "seq")))
    assert sorted(once.select("date", "provider").collect()) == sorted(twice.select("date", "provider").collect())
    assert {r.provider for r in once.collect()} == {"p1"}


def test_upsert_semantics(ledger_factory):
    old = ledger_factory([("2025-01-01", "Coffee", "Cafe", 3.5, "amex"), ("2025-01-02", "Book", "Store", 12, None)])
    batch = ledger_factory([("2025-01-01", "Coffee ", " Cafe", 3.5, "tdvisa"), ("2025-01-02", "Book", "Store", 12, "  "),
                            ("2025-01-02", "Book", "Store", 12, "manual"), ("2025-01-03", "New", "Shop", 1, "")])
    rules = [("coffee", ["cafe"]), ("books", ["book"])]
    out = {r.description: r for r in U.upsert(old, batch, rules).collect()}
    assert out["Coffee"].provider == "amex" and out["Coffee"].category == "coffee"
    assert out["Book"].provider == "manual" and out["Book"].category == "books"
    assert out["New"].provider is None and out["New"].category == "misc"


def test_write_upsert_twice_equals_once(spark, ledger_factory, tmp_path):
    path = str(tmp_path / "ledger")
    batch = ledger_factory([("2025-01-01", "Coffee", "Cafe", 3.5, "amex"), ("2025-02-01", "Book", "Store", 12, "p")])
    rules = [("coffee", ["cafe"])]
    write_upsert(spark, path, batch, rules)
    first = sorted(tuple(r) for r in read_ledger(spark, path).collect())
    write_upsert(spark, path, batch, rules)
    assert sorted(tuple(r) for r in read_ledger(spark, path).collect()) == first
    more = ledger_factory([("2025-02-01", "Book", "Store", 12, None), ("2025-03-01", "Pen", "Store", 2, "p")])
    write_upsert(spark, path, more, [("stationery", ["pen", "book"])])
    after = {r.description: r for r in read_ledger(spark, path).collect()}
    assert len(after) == 3 and after["Book"].category == "stationery" and after["Book"].provider == "p"
    assert after["Coffee"].category == "coffee"
    assert [d for d in sorted(os.listdir(path)) if d.startswith("month=")] == \
        ["month=2025-01", "month=2025-02", "month=2025-03"]


def test_csv_and_month_extract_writers(spark, ledger_factory, tmp_path):
    led = ledger_factory(REPORT)
    write_master_csv(U.union_sources(led), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 5 and set(back.columns) == {"date", "description", "merchant", "category", "amount", "year"}
    write_month_extract(led, str(tmp_path / "months"))
    assert spark.read.option("header", True).csv(str(tmp_path / "months")).select("month").distinct().count() == 3
