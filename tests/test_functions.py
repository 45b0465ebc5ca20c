"""Column functions (F2-F23), SQL functions (X3), schema upgrade (S13) and the event sink (K5)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerspark.functions import (
    amount_bucket, cents, clean_text, currency_text, iso_week_key, loose_amount, money, month_label, normalize_key,
    period_key, python_float_text, slug, split_list, tx_id,
)
from ledgerspark.functions.dates import add_months, comparison_range, quick_range
from ledgerspark.functions.text import looks_sensitive_text, is_sensitive_key, parse_list


def _one(spark, col, value, schema="x STRING"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first().y


def test_slug_and_tx_id(spark):
    assert _one(spark, slug("x"), "  Dining & Out! ") == "dining_out"
    assert _one(spark, slug("x"), "   ") == "uncategorized"
    assert _one(spark, slug("x"), None) == "uncategorized"
    df = spark.createDataFrame([(dt.date(2025, 1, 5), "Cafe", Decimal("12.00"), "Lunch")],
                               "date DATE, merchant STRING, amount DECIMAL(18,2), description STRING")
    assert df.select(tx_id()).first()[0] == "2025_01_05_cafe_12_0_lunch"


def test_money(spark):
    df = spark.createDataFrame([(Decimal("12.34"), 1234)], "amount DECIMAL(18,2), c BIGINT")
    r = df.select(cents("amount").alias("c1"), money("c").alias("m"), python_float_text("amount").alias("t"),
                  currency_text(F.lit(-1234.5)).alias("cur"), amount_bucket("amount").alias("b")).first()
    assert (r.c1, r.m, r.t, r.cur, r.b) == (1234, 12.34, "12.34", "$-1,234.50", "under_25")
    assert _one(spark, loose_amount("x"), "$1,234.50") == 1234.5 and _one(spark, loose_amount("x"), "n/a") == 0.0


def test_period_keys(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2024, 12, 30),)], "date DATE")
    got = [(r.m, r.q, r.w, r.l) for r in df.select(period_key("month").alias("m"), period_key("quarter").alias("q"),
                                                   iso_week_key().alias("w"), month_label().alias("l")).collect()]
    assert got == [("2021-01", "2021-Q1", "2020-W53", "January 2021"), ("2024-12", "2024-Q4", "2025-W01", "December 2024")]


def test_text_functions(spark):
    # cut after trimming, as the reference does: a trailing space can survive the cut
    assert _one(spark, clean_text("x", 10), "a\x00b \t\n c  d e f g h") == "a b c d e "
    assert _one(spark, normalize_key("x"), " Result Count!! ") == "result_count"
    assert _one(spark, normalize_key("x"), "resultCount") == "resultcount"
    assert _one(spark, looks_sensitive_text("x"), "card 4111-1111 1111") is True
    assert _one(spark, looks_sensitive_text("x"), "mail me@x.io") is True
    assert _one(spark, looks_sensitive_text("x"), "order 12345") is False
    assert _one(spark, is_sensitive_key("x"), "shipping") is True
    assert _one(spark, split_list("x"), " a, b,,a , c ") == ["a", "b", "c"]
    assert parse_list("groceries, ,car,groceries") == ["groceries", "car"]


def test_date_parameters():
    assert add_months(dt.date(2025, 1, 31), 1) == dt.date(2025, 2, 28)
    assert comparison_range("2025-02-01", "2025-02-28", "previous_period") == (dt.date(2025, 1, 4), dt.date(2025, 1, 31))
    assert comparison_range("2024-02-29", "2024-03-31", "same_period_last_year") == (dt.date(2023, 2, 28), dt.date(2023, 3, 31))
    assert quick_range("last_3m", "2025-05-31") == (dt.date(2025, 2, 28), dt.date(2025, 5, 31))
    assert quick_range("month_2024_02", "2025-01-01") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))


def test_sql_functions(spark):
    from ledgerspark.functions.sql import register_sql_functions

    register_sql_functions(spark)
    r = spark.sql("SELECT slug(' Home & Garden ') AS s, cents(CAST(3.5 AS DECIMAL(18,2))) AS c, "
                  "period_key(DATE'2021-01-03', 'week') AS w").first()
    assert (r.s, r.c, r.w) == ("home_garden", 350, "2020-W53")


def test_missing_provider_column_is_upgraded(spark, tmp_path):
    from ledgerspark.sinks.ledger import read_ledger

    old = spark.createDataFrame([(dt.date(2025, 1, 1), "a", "m", Decimal("1.00"), "misc")],
                                "date DATE, description STRING, merchant STRING, amount DECIMAL(18,2), category STRING")
    old.write.parquet(str(tmp_path / "old"))
    r = read_ledger(spark, str(tmp_path / "old")).first()
    assert r.provider is None and r.category == "misc"


def test_event_sink_last_wins(spark, tmp_path):
    from ledgerspark.sinks.events import write_events

    rows = [("e1", "u", "s", "page_view", "/a", None, "{}", dt.datetime(2026, 5, 1, 10)),
            ("e2", "u", "s", "page_view", "/b", None, "{}", dt.datetime(2026, 5, 2, 10))]
    schema = ("event_id STRING, user_id STRING, session_id STRING, event_type STRING, page STRING, component STRING, "
              "metadata_json STRING, ts TIMESTAMP")
    path = str(tmp_path / "events")
    write_events(spark, path, spark.createDataFrame(rows, schema))
    write_events(spark, path, spark.createDataFrame([("e1", "u", "s", "page_view", "/again", None, "{}",
                                                      dt.datetime(2026, 5, 1, 10))], schema))
    got = {r.event_id: r.page for r in spark.read.parquet(path).collect()}
    assert got == {"e1": "/again", "e2": "/b"}


def test_checkpoint_dir_when_unset():
    """Without spark.checkpoint.dir a local folder is created once and reused; the core setting
    itself is never written (Spark rejects that at runtime)."""
    from ledgerspark.session import checkpoint_dir

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

        def set(self, k, v):
            assert k != "spark.checkpoint.dir"
            self[k] = v

    class Ctx:
        d = None

        def getCheckpointDir(self):
            return self.d

        def setCheckpointDir(self, d):
            self.d = d

    class FakeSession:
        conf = Conf()
        sparkContext = Ctx()

    s = FakeSession()
    first = checkpoint_dir(s)
    assert first and checkpoint_dir(s) == first and s.sparkContext.d == first
