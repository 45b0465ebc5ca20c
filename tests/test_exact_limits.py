"""Paging over equal rows, argument limits, keyword rules of any number, moved events in the session stream."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import paging
from ledgerspark.operators import patterns as X
from ledgerspark.operators.categorize import categorize
from ledgerspark.operators.summaries import spend_summary
from ledgerspark.schema import Filters
from ledgerspark.streaming import jobs


def test_keyset_pages_show_equal_rows_once(ledger_factory):
    led = ledger_factory([("2025-01-01", "same", "Shop", 5)] * 5 + [("2025-01-02", "next", "Shop", 6)])
    shown, last, seen = [], None, 1
    for _ in range(10):
        page = paging.keyset_page(led, limit=2, last=last, seen=seen).collect()
        if not page:
            break
        shown += page
        last = page[-1]
        seen = sum(r == last for r in shown)
    assert [r.description for r in shown] == ["same"] * 5 + ["next"]


def test_limits(ledger_factory):
    led = ledger_factory([("2025-01-%02d" % (i + 1), f"r{i}", f"Shop {i}", 1 + i) for i in range(30)])
    with pytest.raises(ValueError):
        spend_summary(led, "merchant", limit=0)
    assert spend_summary(led, "merchant", limit=25).count() == 25
    assert paging.get_transactions(led, limit=10).first().truncated is False
    exact = paging.query_transactions(led, Filters(min_amount=4.999, max_amount=7.001)).collect()
    assert sorted(float(r.amount) for r in exact) == [5.0, 6.0, 7.0]


def test_rules_of_any_number(spark):
    rows = [("A+B (x)", ""), ("", "ÉCLAIR"), ("a|b", "zz"), (None, None), ("aab", "")]
    df = spark.createDataFrame(rows, "merchant string, description string")
    rules = [("plus", ["a+b (X)"]), ("cake", ["éclair"]), ("bar", ["A|B"])]
    for extra in (0, 400):
        many = [*rules, ("none", [f"never{i}" for i in range(extra)])]
        got = [r.category for r in categorize(df, many).collect()]
        assert got == ["plus", "cake", "bar", "misc", "misc"]


def test_charge_gaps_with_equal_rows(ledger_factory):
    led = ledger_factory([("2025-01-01", "a", "Shop", 5), ("2025-01-04", "b", "Shop", 5), ("2025-01-04", "b", "Shop", 5),
                          ("2025-03-01", "c", "Shop", 1), ("2025-02-01", "d", "Other", 1)])
    got = sorted((r.merchant, str(r.date), -1 if r.gap_days is None else r.gap_days) for r in X.charge_gaps(led).collect())
    assert got == [("Other", "2025-02-01", -1), ("Shop", "2025-01-01", -1), ("Shop", "2025-01-04", 0),
                   ("Shop", "2025-01-04", 3), ("Shop", "2025-03-01", 56)]


def test_event_that_changes_its_session(spark, tmp_path):
    at = lambda h: dt.datetime(2025, 1, 1, h)
    batches = [[("1", "A", at(1)), ("2", "A", at(2)), ("3", "C", at(3))],
               [("2", "B", at(4)), ("3", "B", at(5))],
               [("4", "A", at(6))]]
    src = str(tmp_path / "src")
    for rows in batches:
        (spark.createDataFrame([(e, "u", s, "click", "/", t) for e, s, t in rows],
                               "event_id string, user_id string, session_id string, event_type string, page string, ts timestamp")
         .coalesce(1).write.mode("append").parquet(src))
        jobs.stream_sessions(spark, src, spark.read.parquet(src).schema, str(tmp_path / "ev"), str(tmp_path / "out"),
                             str(tmp_path / "ck"), max_files=1)
    got = {r.session_id: r.event_count for r in jobs.read_sessions(spark, str(tmp_path / "out")).collect()}
    assert got == {"A": 2, "B": 2}
