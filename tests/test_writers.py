"""The stored writers: unreadable tables, moved events, streams in many micro-batches."""

import os

import pytest
from conftest import make_ledger
from pyspark.sql import functions as F

from ledgerspark.sinks.events import write_events
from ledgerspark.sinks.ledger import read_ledger, write_upsert
from ledgerspark.streaming import jobs

RULES = [("food", ["cafe"])]


def test_unreadable_ledger_fails_and_keeps_its_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    write_upsert(spark, path, make_ledger(spark, [("2025-01-01", "a", "cafe", 1), ("2025-01-02", "b", "shop", 2)]), RULES)
    bad = os.path.join(path, "month=2025-01", "part-bad.snappy.parquet")
    spark.range(1).select(F.lit(True).alias("amount")).coalesce(1).write.parquet(str(tmp_path / "bad"))
    name = next(f for f in os.listdir(tmp_path / "bad") if f.endswith(".parquet"))
    os.link(tmp_path / "bad" / name, bad)
    with pytest.raises(Exception):
        write_upsert(spark, path, make_ledger(spark, [("2025-01-03", "c", "shop", 3)]), RULES)
    os.unlink(bad)
    assert read_ledger(spark, path).count() == 2


def test_moved_event_leaves_its_old_date(spark, tmp_path):
    path = str(tmp_path / "events")
    ev = lambda rows: spark.createDataFrame(rows, "event_id string, ts string, page string").withColumn(
        "ts", F.to_timestamp("ts"))
    write_events(spark, path, ev([("1", "2025-01-01 10:00:00", "a"), ("2", "2025-01-02 10:00:00", "a")]))
    write_events(spark, path, ev([("1", "2025-01-05 10:00:00", "b")]))
    got = {(r.event_id, str(r.event_date), r.page) for r in spark.read.parquet(path).collect()}
    assert got == {("1", "2025-01-05", "b"), ("2", "2025-01-02", "a")}


def test_streams_lose_nothing_over_many_batches(spark, tmp_path):
    days = spark.range(200).select(F.col("id").cast("string").alias("event_id"),
                                   F.expr("timestamp'2025-03-01 00:00:00' - make_interval(0, 0, 0, CAST(id % 30 AS INT))").alias("ts"))
    src = str(tmp_path / "src")
    days.repartition(6).write.parquet(src)
    jobs.stream_event_dedupe(spark, src, days.schema, str(tmp_path / "out"), str(tmp_path / "ck"), max_files=1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    spend = days.select(F.to_date("ts").alias("date"), F.lit(1).cast("decimal(18,2)").alias("amount"))
    src = str(tmp_path / "spend")
    spend.repartition(6).write.parquet(src)
    jobs.stream_daily_spend(spark, src, spend.schema, str(tmp_path / "sum"), str(tmp_path / "ck2"), max_files=1)
    assert jobs.read_daily_spend(spark, str(tmp_path / "sum")).agg(F.sum("transactions")).first()[0] == 200


def test_bare_card_number_is_redacted():
    from ledgerspark.functions.sanitize import sanitize_json_text

    assert "4111" not in sanitize_json_text("4111111111111111")
    assert sanitize_json_text("5") == '{"value":5}'


def test_files_without_header_or_column_are_reported(spark, tmp_path):
    from ledgerspark.sources.statements import load_statements

    (tmp_path / "amex-2025.csv").write_text("01 Feb 2025,shop,12.50\n02 Feb 2025,cafe,3.00\n")
    (tmp_path / "wealthsimple-2025.csv").write_text("transaction_date,type,details\n2025-02-01,buy,shop\n")
    res = load_statements(spark, str(tmp_path), bank_keys=["amex", "wealthsimple"])
    reasons = {(r.file.rsplit("/", 1)[1], r.reason) for r in res.quarantine.select("file", "reason").collect()}
    assert reasons == {("amex-2025.csv", "no header"), ("wealthsimple-2025.csv", "missing column")}
    assert res.rows.count() == 0
