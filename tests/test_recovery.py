"""Interrupted swaps, compaction of stream totals, and the order in which events were sent."""

import os

import pytest
from conftest import make_ledger
from pyspark.sql import functions as F

from ledgerspark.sinks import swap
from ledgerspark.sinks.events import write_events
from ledgerspark.sinks.ledger import read_ledger, write_upsert
from ledgerspark.streaming import jobs

RULES = [("food", ["cafe"])]


@pytest.mark.parametrize("step", ["before", "partly", "emptied"])
def test_interrupted_event_swap_is_finished(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "events")
    ev = lambda rows: spark.createDataFrame(rows, "event_id string, ts string, page string").withColumn(
        "ts", F.to_timestamp("ts"))
    write_events(spark, path, ev([("1", "2025-01-01 10:00:00", "a"), ("2", "2025-01-02 10:00:00", "a"), ("3", "2025-01-03 10:00:00", "a")]))
    change = ev([("1", "2025-01-05 10:00:00", "b"), ("2", "2025-01-02 10:00:00", "b")])
    finish = swap._finish

    def crash(spark, path, note):
        if step == "partly":  # some of the partitions are in place
            (spark.read.parquet(note["aside"]).where("event_date = '2025-01-02'").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))
        if step == "emptied":  # all are in place, the emptied one is still there
            (spark.read.parquet(note["aside"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("event_date").parquet(path))
        raise RuntimeError("crash")

    monkeypatch.setattr(swap, "_finish", crash)
    with pytest.raises(RuntimeError):
        write_events(spark, path, change)
    monkeypatch.setattr(swap, "_finish", finish)
    assert swap.recover(spark, path) and not swap.recover(spark, path)
    got = {(r.event_id, str(r.event_date), r.page) for r in spark.read.parquet(path).collect()}
    assert got == {("1", "2025-01-05", "b"), ("2", "2025-01-02", "b"), ("3", "2025-01-03", "a")}


def test_next_ledger_write_finishes_an_interrupted_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    write_upsert(spark, path, make_ledger(spark, [("2025-01-01", "a", "cafe", 1), ("2025-02-01", "b", "shop", 2)]), RULES)
    finish = swap._finish
    monkeypatch.setattr(swap, "_finish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        write_upsert(spark, path, make_ledger(spark, [("2025-01-03", "c", "shop", 3)]), RULES)
    monkeypatch.setattr(swap, "_finish", finish)
    write_upsert(spark, path, make_ledger(spark, [("2025-01-04", "d", "cafe", 4)]), RULES)
    assert {(str(r.date), r.category) for r in read_ledger(spark, path).collect()} == {
        ("2025-01-01", "food"), ("2025-02-01", "misc"), ("2025-01-03", "misc"), ("2025-01-04", "food")}


def test_stream_totals_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 3)
    rows = spark.range(110).select(F.expr("date'2025-01-31' + CAST(id % 3 AS INT)").alias("date"),
                                   F.expr("CASE WHEN id % 2 = 0 THEN 'x' END").alias("category"), F.lit(1).cast("decimal(18,2)").alias("amount"))
    src, sink = str(tmp_path / "src"), str(tmp_path / "sum")
    rows.repartition(11).write.parquet(src)
    jobs.stream_month_spend(spark, src, rows.schema, sink, str(tmp_path / "ck"), max_files=1)
    got = {(r.month, r.category): (float(r.total), r.transactions) for r in jobs.read_spend_totals(spark, sink).collect()}
    want = {}
    for i in range(110):
        k = ("2025-01" if i % 3 == 0 else "2025-02", "x" if i % 2 == 0 else "uncategorized")
        want[k] = (want.get(k, (0, 0))[0] + 1.0, want.get(k, (0, 0))[1] + 1)
    assert got == want
    assert [f for f in os.listdir(sink) if f.startswith("base-")] == ["base-8"]
    assert len([f for f in os.listdir(f"{sink}/partials") if f.startswith("batch_id=")]) == 2
    # a base that was not completed does not count
    os.makedirs(f"{sink}/base-10")
    assert {(r.month, r.category): (float(r.total), r.transactions) for r in jobs.read_spend_totals(spark, sink).collect()} == want


def test_last_sent_wins_over_later_time(spark, tmp_path):
    src = str(tmp_path / "src")
    for page, ts in (("first", "2025-03-05 00:00:00"), ("corrected", "2025-03-01 00:00:00")):
        spark.createDataFrame([("e", page, ts)], "event_id string, page string, ts string").withColumn(
            "ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    for k, files in enumerate((None, 1)):
        jobs.stream_event_dedupe(spark, src, schema, str(tmp_path / f"out{k}"), str(tmp_path / f"ck{k}"), max_files=files)
        assert [r.page for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()] == ["corrected"]
