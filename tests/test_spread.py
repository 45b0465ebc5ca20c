"""Inputs of many rows are dealt over tasks in proportion to them."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerspark.sources import entries


def test_recurring_steps_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(entries, "TASK_STEPS", 100, raising=False)
    specs = [{"description": f"d{k}", "merchant": "m", "amount": 1, "cadence": "daily", "start_date": "2025-01-01",
              "count": None if k % 2 else 50} for k in range(40)]
    one = entries.recurring_specs(spark, specs).coalesce(1)
    rows, _ = entries.expand_recurring(one, "2025-02-20")  # 51 days
    assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 500
    got = {(r.spec_id, str(r.date), r.seq) for r in rows.collect()}
    day = lambda k: str(dt.date(2025, 1, 1) + dt.timedelta(days=k))
    assert got == {(s, day(k), k) for s in range(40) for k in range(51 if s % 2 else 50)}
    assert rows.count() == 20 * 51 + 20 * 50


def test_upsert_sorts_bounded_tasks(spark, tmp_path, monkeypatch, ledger_factory):
    from ledgerspark.sinks import ledger

    monkeypatch.setattr(ledger, "TASK_ROWS", 10, raising=False)
    rows = [(f"2025-0{1 + k % 3}-01", "d", f"m{k}", k, "p") for k in range(200)]
    batch = ledger_factory(rows + rows[:50]).coalesce(1)
    tasks, merge = [], ledger.upsert

    def spy(old, new, rules):
        tasks.extend(d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] for d in (old, new))
        return merge(old, new, rules)

    monkeypatch.setattr(ledger, "upsert", spy)
    path = str(tmp_path / "ledger")
    for _ in range(2):
        ledger.write_upsert(spark, path, batch, [("c", ["m1"])])
    assert all(n is None or n <= 40 for n in tasks) and len(tasks) == 4
    stored = ledger.read_ledger(spark, path)
    assert stored.count() == 200 and stored.where("category = 'c'").count() == sum(str(k).startswith("1") for k in range(200))
