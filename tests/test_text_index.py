"""The stored text index gives what a search over the ledger gives, without reading it."""

import shutil

import pytest
from conftest import make_ledger

from ledgerspark.operators import search as S


def test_index_equals_search_over_the_ledger(spark, tmp_path):
    names = ["Café Brûlée", "CAFE 24", "cafecafe", "a", "", "Ab", "x_y%z", "STRASSE straße", "İstanbul"]
    led = make_ledger(spark, [("2025-01-01", "d", n, 1, "Amex Gold", c) for n in names for c in ("food", "Caf-é", None)])
    path, src = str(tmp_path / "index"), str(tmp_path / "ledger")
    led.write.parquet(src)
    stored = spark.read.parquet(src)
    S.write_text_index(path, stored)
    want = {q: S.search_dimensions(stored, q, limit=50).collect() for q in ("caf", "CAFE", "a", "é", "cafecaf", "y%z", "amex", "ß", "i̇s", "zzz", "ab")}
    few = S.search_dimensions(stored, "caf", types=["category"]).collect()
    shutil.rmtree(src)
    for q, rows in want.items():
        assert S.search_text_index(spark, path, q, limit=50).collect() == rows, q
    assert S.search_text_index(spark, path, "caf", types=["category"]).collect() == few
    plan = S.search_text_index(spark, path, "cafe")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(ValueError):
        S.search_text_index(spark, path, "")
