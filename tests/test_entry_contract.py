"""The driver contract: entry() on sf0.001, and every registered query equal to its DuckDB
oracle on sf0.001 (row count, columns and an order-insensitive value hash)."""

import hashlib
import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMOKE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["category", "total", "transactions"] and len(rows) > 0


def test_every_query_has_an_oracle_or_is_listed():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    core = {q for q in qs if not re.match(r"op\d+_|pipeline$", q)}  # the corpus queries have tests of their own
    assert core - set(orc) == set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMOKE)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(srows, df.columns) == _digest(orows, ocols)
