import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerspark.session import get_spark

    s = get_spark(master="local[*]", shuffle_partitions=8, app_name="ledgerspark-tests")
    yield s
    s.stop()


def make_ledger(spark, rows, rules=None):
    """rows: (date, description, merchant, amount[, provider]) tuples -> LEDGER DataFrame,
    categorized by ``rules`` (as the upsert does) when given."""
    from ledgerspark.operators.categorize import categorize
    from ledgerspark.schema import LEDGER

    data = []
    for r in rows:
        d, desc, merch, amt = r[:4]
        prov = r[4] if len(r) > 4 else None
        cat = r[5] if len(r) > 5 else None
        data.append((dt.date.fromisoformat(d), desc, merch, Decimal(str(amt)).quantize(Decimal("0.01")), cat, prov))
    df = spark.createDataFrame(data, LEDGER)
    if rules is not None:
        df = categorize(df, rules)
    return df


@pytest.fixture
def ledger_factory(spark):
    return lambda rows, rules=None: make_ledger(spark, rows, rules)
