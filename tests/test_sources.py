"""Statement loaders (S1-S8), manual entries (S9), recurring rules (S10) and the import job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.plans.statement_import import import_all
from ledgerspark.sources import statements as S
from ledgerspark.sources.entries import expand_recurring, manual_entries, recurring_specs


def _write(d, name, text):
    p = d / name
    p.write_text(text)
    return str(p)


def _rows(res):
    return sorted((str(r.date), r.description, r.merchant, float(r.amount)) for r in res.rows.collect())


def test_tdvisa_no_header(spark, tmp_path):
    p = _write(tmp_path, "tdvisa_may.csv", "05/02/2025,Grocery Store,56.78,,1000\n05/03/2025,Restaurant A,12.34,,990\n"
                                         "05/04/2025,PAYMENT - THANK YOU,,500.00,490\nshort,line\n")
    res = S.load_tdvisa(S.read_grid(spark, p))
    assert _rows(res) == [("2025-05-02", "Grocery Store", "Grocery Store", 56.78),
                          ("2025-05-03", "Restaurant A", "Restaurant A", 12.34)]
    with_pay = S.load_tdvisa(S.read_grid(spark, p), include_payments=True)
    assert ("2025-05-04", "PAYMENT - THANK YOU", "PAYMENT - THANK YOU", -500.0) in _rows(with_pay)


def test_wealthsimple(spark, tmp_path):
    p = _write(tmp_path, "ws-05-2026.csv",
               "transaction_date,post_date,type,details,amount,currency\n"
               "2026-05-01,2026-05-02,Purchase,DAATA GRILL,15.81,CAD\n"
               "2026-05-03,2026-05-04,Refund settled,UBER CANADA,-22.14,CAD\n"
               "2026-05-05,2026-05-05,Payment,,-100,CAD\n,,Purchase,X,1,CAD\n")
    res = S.load_wealthsimple(S.read_grid(spark, p))
    assert _rows(res) == [("2026-05-01", "Purchase", "DAATA GRILL", 15.81),
                          ("2026-05-03", "Refund settled", "UBER CANADA", -22.14)]


def test_wealthsimple_filename(spark):
    df = spark.createDataFrame([("credit-card-statement-transactions-2026-05-01.csv",), ("WS-05-2026.csv",), ("x.csv",)], "n STRING")
    assert [r[0] for r in df.select(S.normalize_statement_name(F.col("n"))).collect()] == \
        ["ws-05-2026.csv", "ws-05-2026.csv", None]


def test_amex_grid_with_junk_rows(spark, tmp_path):
    p = _write(tmp_path, "amex.csv", "Statement,,\nPrepared for,someone,\nDate,Description,Amount,Merchant\n"
                                     "2026-06-26,Restaurant purchase,$12.34,Cafe\n2026-06-27,Coffee Shop,5.67,\n"
                                     "2026-06-28,No amount,,Shop\n2026-06-29,PAYMENT RECEIVED - THANK YOU,-50.00,\n")
    res = S.load_amex(S.read_grid(spark, p))
    assert _rows(res) == [("2026-06-26", "Restaurant purchase", "Cafe", 12.34),
                          ("2026-06-27", "Coffee Shop", "Coffee Shop", 5.67)]


def test_hometrust_parentheses_and_lost_minus(spark, tmp_path):
    head = ("Account Number,Cardholder Name,Trans Date,Posting Date,Type,Category,Merchant Name,Merchant City,"
            "Merchant State,Amount\n")
    p = _write(tmp_path, "hometrust.csv", head + '1,A,05/01/2025,05/02/2025,Debit,x,SHOP,T,ON,$1.23\n'
               '1,A,5/2/2025,05/02/2025,Credit,x,REFUND,T,ON,($45.67)\n'
               '1,A,05/03/2025,05/03/2025,Debit,x,MINUS,T,ON,-9.99\n'
               '1,A,05/04/2025,05/04/2025,Credit,x,PAYMENT,T,ON,($100.00)\n')
    res = S.load_hometrust(S.read_grid(spark, p))
    assert _rows(res) == [("2025-05-01", "SHOP", "SHOP", 1.23), ("2025-05-02", "REFUND", "REFUND", -45.67),
                          ("2025-05-03", "MINUS", "MINUS", 9.99)]


def test_canadiantire_preamble_and_quarantine(spark, tmp_path):
    p = _write(tmp_path, "canadiantire.csv", "Card summary\nName,Someone\n"
                                             "Transaction Date,Description,Amount\n"
                                             '05/01/2025,Gas,"$1,045.00"\n05/02/2025,PAYMENT,-20\n05/03/2025,Broken,\n')
    res = S.load_canadiantire(S.read_grid(spark, p))
    assert _rows(res) == [("2025-05-01", "Gas", "Gas", 1045.0)]
    assert [r.reason for r in res.quarantine.collect()] == ["unparsable amount"]
    with pytest.raises(Exception):
        S.load_canadiantire(S.read_grid(spark, p), strict=True).rows.collect()


def test_routing_and_unknown_files(spark, tmp_path):
    _write(tmp_path, "tdvisa_1.csv", "05/02/2025,Grocery Store,56.78,,1000\n")
    _write(tmp_path, "credit-card-statement-transactions-2026-05-01.csv",
           "transaction_date,post_date,type,details,amount,currency\n2026-05-01,2026-05-02,Purchase,GRILL,15.81,CAD\n")
    _write(tmp_path, "notes.txt", "hello\n")
    res = S.load_statements(spark, str(tmp_path))
    assert sorted(r.provider for r in res.rows.collect()) == ["tdvisa", "wealthsimple"]
    assert [r.file.rsplit("/", 1)[-1] for r in res.unknown_files.collect()] == ["notes.txt"]


def test_manual_entries(spark):
    good, bad = manual_entries(spark, [{"date": "2025-05-04", "description": "Farmers Market", "merchant": "CASH",
                                        "amount": 10}, {"description": "no date"}])
    r = good.first()
    assert (str(r.date), r.merchant, float(r.amount), r.provider) == ("2025-05-04", "CASH", 10.0, "manual")
    assert bad.count() == 1


@pytest.mark.parametrize("spec,as_of,expected", [
    ({"cadence": "daily", "start_date": "2025-01-01", "end_date": "2025-01-03"}, None,
     ["2025-01-01", "2025-01-02", "2025-01-03"]),
    ({"cadence": "weekly", "start_date": "2025-01-01", "count": 3}, "2025-12-31",
     ["2025-01-01", "2025-01-08", "2025-01-15"]),
    ({"cadence": "monthly", "start_date": "2025-01-31", "count": 3}, "2025-12-31",
     ["2025-01-31", "2025-02-28", "2025-03-31"]),
    ({"cadence": "daily", "start_date": "2025-01-01"}, "2025-01-05",
     ["2025-01-01", "2025-01-02", "2025-01-03", "2025-01-04", "2025-01-05"]),
    ({"cadence": "monthly", "start_date": "2025-01-30", "end_date": "2025-02-28"}, None, ["2025-01-30", "2025-02-28"]),
    ({"cadence": "weekly", "start_date": "2025-03-01", "end_date": "2025-02-01"}, None, []),
])
def test_recurring_expansion(spark, spec, as_of, expected):
    spec = dict({"description": "Rent", "merchant": "Landlord", "amount": 1500}, **spec)
    rows, bad = expand_recurring(recurring_specs(spark, [spec]), as_of or "2025-12-31")
    assert sorted(str(r.date) for r in rows.collect()) == expected
    assert bad.count() == 0


def test_recurring_bad_specs(spark):
    specs = [{"cadence": "yearly", "start_date": "2025-01-01"}, {"cadence": "daily", "start_date": "2025-01-01", "count": 0}]
    rows, bad = expand_recurring(recurring_specs(spark, specs), "2025-01-10")
    assert rows.count() == 0 and bad.count() == 2


def test_import_end_to_end(spark, tmp_path):
    _write(tmp_path, "tdvisa_may.csv", "05/02/2025,Grocery Store,56.78,,1000\n05/03/2025,Restaurant A,12.34,,990\n")
    manual = [{"date": "2025-05-04", "description": "Farmers Market", "merchant": "CASH", "amount": 10}]
    rules = [("groceries", ["grocery", "farmers"]), ("restaurants", ["restaurant"])]
    res = import_all(spark, str(tmp_path), manual=manual, rules=rules)
    got = sorted((float(r.amount), r.category) for r in res.ledger.collect())
    assert got == [(10.0, "groceries"), (12.34, "restaurants"), (56.78, "groceries")]


def test_import_dedupes_manual_against_recurring(spark):
    manual = [{"date": "2025-01-01", "description": "Rent", "merchant": "Landlord", "amount": 1500}]
    recurring = [{"description": "Rent", "merchant": "Landlord", "amount": 1500, "cadence": "monthly",
                  "start_date": "2025-01-01", "end_date": "2025-02-01"}]
    res = import_all(spark, manual=manual, recurring=recurring, as_of=dt.date(2025, 12, 31))
    rows = sorted((str(r.date), r.provider) for r in res.ledger.collect())
    assert rows == [("2025-01-01", "manual"), ("2025-02-01", "recurring")]
