"""Statements larger than a block, statements over part files, and the order of arrival."""

import datetime as dt

import pytest

from ledgerspark.sinks.ledger import read_ledger
from ledgerspark.sources import statements as S
from ledgerspark.streaming import jobs

AMEX = "Summary of account,,,\r\n\r\nDate,Description,Amount,Merchant\r\n"


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _amex(n, start=0):
    return "".join(f'2025-01-{1 + k % 28:02d},"Row {k}, ""q""",{k}.25,Shop {k}\r\n' + ("\r\n" if k % 7 == 0 else "")
                   for k in range(start, start + n))


def test_one_file_over_many_blocks(spark, tmp_path, small_blocks):
    (tmp_path / "amex.csv").write_bytes((AMEX + _amex(500)).encode())
    (tmp_path / "hometrust.csv").write_text("Trans Date,Merchant Name,Amount\n" + "05/01/2025,M,$1.00\n" * 400 + "bad,M,$2.00\n")
    (tmp_path / "tdvisa.csv").write_text("05/01/2025,M,1.5\n" * 300)
    assert S.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 12
    res = S.load_statements(spark, str(tmp_path))
    rows = res.rows.collect()
    amex = sorted((r for r in rows if r.provider == "amex"), key=lambda r: r.pos)
    assert [r.description for r in amex] == [f'Row {k}, "q"' for k in range(500)]
    lines = (AMEX + _amex(500)).split("\r\n")
    assert [r.pos for r in amex] == [k for k, line in enumerate(lines) if line and k > 2]
    assert sum(r.provider == "hometrust" for r in rows) == 400 and sum(r.provider == "tdvisa" for r in rows) == 300
    assert [(r.pos, r.reason) for r in res.quarantine.collect()] == [(401, "unparsable date")]


def test_header_behind_whole_blocks_of_other_lines(spark, tmp_path, small_blocks):
    junk = "some preamble that is long enough to fill blocks,x\n" * 200
    (tmp_path / "canadiantire.csv").write_text(junk + "Transaction Date,Description,Amount\n05/01/2025,Gas,1.00\n")
    (tmp_path / "ws-01-2025.csv").write_text("\n" * 5000 + "transaction_date,type,details,amount\n2025-01-01,Purchase,A,2\n")
    res = S.load_statements(spark, str(tmp_path))
    assert sorted((r.provider, float(r.amount), r.pos) for r in res.rows.collect()) == [
        ("canadiantire", 1.0, 201), ("wealthsimple", 2.0, 5001)]
    assert res.quarantine.count() == 0


def test_a_folder_of_part_files_is_one_statement(spark, tmp_path):
    d = tmp_path / "amex-2025"
    d.mkdir()
    (d / "part-00000-x.txt").write_bytes((AMEX + _amex(10)).encode())
    (d / "part-00001-x.txt").write_bytes(_amex(10, 10).encode())
    rows = S.load_statements(spark, str(d), route_on="path").rows.orderBy("pos").collect()
    assert [r.merchant for r in rows] == [f"Shop {k}" for k in range(20)] and len({r.pos for r in rows}) == 20
    # routed by file, the second part has no header
    assert {r.reason for r in S.load_statements(spark, str(d), route_on="files").quarantine.collect()} == {"no header"}


def test_header_faults_of_every_layout(spark, tmp_path):
    for name, text in {"amex": "2025-01-01,a,1,m\n", "canadiantire": "2025-01-01,a,1,m\n", "hometrust": "Trans Date,Amount\n05/01/2025,1\n",
                       "wealthsimple": "transaction_date,type,amount\n2025-01-01,a,1\n", "tdvisa": "x,y,z\na,b\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "other.csv").write_text("x\n")
    (tmp_path / "none.csv").write_text("")
    res = S.load_statements(spark, str(tmp_path))
    assert res.rows.count() == 0
    got = {(r.file.rsplit("/", 1)[-1], r.pos, r.reason) for r in res.quarantine.collect()}
    assert got == {("amex.csv", 0, "no header"), ("canadiantire.csv", 0, "no header"), ("hometrust.csv", 1, "missing column"),
                   ("wealthsimple.csv", 1, "missing column"), ("tdvisa.csv", 0, "unparsable date")}
    assert {r.file.rsplit("/", 1)[-1] for r in res.unknown_files.collect()} == {"other.csv"}  # empty files hold nothing to read


@pytest.mark.parametrize("max_files", [None, 1])
def test_shared_charge_takes_the_provider_of_the_first_file(spark, tmp_path, max_files):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a-hometrust.csv").write_text("Trans Date,Merchant Name,Amount\n05/01/2025,Cafe,$4.00\n")
    (src / "b-tdvisa.csv").write_text("05/01/2025,Cafe,4.00\n05/02/2025,Else,1.00\n")
    jobs.stream_statement_import(spark, str(src), str(tmp_path / "ledger"), str(tmp_path / "ck"), [("food", ["cafe"])],
                                 max_files=max_files)
    got = {(r.date, r.merchant): (r.provider, r.category) for r in read_ledger(spark, str(tmp_path / "ledger")).collect()}
    assert got[(dt.date(2025, 5, 1), "Cafe")][1] == "food" and len(got) == 2
    if max_files is None:  # in one micro-batch the name decides; over several, the batch
        assert got[(dt.date(2025, 5, 1), "Cafe")][0] == "hometrust"
