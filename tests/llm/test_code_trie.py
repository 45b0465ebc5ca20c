"""Codes of learned entries along a trie, against plain loops."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F


def brute(rows, length, entries=256, rounds=4, parts=4):
    """rows: kept (id, label, vector) of one length, by id -> (codes and errors, codebooks)."""
    width = -(-length // parts)
    ints = [[math.floor(1024 * float(x)) for x in v] + [0] * (width * parts - length) for _, _, v in rows]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(c[p], w)), e) for e, w in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got) if g[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    return [([e for _, e in g], sum(d for d, _ in g)) for g in assign()], books


def test_nearest_along_the_trie_with_shared_prefixes():
    from ledgerspark.llm import code_trie

    rng = np.random.default_rng(0)
    for spread, width, n in ((2, 4, 3000), (1000, 16, 700), (3, 9, 5000), (1 << 40, 3, 200), (2, 1, 50)):
        rows = np.unique(rng.integers(-spread, spread, (n, width)), axis=0)
        book = rng.integers(-spread, spread, (37, width))
        best, error = code_trie.nearest(rows, book)
        d = ((rows.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(2)
        assert best.tolist() == [row.index(min(row)) for row in d.tolist()]
        assert [int(x) for x in error] == d.min(axis=1).tolist()


def test_compress_equals_plain_loops(spark):
    from ledgerspark.llm.code_trie import compress, restored

    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-6, 6, 8) / 1024]) for i in range(120)]
    rows += [(200 + i, 9, [0.25] * 8) for i in range(60)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    out = compress(df, entries=16)
    want, books = brute(rows, 8, entries=16)
    got = {r.id: (r.code, r.error) for r in out.codes.select(F.col("row.vec_id").alias("id"), "code", "error").collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)}
    assert out.codebooks[8].tolist() == books
    back = out.codes.select("row.vec_id", "code", restored(F.col("code"), F.size("numbers"), out.codebooks).alias("v")).collect()
    assert all(list(r.v) == [x / 1024 for p, e in enumerate(r.code) for x in books[p][e]] for r in back)


def test_op12_odd_rows(spark, tmp_path):
    from ledgerspark.llm.queries import op12_code_trie

    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    plain = [(i, None if i % 5 == 0 else i % 2, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    odd = [(1000, 1, None), (1001, 1, [nan] + [0.0] * 7), (1002, 1, [0.0] * 7 + [inf]), (1003, 1, [None] + [0.0] * 7)]
    more = [(2000 + k, 5, [float(k), -1.5, 0.125 * k, 2.0, 3.0]) for k in range(4)] + [(3000, 6, []), (3001, 6, [])]
    twice = [(7, 1, plain[7][2]), (None, 1, plain[3][2]), (4000, 8, [3e38] * 6), (4001, 8, [-3e38] * 6)]
    rows = plain + odd + more + twice
    schema = "vec_id long, label int, embedding array<float>, code string, numbers string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_code_trie(spark, str(tmp_path)).collect()
    assert len(got) == len(plain) + len(more) + len(twice)
    by = {r.vec_id: r for r in got}
    for length, some in ((8, sorted(plain + twice[:2], key=lambda r: (r[0] is None, r[0]))), (5, more[:4])):
        want, books = brute(some, length)
        flat = ",".join(str(x) for b in books for w in b for x in w)
        for r, (code, error) in zip(some, want):
            assert by[r[0]].code == "".join(f"{c:02x}" for c in code) and by[r[0]].error == error
            assert by[r[0]].codebooks_sha256 == hashlib.sha256(flat.encode()).hexdigest()
    assert by[3000].code == "00000000" and by[3000].error == 0
    assert by[4000].error == 0 and by[4001].error == 0
    for label in (None, 0, 1, 5):
        assert {r.label_error for r in got if r.vec_id in {x[0] for x in rows if x[1] == label}} == {
            sum(r.error for r in got if (r.vec_id, label) in {(x[0], x[1]) for x in rows})}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert op12_code_trie(spark, str(tmp_path / "none")).count() == 0
