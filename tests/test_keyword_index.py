"""F1 by the keyword index gives what the CASE gives."""

import random

from ledgerspark.operators import categorize as C


def test_index_equals_case(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcAB #.é") for _ in range(rnd.randint(0, 9)))
    rows = [(word(), word()) for _ in range(400)] + [(None, "abc"), ("cab", None), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "merchant string, description string")
    for _ in range(3):
        rules = [(f"c{k}", [w for w in (word() for _ in range(rnd.randint(0, 12))) if w]) for k in range(8)]
        if rnd.random() < 0.5:
            rules.insert(5, ("all", ["", "zz"]))
        want = C.categorize(df, rules).collect()
        got = C.categorize_by_index(df, rules).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)
    assert C.categorize_by_index(df, [("none", [])]).where("category <> 'misc'").count() == 0
    again = C.categorize_by_index(C.categorize(df, rules), rules)
    assert again.columns == ["merchant", "description", "category"] and again.count() == len(rows)


def test_many_keywords_take_the_index(spark):
    df = spark.createDataFrame([("Shop 1999", "x"), ("other", "y")], "merchant string, description string")
    rules = [("shop", [f"shop {k}" for k in range(C.INDEX_FROM + 1)])]
    out = C.categorize(df, rules)
    assert {r.merchant: r.category for r in out.collect()} == {"Shop 1999": "shop", "other": "misc"}
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
