"""``corpus_pipeline.run`` against a plain-Python pipeline; the classifier's scores are taken as given."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import brute_components, check_packed

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def poisson_counts(docs):
    """Copies of (doc_id, source) pairs by the inverted distribution at an md5 of the seed, id and draw."""
    n = Counter(s for _, s in docs)
    whole, rates = sum(math.sqrt(c) for c in n.values()), {}
    for s, c in n.items():
        rate = len(docs) * math.sqrt(c) / whole / c
        draws = max(1, math.ceil(rate / 16))
        mean, term, cdf = rate / draws, math.exp(-rate / draws), [math.exp(-rate / draws)]
        for k in range(1, math.ceil(mean + 12 * math.sqrt(mean) + 30) + 1):
            term *= mean / k
            cdf.append(cdf[-1] + term)
        rates[s] = (draws, cdf)
    out = Counter()
    for doc, s in docs:
        draws, cdf = rates[s]
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"42|{doc}|{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
            out[doc] += sum(c <= u for c in cdf)
    return out


def plain_pipeline(rows, kept, capacity=1024):
    """rows: (doc_id, text, source); kept: ids that the classifier keeps -> pieces with their counts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [r for r in rows if r[0] in kept]
    last = {}
    for doc, text, _ in rows:
        key = (text or "").translate(LOWER)
        last[key] = max(doc, last.get(key, doc))
    rows = [r for r in rows if r[0] in set(last.values())]
    component = brute_components([(d, t) for d, t, _ in rows])
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    copies = poisson_counts([(d, s) for d, _, s in rows])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for doc, text, _ in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            pieces[(doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += copies[doc]
    return +pieces


def test_run_equals_a_plain_pipeline(spark):
    import corpus_pipeline
    from ledgerspark.llm import quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(docs, model).where(F.col("__grade.kept")).select("doc_id").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert 0 < len(kept) < len(rows)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    check_packed(packed, 1024)
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    assert got == plain_pipeline(rows, kept)


def test_stages_take_odd_rows_and_clashing_columns(spark):
    """Null ids, texts and sources, empty and repeated rows, copies, a very long text, other columns: every
    stage gives the columns of documents (the last, pieces), and an empty table gives an empty one."""
    import corpus_pipeline

    long = " ".join(f"word{k % 997}" for k in range(40_000)) + " " * 6000
    odd = [(1, "Same text here, one two three", "en", "a", 29), (2, "SAME text here, one two three", None, "a", None),
           (2, "SAME text here, one two three", None, "a", None), (3, None, "en", None, None), (4, "", "en", "b", 0),
           (None, "lost id", "en", "a", 7), (5, long, "en", "b", len(long)), (6, "x", None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = plain.unionByName(spark.createDataFrame([(None if i is None else 10_000_000 + i, *r) for i, *r in odd], schema))
    clash = docs.withColumn("row", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("copy", F.lit(2)).withColumn("length", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, clash, SMALL), stage(spark, clash.limit(0), SMALL)
        assert none.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert some.columns == docs.columns and some.count() > 0, name
    exact = corpus_pipeline.STAGES[1][1](spark, clash, SMALL).collect()
    assert 10_000_002 in {r.doc_id for r in exact} and 10_000_001 not in {r.doc_id for r in exact}
    near = corpus_pipeline.STAGES[2][1](spark, clash, SMALL).collect()
    assert {10_000_003, 10_000_004, 10_000_005} <= {r.doc_id for r in near}
    check_packed(corpus_pipeline.STAGES[4][1](spark, clash, SMALL).collect(), 1024)
