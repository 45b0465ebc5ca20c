"""BPE by automaton and the alignment of two tokenizers, against the tokenizers' own libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    from ledgerspark.llm.bpe_automaton import Vocabulary

    return Vocabulary(WORD)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


# ---- 11 tokenization automaton --------------------------------------------------------------
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aeinst", "ab", "a", "0123456789", "!?.,-'\"#$%&", "éüñßøæ", "абвгд", "中文字漢",
             "😀🎉👍", "̧́e ", "İΣσςΑ", "ᾳﬁ՘Ᲊ𐥀", " \t\n\x1c\x85 ", "<|endoftext|>", "'s't're've"]


def test_automaton_spells_words_as_the_library(vocabulary, library):
    from ledgerspark.llm.bpe_automaton import Encoder

    rnd, encoder = random.Random(11), Encoder(vocabulary)
    for _ in range(4000):
        letters = "".join(rnd.sample(ALPHABETS, rnd.choice([1, 1, 2, 3])))
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40)))
        if rnd.random() < 0.1:
            text += "<|endoftext|>" + text[::-1] + "<|startoftext|>"
        assert np.frombuffer(encoder.ids(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_merge_gadgets_on_a_small_automaton():
    """Repeated symbols, and every word of two letters up to length 8, against plain BPE."""
    from itertools import product

    from ledgerspark.llm.bpe_automaton import Automaton

    rules = [("a", "a"), ("a", "b|"), ("aa", "aa"), ("b", "aa"), ("aa", "b"), ("aaaa", "ab|"), ("baa", "b")]
    labels = ["a", "b", "a|", "b|"] + [x + y for x, y in rules]
    at = {t: i for i, t in enumerate(labels)}
    automaton = Automaton(labels, [(at[x], at[y], at[x + y]) for x, y in rules], "|")
    for n in range(1, 9):
        for letters in product("ab", repeat=n):
            parts = [*letters[:-1], letters[-1] + "|"]
            for x, y in rules:
                out = []
                for p in parts:
                    if out and out[-1] == x and p == y:
                        out[-1] = x + y
                    else:
                        out.append(p)
                parts = out
            assert [labels[i] for i in automaton.spell("".join(letters))] == parts


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 60_000, " " * 3_000_000 + "x", "\n" * 1_000_000, "!" * 100_000,
                                  "a b\x1c! " * 300_000 + "end", "é" * 50_000], ids=lambda t: f"{t[:2]!r}-{len(t)}")
def test_automaton_on_very_long_texts(vocabulary, library, text):
    from ledgerspark.llm.bpe_automaton import Encoder

    assert np.frombuffer(Encoder(vocabulary).ids(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_op11_on_the_documents(spark, library):
    from ledgerspark.llm.queries import op11_bpe_automaton

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op11_bpe_automaton(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_odd_rows(spark, vocabulary, library):
    from ledgerspark.llm.bpe_automaton import decode, encode

    texts = [(1, "Hello, World!"), (1, "Hello, World!"), (2, None), (3, ""), (None, "x"), (4, " \n"), (5, "w " * 50_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = decode(encode(docs, vocabulary), vocabulary).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (i for i, _ in texts)))
    for r in rows:
        want = library.encode(next(t for i, t in texts if i == r.doc_id) or "", add_special_tokens=False).ids
        assert r.ids == want and r.text == library.decode(want, skip_special_tokens=False)
    assert encode(docs.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([(1, [320, None, 99_999, 49_407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in decode(odd, vocabulary).orderBy("doc_id").collect()] == ["a</w> <|endoftext|>", None, ""]


# ---- 13 alignment ---------------------------------------------------------------------------
def brute_alignment(rows):
    """Rows of (doc_id, text) -> per row its digest, by plain loops over tokens."""
    import sentencepiece
    from collections import Counter

    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}
    a_bytes = lambda i: bytes(byte[c] for c in a_tok.id_to_token(i))

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    count, found = Counter(), []
    for doc, text in rows:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        if not text or not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + text).encode():
            found.append((doc, 0, 0, 0, [], ""))
            continue
        links, groups, i, j, at_a, at_b, ga, gb = [], [], 0, 0, len(a_bytes(a[0])), len(b_bytes(b[0])), [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            if at_a == at_b:
                groups.append((ga, gb))
                if i + 1 == len(a):
                    break
                i, j = i + 1, j + 1
                at_a, at_b, ga, gb = at_a + len(a_bytes(a[i])), at_b + len(b_bytes(b[j])), [a[i]], [b[j]]
            elif at_a < at_b:
                i += 1
                at_a += len(a_bytes(a[i]))
                ga.append(a[i])
            else:
                j += 1
                at_b += len(b_bytes(b[j]))
                gb.append(b[j])
        count.update(links)
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((doc, len(a), len(b), len(groups), links, text))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, ls, g in found], count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op13_on_the_documents(spark):
    from ledgerspark.llm.queries import op13_pair_bitmaps

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in op13_pair_bitmaps(spark, SMALL).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(brute_alignment(docs)[0])


def test_alignment_odd_rows_blocks_and_planes(spark, monkeypatch):
    """Small blocks, so that pairs meet in several; hot pairs, so that bit sets and planes are used."""
    from ledgerspark.llm import alignment

    monkeypatch.setattr(alignment, "BLOCK_DOCS", 400)
    monkeypatch.setattr(alignment, "STEP_BYTES", 3000)
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "no id"), (4, "lit \u2581 piece"), (5, "<s> </s> <|endoftext|>"),
            (6, "é中😀\x00 x\t\n"), (7, " " * 20_000 + "z"), (8, "the " * 5000), (9, " "), (10, "\u0301a")]
    rows += [(100 + k, "the cat sat on the mat " * rnd.choice([1, 1, 2, 3, 9]) + "".join(rnd.choices("ab é?1", k=9))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).coalesce(2)
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(docs, *paths)
    counts = alignment.pair_counts(aligned.postings)
    out = alignment.scores(aligned, counts).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    want, links = brute_alignment(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): r.links for r in counts.collect()} == dict(links)
    kinds = {(r.plane, r.dense) for r in aligned.postings.select("plane", "dense").distinct().collect()}
    assert {(0, True), (0, False), (1, False), (2, True)} <= kinds and aligned.postings.select("block").distinct().count() > 3
    the = counts.orderBy(F.desc("documents")).first()
    assert the.documents <= len(rows) and the.documents > 1000
    empty = alignment.align(docs.limit(0), *paths)
    assert alignment.scores(empty, alignment.pair_counts(empty.postings)).count() == 0
