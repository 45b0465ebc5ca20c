"""Quality classifier: ordinal cumulative-link regression over hashed text.

Grades: 0 toxic, 1 junk (quality 0), 2 good. ``P(grade > k) = sigmoid(score - cut_k)``
with one set of hashed-text weights (two buckets a feature) and ordered cuts; the score gives the expected grade and the
tail probability ``P(grade = 2)`` that selection uses. Features of a whole text, each counted once:
its distinct words and word heads of four bytes, its distinct double-mark word endings, and the
shares of shouted words, marked endings, words without a letter and repeated words in tenths.

Training takes at most ``MAX_LABELLED`` labelled documents, chosen by a hash of their id (a
documented bound); scoring covers every row. Labels with a null grade are left out. Without any
label every document is kept. Null text is empty; repeated rows get equal scores; other columns
are carried by :func:`select_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerspark.llm.textbatch import Words, blocks, mixed

MAX_LABELLED = 20_000
BITS = 21
GRADES = 3
KEEP_TAIL = 0.5


def _kinds() -> np.ndarray:
    """Per byte: 1 lower-case ASCII letter, 2 upper-case, 4 digit, 8 mark, 16 part of other characters."""
    k = np.zeros(256, np.uint8)
    k[33:127] = 8
    k[48:58], k[65:91], k[97:123], k[128:] = 4, 2, 1, 16
    return k


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, bucket) of every feature, sorted by doc, each pair once."""
    w = Words(texts)
    size = np.uint64(1 << BITS)
    n_docs = len(texts)
    if not len(w.start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = _kinds()[w.cased]
    end = w.end  # without marks behind the word
    for _ in range(3):
        end = np.where((end - w.start > 1) & (kinds[end - 1] == 8), end - 1, end)
    h, head = w.hashes((w.start, end), (w.start, np.minimum(w.start + 4, end)))
    long = end - w.start > 4
    last, before = kinds[w.end - 1], kinds[np.maximum(w.end - 2, w.start)]
    count = lambda bit: np.diff(np.r_[0, np.cumsum((kinds & bit) > 0)][np.c_[w.start, w.end]], axis=1)[:, 0]
    upper, lower, other = count(2), count(1), count(16)
    shouted = (upper >= 3) & (lower == 0)
    marked = (last == 8) & (before == 8) & (w.end - w.start > 2)
    bare = (upper + lower + other) == 0
    again = np.ones(len(h))  # 1 where the word was in the text before
    again[np.unique(mixed(h + w.doc.astype(np.uint64)), return_index=True)[1]] = 0
    ending = mixed(w.raw[w.end - 1].astype(np.uint64) * np.uint64(256) + w.raw[np.maximum(w.end - 2, 0)] + np.uint64(7))
    docs, keys = [w.doc, w.doc[long], w.doc[marked]], [h, mixed(head[long]), ending[marked]]
    for k, flag in enumerate((shouted, marked, bare, again)):
        share = np.bincount(w.doc, flag, n_docs) / np.maximum(w.counts, 1)
        docs.append(np.arange(n_docs))
        keys.append(mixed((np.ceil(share * 10) + 100 * (k + 1)).astype(np.uint64)))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    # one sort: a document's number on top of 40 bits of the hash, from which both buckets come
    both = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    doc = (both >> np.uint64(40)).astype(np.int64)
    low = mixed(both & np.uint64((1 << 40) - 1))
    return (np.repeat(doc, 2),
            np.c_[low % size, (low >> np.uint64(32)) % size].astype(np.int64).ravel())


class OrdinalModel:
    """Shared weights and ordered cuts."""

    def __init__(self, grades: int = GRADES):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.cuts = np.linspace(-2.0, -1.0, grades - 1)

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[bucket], n)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every cut k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int = 10, batch: int = 32, rate: float = 1.0,
            sparse: float = 4.0, ridge: float = 0.02, seed: int = 11) -> OrdinalModel:
        """Maximum likelihood with an L1 and L2 penalty by proximal steps (follow the regularized
        leader, a rate per bucket). A weight is zero or lowers the grade: words without a steady
        effect add no noise, and a long text can't outweigh a toxic passage by ordinary words. The
        cuts hold the grades of a text without such words and are kept in order by their gaps."""
        rng = np.random.default_rng(seed)
        size = len(self.weights)
        power, pull = np.zeros(size, np.float32), np.zeros(size, np.float32)
        gaps = np.log(np.diff(self.cuts))
        share = np.bincount([g for _, g in rows], minlength=len(self.cuts) + 1) / len(rows)
        weight = np.minimum(4.0, np.sqrt(share.max() / np.maximum(share, 1e-9)))  # rare grades count more
        first, cut_power = self.cuts[0], np.full(len(self.cuts), 1.0)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                bucket = np.concatenate([rows[i][0] for i in at])
                doc = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
                y = np.array([rows[i][1] for i in at])
                t = np.c_[np.ones(len(at)), self.tails(self.scores(doc, bucket, len(at))), np.zeros(len(at))]
                each = np.arange(len(at))
                p = np.maximum(t[each, y] - t[each, y + 1], 1e-6)
                slope = t * (1 - t)
                up, down = weight[y] * slope[each, y] / p, weight[y] * slope[each, y + 1] / p
                hit, place = np.unique(bucket, return_inverse=True)
                g = np.bincount(place, (down - up)[doc], len(hit)).astype(np.float32)
                grown = np.sqrt(power[hit] + g * g)
                pull[hit] += g - (grown - np.sqrt(power[hit])) / rate * self.weights[hit]
                power[hit] += g * g
                z = pull[hit]
                self.weights[hit] = np.minimum(0, (sparse - z) / ((1 + grown) / rate + ridge))
                d_cut = np.zeros(len(self.cuts) + 2)
                np.add.at(d_cut, y, up)
                np.add.at(d_cut, y + 1, -down)
                d_cut = d_cut[1:-1]
                g_cut = np.r_[d_cut.sum(), [d_cut[k + 1:].sum() * np.exp(gaps[k]) for k in range(len(gaps))]]
                cut_power += g_cut * g_cut
                step = 0.3 * g_cut / np.sqrt(cut_power)
                first, gaps = first - step[0], gaps - step[1:]
                self.cuts = np.r_[first, first + np.cumsum(np.exp(gaps))]
        return self


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: one row per labelled document (the lowest grade of repeated labels)."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", grade.alias("grade"))
            .groupBy("doc_id").agg(F.min("grade").alias("grade")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED, **how) -> OrdinalModel | None:
    """Fit on at most ``max_labelled`` labelled documents; None without any."""
    g = graded(labels)
    total = g.count()
    if not total:
        return None
    share = min(1.0, max_labelled / total)
    picked = g.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(max_labelled)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")  # at most max_labelled rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in blocks(batches, 2):
            doc, bucket = features(texts)
            ends = np.searchsorted(doc, np.arange(1, len(texts)))
            yield pa.RecordBatch.from_arrays(
                [b[0], b[1], pa.array([x.astype("<i4").tobytes() for x in np.split(bucket, ends)], pa.binary())],
                ["doc_id", "grade", "buckets"])

    found = {}
    for r in chosen.mapInArrow(run, "doc_id bigint, grade int, buckets binary").toLocalIterator():
        found[(r.doc_id, bytes(r.buckets))] = r.grade
    rows = [(np.frombuffer(k[1], "<i4"), g) for k, g in sorted(found.items())]
    return OrdinalModel().fit(rows, **how) if rows else None


def score(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", keep_tail: float = KEEP_TAIL) -> DataFrame:
    """``docs`` with a struct column ``__grade(score, expected, tail, kept)``."""
    schema = "score double, expected double, tail double, kept boolean"
    if model is None:
        return docs.withColumn("__grade", F.struct(
            F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("expected"),
            F.lit(None).cast("double").alias("tail"), F.lit(True).alias("kept")))
    # 2 ** BITS weights, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    @pandas_udf(schema)
    def grade(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = OrdinalModel()
        m.weights, m.cuts = shared.value
        for part in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(part, pa.string(), from_pandas=True)], ["t"])
            out = []
            for _, texts in blocks([batch], 0):
                s = m.scores(*features(texts), len(texts))
                t = m.tails(s)
                out.append(np.c_[s, t.sum(axis=1), t[:, -1]])
            x = np.concatenate(out) if out else np.empty((0, 3))
            yield pd.DataFrame({"score": x[:, 0], "expected": x[:, 1], "tail": x[:, 2], "kept": x[:, 2] >= keep_tail})

    return docs.withColumn("__grade", grade(F.col(text_col)))


def select_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose tail probability passes, all columns."""
    kept = score(docs, train(docs, labels, **how))
    return kept.where("__grade.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
