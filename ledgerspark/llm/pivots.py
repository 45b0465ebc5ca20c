"""Embedding near-dedup through a pivot-permutation index.

Reference points (pivots) are picked from a bounded sample, each as far as possible from those
before it. A vector is described by the order of its nearest pivots, and stands in the inverted
lists of every ``SHARED`` of its ``NEAREST`` nearest pivots; two vectors thus meet when they share
at least that many. Pairs in a list are verified by their cosine in double precision; a pair that
shares more pivots is counted only in the list of its smallest shared ones. Lists are cut into
blocks, so a task holds two blocks of a hot list at most. Equal vectors are one node.

Null, zero and non-finite vectors link with nothing; null ids and repeated rows are rows like
others (links to equal vectors count each); vectors of every length have pivots and lists of their
own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import connected_components, staged

PIVOTS, NEAREST, SHARED = 128, 7, 3
SAMPLE = 4096  # vectors from which the pivots are picked, by a hash of their id
BLOCK, CELLS_ROWS = 512, 16_000
MIN_COSINE = 0.95


def matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions and values of the usable vectors of a list column."""
    at, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            v = np.array(v, np.float64)
            if np.isfinite(v).all() and v.any():
                at.append(i)
                rows.append(v + 0.0)
    return np.array(at, np.int64), rows


def pick_pivots(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Farthest-first unit vectors of the most common length."""
    if not sample:
        return np.empty((0, 0))
    dim = pd.Series([len(v) for v in sample]).mode()[0]
    x = np.array([v for v in sample if len(v) == dim])
    x = np.unique(x / np.linalg.norm(x, axis=1)[:, None], axis=0)
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def sample_vectors(vectors: DataFrame, size: int = SAMPLE) -> list[np.ndarray]:
    total = vectors.count()
    share = min(1.0, size / max(total, 1))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(31)), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(size)
    return matrix(pa.array([r.embedding for r in rows.select("embedding").toLocalIterator()], pa.list_(pa.float64())))[1]


def _describe(pivots: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = matrix(b[1])
            vec, order = [None] * len(b), [None] * len(b)
            fit = [k for k, v in enumerate(rows) if len(pivots) and len(v) == pivots.shape[1]]
            if fit:
                x = np.array([rows[k] for k in fit])
                closeness = (x / np.linalg.norm(x, axis=1)[:, None]) @ pivots.T
                best = np.argsort(-closeness, axis=1, kind="stable")[:, :nearest].astype("<u2")
                for k, v, o in zip(fit, x, best, strict=True):
                    vec[at[k]], order[at[k]] = v.astype("<f8").tobytes(), o.tobytes()
            yield pa.RecordBatch.from_arrays([b[0].cast(pa.int64()), pa.array(vec, pa.binary()), pa.array(order, pa.binary())],
                                             ["vec_id", "vec", "nearest"])
    return run


def _lists(shared: int):
    """The keys of the lists of a vector: every ``shared`` of its pivots, in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            near = np.sort(np.array([np.frombuffer(x, "<u2") for x in b["nearest"].to_pylist()], np.int64), axis=1)
            use = min(shared, near.shape[1])
            keys = [sum(near[:, c] << (16 * k) for k, c in enumerate(cols)) for cols in combinations(range(near.shape[1]), use)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(b["node"].to_numpy(), len(keys)))],
                                             ["key", "node"])
    return run


def first_shared(a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """The key made of the smallest pivots that the rows of two sorted arrays share (-1: too few)."""
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    place = np.where(common, np.cumsum(common, axis=1) - 1, shared)
    key = (np.where(place < shared, a << (16 * np.minimum(place, 3)), 0)).sum(axis=1)
    return np.where(common.sum(axis=1) >= shared, key, -1)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that every one of ``n`` nodes reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(min_cosine: float, shared: int):
    """For whole cells of lists: links and the smallest linked node of every node in them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "left", "right", "node"], kind="stable")
        vec = np.array([np.frombuffer(v, "<f8") for v in pdf["vec"]])
        norm = np.linalg.norm(vec, axis=1)
        near = np.sort(np.array([np.frombuffer(x, "<u2") for x in pdf["nearest"]], np.int64), axis=1)
        key, mine = pdf["key"].to_numpy(), pdf["block"].to_numpy()
        cell = pdf[["key", "left", "right"]].to_numpy()
        opens = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        ends = np.r_[opens[1:], len(pdf)]
        until = np.repeat(ends, ends - opens)  # end of each row's cell
        apart = (pdf["left"] != pdf["right"]).to_numpy()
        later = until - np.arange(len(pdf)) - 1
        use = min(shared, near.shape[1])
        found_a, found_b = [], []
        steps = np.searchsorted(np.cumsum(later), np.arange(40_000, later.sum() + 40_000, 40_000))
        for lo, hi in zip(np.r_[0, steps + 1], np.r_[steps + 1, len(later)], strict=True):
            per = later[lo:hi]
            if not per.sum():
                continue
            a = np.repeat(np.arange(lo, min(hi, len(later))), per)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.r_[0, np.cumsum(per)[:-1]], per)
            ok = ~apart[a] | (mine[a] != mine[b])
            a, b = a[ok], b[ok]
            cosine = np.einsum("ij,ij->i", vec[a], vec[b]) / (norm[a] * norm[b])
            ok = cosine >= min_cosine
            a, b = a[ok], b[ok]
            ok = first_shared(near[a], near[b], use) == key[a]
            found_a.append(a[ok])
            found_b.append(b[ok])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b))
        nodes, number = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        size = pdf["size"].to_numpy()
        links = np.bincount(number[a], size[b], len(nodes)) + np.bincount(number[b], size[a], len(nodes))
        root = nodes[local_roots(number[a], number[b], len(nodes))]
        hit = links > 0
        return pd.DataFrame({"node": nodes[hit], "links": links[hit].astype(np.int64), "root": root[hit]})
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    min_cosine: float = MIN_COSINE, pivots: int = PIVOTS, nearest: int = NEAREST,
                    shared: int = SHARED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    length = F.size(F.coalesce("embedding", F.array().cast("array<double>")))
    counts = v.groupBy(length.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").collect()  # a row a length
    lengths = [r.n for r in counts if r.n] or [0]
    out = None
    for n in lengths:  # vectors of different lengths never link; empty ones go with the first
        mine = v if len(lengths) == 1 else v.where((length == n) | (length == 0) if n == lengths[0] else length == n)
        found = _of_one_length(mine, min_cosine, pivots, nearest, shared)
        out = found if out is None else out.unionByName(found)
    return out


def _of_one_length(v: DataFrame, min_cosine: float, pivots: int, nearest: int, shared: int) -> DataFrame:
    reference = pick_pivots(sample_vectors(v), pivots)
    rows = staged(v.mapInArrow(_describe(reference, nearest), "vec_id bigint, vec binary, nearest binary"), "piv-rows")
    usable = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    nodes = staged(usable.groupBy("vec", "nearest").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
                   .select("node", "size", "vec", "nearest"), "piv-nodes")
    lists = nodes.select("node", "nearest").mapInArrow(_lists(shared), "key bigint, node bigint")
    lists = staged(lists.repartition("key"), "piv-lists")
    busy = lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select(
        "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = lists.join(busy, "key").withColumn("block", own)
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    cells = staged(cells, "piv-cells")
    batches = max(1, -(-cells.count() // CELLS_ROWS))
    found = staged(
        cells.join(nodes, "node").withColumn("batch", F.pmod(F.xxhash64("key", "left", "right"), F.lit(batches)))
        .groupBy("batch").applyInPandas(_verify(min_cosine, shared), "node bigint, links bigint, root bigint"), "piv-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    whole = (nodes.select("node", "size", "vec").join(links, "node", "left").join(component, "node", "left")
             .select("vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
                     F.coalesce("component", "node").alias("component")))
    # equal vectors share their bytes, so rows find their node by a hash join on them
    return rows.join(whole, "vec", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == F.coalesce("component", "vec_id"))).alias("kept"))
