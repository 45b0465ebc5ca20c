"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

``token_pieces`` tokenizes whole texts (byte-level BPE, added tokens inside texts included, plus an
end id) and cuts documents longer
than the capacity; all pieces but the first are full. Full pieces are sequences by themselves. The
others are dealt at random to provinces of about ``PROVINCE`` pieces. Every province is packed by
``ISLANDS`` islands that hold the same pieces but different populations. A chromosome is a
grouping; crossover injects whole well-filled bins of one parent into the other, takes out the
bins that now hold duplicates, and best-fits the displaced pieces. After every epoch each island
sends its elite to the next one through a shuffle. The best grouping of a province wins. Bins that
stay poorly filled are dissolved and their pieces are dealt to new provinces for a last round, so
that a province doesn't cost a half-empty bin.

Only piece ids and lengths travel; provinces are bounded and even whatever the sources, hence no key is hot.
Null text is empty (a piece with the end id alone); null ids and repeated rows are packed like
any other row, each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import staged

CAPACITY, END_ID = 1024, 2
PROVINCE, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 4000, 2, 2, 4, 5, 2
POOR = 0.97  # bins filled less are dissolved after the first round
LEVEL_BIT = 60
LONG_RUN = 5000  # characters of white space
_LONG_RUN = re.compile(r"\s{%d}" % LONG_RUN)
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_POPULATION = "province bigint, island int, rank int, bins int, waste double, genes binary"


def load_encoder(path: str | None = None):
    """Text -> ids of the byte-level BPE vocabulary given as ranks, with the added tokens of the
    ``tokenizers`` file beside it (if there is one), whose ids these are. Very long runs of white space
    exceed the pattern engine's stack, so texts with one are encoded by that file."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {}
    if os.path.exists(whole := os.path.splitext(path)[0] + ".json"):
        with open(whole, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    exact = []

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN or not _LONG_RUN.search(text) or not os.path.exists(whole):
            return fast.encode(text, allowed_special="all")
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(whole))
        return exact[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` for every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path)
        for b in batches:
            out = ([], [], [], [], [], [])
            for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start:start + n].tobytes()
                    for column, value in zip(out, (doc, k, start, n, zlib.crc32(raw), raw), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:5 + with_ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=False)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        run, _PIECES + ", ids binary" * with_ids)


def best_fit(order, lengths, rooms: dict[int, int], assign, capacity: int) -> None:
    """Put the pieces of ``order`` into the fullest open bin that takes them, else into a new one.
    ``rooms``: room of each open bin by its number; ``assign`` gets the bins of the pieces."""
    by_room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has room r
    for b, r in rooms.items():
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    fresh = max(rooms, default=-1) + 1
    for i in order:
        need = lengths[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                mask ^= 1 << room
        else:
            room, b, fresh = capacity, fresh, fresh + 1
        assign[i] = b
        left = room - need
        by_room.setdefault(left, []).append(b)
        mask |= 1 << left


class Island:
    """A population of groupings of the same pieces."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed):
        self.lengths, self.capacity = lengths, capacity
        self.plain = lengths.tolist()
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(lengths.sum()) // capacity)

    def score(self, genes: np.ndarray) -> tuple[int, float]:
        """Bins, then how evenly they are filled (full bins beside empty ones are better)."""
        fill = np.bincount(genes, self.lengths)
        return int(np.count_nonzero(fill)), float(-np.square(fill / self.capacity).sum())

    def built(self, noise: float) -> np.ndarray:
        keys = -self.lengths + self.rng.uniform(0, noise * self.capacity + 1e-9, len(self.lengths))
        genes = [0] * len(self.plain)
        best_fit(np.argsort(keys, kind="stable").tolist(), self.plain, {}, genes, self.capacity)
        return np.array(genes, np.int32)

    def _refit(self, genes: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        """Best-fit the displaced pieces into the bins that the others leave."""
        genes = np.unique(np.where(displaced, -1, genes), return_inverse=True)[1].astype(np.int32)
        if displaced.any():
            genes -= 1
        stay = ~displaced
        fill = np.bincount(genes[stay], self.lengths[stay]).astype(np.int64)
        rooms = {b: self.capacity - f for b, f in enumerate(fill.tolist())}
        order = np.flatnonzero(displaced)
        order = order[np.argsort(-self.lengths[order], kind="stable")]
        out = genes.tolist()
        best_fit(order.tolist(), self.plain, rooms, out, self.capacity)
        return np.array(out, np.int32)

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` with some whole well-filled bins of ``b``; duplicates' bins go, their rest is re-fitted."""
        fill = np.bincount(b, self.lengths)
        good = np.flatnonzero(fill >= 0.99 * self.capacity)
        if not len(good):
            good = np.argsort(-fill)[:max(1, len(fill) // 10)]
        taken = np.zeros(len(fill), bool)
        taken[self.rng.choice(good, max(1, len(good) // 10), replace=False)] = True
        injected = taken[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[injected]] = True
        child = np.where(injected, b + len(hit), a)
        return self._refit(child, hit[a] & ~injected)

    def mutate(self, a: np.ndarray) -> np.ndarray:
        """Dissolve the emptiest bins and a few others."""
        fill = np.bincount(a, self.lengths)
        gone = np.zeros(len(fill), bool)
        gone[np.argsort(fill)[:max(2, len(fill) // 50)]] = True
        gone[self.rng.choice(len(fill), max(1, len(fill) // 50))] = True
        return self._refit(a, gone[a])

    def evolve(self, members: list[np.ndarray], generations: int, population: int) -> list[tuple]:
        """Groupings with their scores, best first. Ends early at the least possible number of bins."""
        scored = [(self.score(g), g) for g in members]
        for k in range(population - len(scored)):
            genes = self.built(0.0 if not members and not k else self.rng.uniform(0.01, 0.2))
            scored.append((self.score(genes), genes))
            if scored[-1][0][0] <= self.least:
                break
        for _ in range(generations):
            scored.sort(key=lambda x: x[0])
            if scored[0][0][0] <= self.least:
                break
            young = []
            for _ in range(population):
                i, j = (min(self.rng.integers(len(scored), size=2)) for _ in range(2))
                child = self.mutate(self.cross(scored[i][1], scored[j][1]))
                young.append((self.score(child), child))
            scored = sorted(scored + young, key=lambda x: x[0])[:population]
        return sorted(scored, key=lambda x: x[0])


def _epoch(capacity: int, seed: int, epoch: int):
    def run(key, items: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame([], columns=["province", "island", "rank", "bins", "waste", "genes"])
        province, island = int(key[0]), int(key[1])
        lengths = items.sort_values("item")["length"].to_numpy(np.int64)
        home = Island(lengths, capacity, [seed, epoch, province, island])
        found = home.evolve([np.frombuffer(g, "<i4") for g in members["genes"]], GENERATIONS, POPULATION)[:ELITE]
        return pd.DataFrame([(province, island, rank, s[0], s[1], g.astype("<i4").tobytes())
                             for rank, (s, g) in enumerate(found)],
                            columns=["province", "island", "rank", "bins", "waste", "genes"])
    return run


def _seat(capacity: int, level: int):
    """The pieces of a province with the bin, place and fill that the winning grouping gives them."""
    def run(key, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item").drop(columns=["island"], errors="ignore")
        genes = np.frombuffer(best["genes"].iloc[0], "<i4") if len(best) else np.arange(len(items))
        lengths = items["length"].to_numpy(np.int64)
        order = np.argsort(genes, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        opens = np.r_[True, genes[order][1:] != genes[order][:-1]]
        offset = np.empty(len(items), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(opens, starts, 0))
        items["sequence_id"] = (level << LEVEL_BIT) + (int(key[0]) << 20) + genes.astype(np.int64)
        items["offset"] = offset
        items["fill"] = np.bincount(genes, lengths)[genes].astype(np.int64)
        return items
    return run


def _pack_round(items: DataFrame, capacity: int, seed: int, level: int) -> DataFrame:
    """``items`` with sequence_id, offset and fill, written."""
    spark = items.sparkSession
    provinces = max(1, -(-items.count() // PROVINCE))
    dealt = staged(items.withColumn("province", F.pmod(F.xxhash64("item", F.lit(seed + level)), F.lit(provinces))),
                   "pack-provinces")
    small = dealt.select("province", "item", "length").withColumn(
        "island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    members = spark.createDataFrame([], _POPULATION)
    for epoch in range(EPOCHS):
        members = staged(
            small.groupBy("province", "island").cogroup(members.groupBy("province", "island"))
            .applyInPandas(_epoch(capacity, seed, epoch), _POPULATION), "pack-epoch")
        if epoch + 1 < EPOCHS:  # the elite stays, and a copy goes to the next island
            guests = members.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
            members = members.union(guests) if ISLANDS > 1 else members
    best = members.groupBy("province").agg(
        F.min(F.struct("bins", "waste", "island", "rank", "genes")).alias("b")).select("province", "b.genes")
    schema = f"{', '.join(f'`{n}` {t}' for n, t in dealt.dtypes)}, sequence_id bigint, offset bigint, fill bigint"
    return staged(dealt.groupBy("province").cogroup(best.groupBy("province"))
                  .applyInPandas(_seat(capacity, level), schema).drop("province"), "pack-seats")


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """``pieces`` (any columns, with ``length`` between 1 and the capacity) plus ``sequence_id``
    and ``offset``, its gapless place in that sequence."""
    cols = pieces.columns
    items = staged(pieces.withColumn("item", F.monotonically_increasing_id()), "pack-items")
    full = items.where(F.col("length") >= capacity).select(
        *cols, F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    first = _pack_round(items.where(F.col("length") < capacity).select("item", "length"), capacity, seed, 1)
    done = first.where(F.col("fill") >= POOR * capacity)
    again = _pack_round(first.where(F.col("fill") < POOR * capacity).select("item", "length"), capacity, seed, 2)
    seats = done.union(again).select(F.col("item").alias("__item"), "sequence_id", "offset")
    partly = items.where(F.col("length") < capacity)
    return full.union(partly.join(seats, partly["item"] == seats["__item"]).select(*cols, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **how) -> DataFrame:
    """Tokenize, cut and pack: one row per piece, with its ids as little-endian uint32 if asked for."""
    return pack(token_pieces(docs, capacity, with_ids=with_ids, **how), capacity)
