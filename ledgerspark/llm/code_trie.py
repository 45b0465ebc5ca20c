"""Compression of vectors to codes of learned entries, assigned along a trie of their parts.

A vector's components become integers ``floor(1024 * x)`` and are cut into equal consecutive parts. Every
part position has a codebook, first the parts of the vectors with the smallest ids. In every round
each part goes to its nearest entry (squared distance, ties to the lower index), and entries move to
the componentwise floor of the mean of their parts; an unused entry stays.

Rounds work on distinct parts with their number (a grouped table), sorted by range, so that a task
holds parts with common prefixes. There they form a lexicographic trie over the components. ``nearest``
goes through it depth first with the vector of all entries' distances over the prefix so far, which
the parts below share; a leaf takes the smallest of them, and adds its components, weighted by its
number, to the entry's sums. Only these sums are shuffled, and only codebooks (entries x length
numbers) reach the driver.

Null vectors and vectors with null or non-finite components are left out. Vectors of different
lengths have codebooks of their own; a length that the parts don't divide is filled up with zeros.
With fewer vectors than entries, each is an entry. Equal ids are ordered by their components, null
ids come last; every row is coded. Integers and errors end at the bounds of a long. An empty table
gives an empty result, and other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
PARTS_A_TASK = 1 << 16  # distinct parts
LEVELS = 512  # leaves of a subtree whose nodes are gone through by levels at once
_TOP = (1 << 63) - 1


def _wide(bound: int) -> type:
    """The type that holds integers up to a bound: 64 bits, or Python's own."""
    return np.int64 if bound < 1 << 62 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of every part, and its squared distance. ``parts``: sorted
    lexicographically, all different, as many columns as ``entries``."""
    n, width = parts.shape
    top = max((int(abs(int(x))) for a in (parts, entries) if a.size for x in (a.min(), a.max())), default=0)
    kind = _wide(max(width, 1) * (2 * top) ** 2)
    parts, columns = parts.astype(kind), np.ascontiguousarray(entries.T).astype(kind)
    best, error = np.zeros(n, np.int64), np.zeros(n, kind)
    shared = np.zeros(n, np.int64)  # components that a part has in common with the one before
    if n > 1:
        shared[1:] = np.argmax(parts[1:] != parts[:-1], axis=1)
    subtrees = [(0, n, 0, np.zeros(len(entries), kind))]
    while subtrees:
        low, high, depth, so_far = subtrees.pop()
        if high - low > LEVELS:
            fork = int(shared[low + 1:high].min())
            for d in range(depth, fork):
                so_far = so_far + (parts[low, d] - columns[d]) ** 2
            starts = np.r_[low, low + 1 + np.flatnonzero(shared[low + 1:high] == fork), high].tolist()
            subtrees += [(s, e, fork, so_far) for s, e in zip(starts[-2::-1], starts[:0:-1], strict=True)]
            continue
        distances, node = so_far[None, :], np.zeros(high - low, np.int64)  # one row a node of the level
        for d in range(depth, width):
            opens = np.r_[True, shared[low + 1:high] <= d]
            first = np.flatnonzero(opens)
            distances = distances[node[first]] + (parts[low + first, d][:, None] - columns[d][None, :]) ** 2
            node = np.cumsum(opens) - 1
        distances = distances[node]
        best[low:high] = np.argmin(distances, axis=1)
        error[low:high] = distances[np.arange(high - low), best[low:high]]
    return best, error


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows, and each row's place among them."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    opens = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(opens) - 1
    return rows[opens], place


@dataclass
class Compressed:
    """``codes``: the kept rows (``row``), their integers, ``code`` (an entry of every part) and ``error``;
    ``codebooks``: vector length -> integers by (part, entry, component)."""

    codes: DataFrame
    codebooks: dict[int, np.ndarray]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """The vector's integers; null where the vector is null or has a null or non-finite component."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))


def _first_entries(kept: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    rows = (kept.where(F.size("numbers") == length).orderBy(F.asc_nulls_last("id"), "numbers").limit(entries)
            .select("numbers").collect())  # at most `entries` vectors
    width = -(-length // parts)
    book = np.zeros((len(rows), parts * width), np.int64)
    for k, r in enumerate(rows):
        book[k, :length] = r.numbers
    return book.reshape(len(rows), parts, width).transpose(1, 0, 2)


def _round(distinct: DataFrame, codebooks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Assign, add up and move the entries once."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for b in batches:
            length, at = b["length"].to_numpy(), b["at"].to_numpy()
            weight = b["n"].to_numpy()
            for key in set(zip(length.tolist(), at.tolist(), strict=True)):
                book = codebooks[key[0]][key[1]]
                pick = np.flatnonzero((length == key[0]) & (at == key[1]))
                rows = _matrix(b["part"].take(pa.array(pick)), book.shape[1])
                rows, place = _distinct(rows)
                count = np.zeros(len(rows), np.int64)
                np.add.at(count, place, weight[pick])
                best, _ = nearest(rows, book)
                top = max(abs(int(rows.min())), abs(int(rows.max()))) if rows.size else 0
                kind = _wide(top * int(count.sum()))
                total = np.zeros(book.shape, kind)
                np.add.at(total, best, rows.astype(kind) * count[:, None].astype(kind))
                used = np.bincount(best, count, len(book))
                for e in np.flatnonzero(used).tolist():
                    got = sums.setdefault((*key, e), [0, [0] * book.shape[1]])
                    got[0] += int(count[best == e].sum())
                    got[1] = [x + int(y) for x, y in zip(got[1], total[e], strict=True)]
        rows = [(*key, n, j, str(s)) for key, (n, by) in sums.items() for j, s in enumerate(by)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6,
                                            (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)],
            ["length", "at", "entry", "n", "j", "total"])

    moved = {k: v.copy() for k, v in codebooks.items()}
    found = (distinct.mapInArrow(add_up, "length int, at int, entry int, n long, j int, total string")
             .groupBy("length", "at", "entry", "j")
             .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    for r in found.collect():  # at most the codebooks' size
        moved[r.length][r.at, r.entry, r.j] = int(r.total) // r.n
    return moved


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Learn codebooks from all kept rows of ``vectors`` and code them."""
    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns])
    kept = staged(vectors.select(row.alias("row"), F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("numbers"))
                  .where("numbers is not null"), "trie-vectors")
    lengths = [r.n for r in kept.select(F.size("numbers").alias("n")).distinct().collect()]  # one number a length
    codebooks = {n: _first_entries(kept, n, parts, entries) for n in lengths}

    length, width = F.size("numbers"), F.ceil(F.size("numbers") / parts).cast("int")
    filled = F.concat("numbers", F.array_repeat(F.lit(0).cast("bigint"), width * parts - length))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(filled, p * width + 1, width))
    counted = (kept.select(length.alias("length"), F.posexplode(cut).alias("at", "part"))
               .groupBy("length", "at", "part").agg(F.count("*").alias("n")))
    counted = staged(counted, "trie-parts")
    tasks = max(1, -(-counted.count() // PARTS_A_TASK))
    distinct = staged(counted.repartitionByRange(tasks, "length", "at", "part").sortWithinPartitions("length", "at", "part"),
                      "trie-sorted")
    for _ in range(rounds):
        codebooks = _round(distinct, codebooks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b["numbers"]
            size = np.diff(numbers.offsets.to_numpy())
            codes, errors = np.zeros((len(b), parts), np.int32), np.zeros(len(b), object)
            for n in set(size.tolist()):
                pick = np.flatnonzero(size == n)
                book = codebooks[n]
                rows = np.zeros((len(pick), parts * book.shape[2]), np.int64)
                rows[:, :n] = _matrix(numbers.take(pa.array(pick)), n)
                for p in range(parts):
                    distinct_parts, place = _distinct(rows[:, p * book.shape[2]:(p + 1) * book.shape[2]])
                    best, error = nearest(distinct_parts, book[p])
                    codes[pick, p] = best[place]
                    errors[pick] += error[place].astype(object)
            code_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b["row"], numbers, code_lists, pa.array([min(int(e), _TOP) for e in errors], pa.int64())],
                ["row", "numbers", "code", "error"])

    schema = T.StructType([kept.schema["row"], kept.schema["numbers"], T.StructField("code", T.ArrayType(T.IntegerType())),
                           T.StructField("error", T.LongType())])
    coded = kept.select("row", "numbers").mapInArrow(code, schema)
    return Compressed(staged(coded, "trie-codes"), codebooks)


def restored(code: Column, length: Column, codebooks: dict[int, np.ndarray], scale: int = SCALE) -> Column:
    """The vector that a code stands for: its entries' components, scaled back."""
    out = F.lit(None).cast("array<double>")
    for n, book in codebooks.items():
        parts, _, width = book.shape
        flat = F.lit([float(x) / scale for x in book.ravel().tolist()])
        entries = book.shape[1]
        whole = F.flatten(F.transform(code, lambda e, p: F.slice(flat, (p * entries + e) * width + 1, width)))  # noqa: B023
        out = F.when(length == n, F.slice(whole, 1, n)).otherwise(out)
    return out
