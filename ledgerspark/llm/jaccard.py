"""N-gram Jaccard join: a size-aware heavy-light join over distinct 5-word shingles.

Two documents link when ``100 * |intersection| >= threshold * |union|``. The result has one row per
document with its set size and its component.

Light sets (up to a boundary) enumerate fixed-size subsets: for every partner size, all subsets of
the overlap that a link needs; two sets that share such a subset meet. Heavy sets scan inverted
lists: each is listed under its first ``n - ceil(t n) + 1`` shingles in one global order, which is
enough for linked sets to meet. The order puts frequent shingles last; their frequencies are
counted over all documents. Light sets within reach of a heavy size are listed too. The boundary
is chosen by cost: subsets of the light sets against list entries times the mean list length.

No group is expanded into pairs. Lists with the same members are merged, and every list is first
compared with its smallest member only. Members that link share a component and need no more
comparisons; those outside the component of their list's smallest member are then compared, in
blocks, with the members of the lists of that component. Every pair that meets in a list is thus
compared, too different in size or connected already. Equal sets are one node.

Null and blank texts have no shingles, link with nothing and are their own component; rows with a
null id get a null component; repeated rows are returned each (an id with several texts gets the
smallest component of them); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import connected_components, staged
from ledgerspark.llm.textbatch import blocks, mixed, shingle_sets

SHINGLE, THRESHOLD = 5, 80
FREQUENT_FROM, FREQUENT_MOST = 32, 1 << 21  # a bounded table of frequent shingles orders the lists
RANGE_BYTES = 4 << 20
LARGEST_LIGHT = 24
FILTER_BITS = 26
BLOCK_SETS, BATCH_ROWS = 256, 4000


def least_overlap(a: int, b: int, threshold: int) -> int:
    """The smallest intersection with which sets of these sizes link."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def partner_sizes(n: int, threshold: int) -> range:
    return range(-(-threshold * n // 100), 100 * n // threshold + 1)


def subset_count(n: int, threshold: int, boundary: int) -> int:
    return sum(comb(n, least_overlap(n, m, threshold)) for m in partner_sizes(n, threshold) if m <= boundary)


def choose_boundary(histogram: dict[int, int], mean_list: float, threshold: int) -> int:
    """The boundary of least cost; ``histogram``: sets by size, for sizes that may be light or border on it."""
    def cost(x: int) -> float:
        light = sum(n * subset_count(s, threshold, x) for s, n in histogram.items() if 0 < s <= x)
        lists = sum(n * prefix_length(s, threshold) for s, n in histogram.items() if s > x or s * 100 >= threshold * (x + 1))
        return light + mean_list * lists
    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def packed(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as compressed gaps, byte plane by byte plane."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.uint64).astype("<u4")


def _set_sizes(docs: DataFrame, ranges: int) -> DataFrame:
    """One scan of the texts: a row per document (id, size, two set hashes), and rows with the
    upper halves of all shingle hashes as sorted counts by range."""
    width = (1 << 32) // ranges + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def counts():
            values, n = np.unique(np.concatenate(kept), return_counts=True)
            part = (values // width).astype(np.int64)
            rows = []
            for at in np.split(np.arange(len(values)), np.flatnonzero(np.diff(part)) + 1):
                once = values[at][n[at] == 1]
                more = values[at][n[at] > 1]
                rows.append((int(part[at[0]]), packed(once), packed(more), n[at][n[at] > 1].astype("<u4").tobytes()))
            k, a, b, c = zip(*rows, strict=True)
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                 pa.array(none, pa.int64()), pa.array(k, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                 pa.array(c, pa.binary())], _SIZE_NAMES)

        for b, texts in blocks(batches, 1):
            sets = shingle_sets(texts, SHINGLE)
            high = np.concatenate([(s >> np.uint64(32)).astype("<u4") for s in sets])
            kept.append(high)
            held += len(high)
            none = pa.array([None] * len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b[0].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                 pa.array(np.array([np.bitwise_xor.reduce(mixed(s + np.uint64(99))) for s in sets], np.uint64).view(np.int64)),
                 pa.array([None] * len(sets), pa.int64()), none, none, none], _SIZE_NAMES)
            if held > 4_000_000:
                yield counts()
                kept, held = [], 0
        if held:
            yield counts()

    return docs.mapInArrow(run, _SIZE_SCHEMA)


_SIZE_NAMES = ["doc_id", "n", "s1", "s2", "range", "once", "more", "counts"]
_SIZE_SCHEMA = "doc_id bigint, n bigint, s1 bigint, s2 bigint, range bigint, once binary, more binary, counts binary"


def _count_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """The frequent shingles of a range with their counts, and the range's sums for the mean list length."""
    once, more = ([unpacked(x) for x in pdf[c]] for c in ("once", "more"))
    values = np.concatenate(once + more)
    n = np.concatenate([np.ones(sum(map(len, once)), np.int64), *[np.frombuffer(x, "<u4") for x in pdf["counts"]]])
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, n = values[first], np.add.reduceat(n, first)
    hot = n >= FREQUENT_FROM
    light = n[~hot]
    return pd.DataFrame({"value": np.r_[values[hot], 0].astype(np.int64), "n": np.r_[n[hot], int(light.sum())],
                         "squares": np.r_[np.zeros(hot.sum()), float(np.square(light.astype(float)).sum())],
                         "total": np.r_[np.zeros(hot.sum(), bool), True]})


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequent shingle halves in order with their counts (at most FREQUENT_MOST: the least count is
    raised until they fit), and the mean length of the other lists."""
    found = staged(counts.groupBy("range").applyInPandas(
        _count_range, "value bigint, n bigint, squares double, total boolean"), "jac-frequent")
    sums = found.where("total").agg(F.sum("n"), F.sum("squares")).first()
    least, hot = FREQUENT_FROM, found.where("not total")
    while hot.where(F.col("n") >= least).count() > FREQUENT_MOST:
        least *= 2
    table = hot.where(F.col("n") >= least).select("value", "n").toPandas().sort_values("value")
    return table["value"].to_numpy(np.uint32), table["n"].to_numpy(np.int64), (sums[1] / sums[0]) if sums[0] else 1.0


def _list_keys(s: np.ndarray, values: np.ndarray, counts: np.ndarray, threshold: int, boundary: int) -> np.ndarray:
    """The lists in which a set stands."""
    n = len(s)
    keys = []
    if n > boundary or n * 100 >= threshold * (boundary + 1):
        high = (s >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(values, high), max(len(values) - 1, 0))
        rank = np.where(values[at] == high, counts[at], 0) if len(values) else np.zeros(n, np.int64)
        need = prefix_length(n, threshold)
        usual = np.flatnonzero(rank == 0)[:need]
        if len(usual) < need:
            rest = np.flatnonzero(rank)
            usual = np.r_[usual, rest[np.lexsort((s[rest], rank[rest]))][:need - len(usual)]]
        keys.append(s[usual])
    if n <= boundary:
        for m in partner_sizes(n, threshold):
            if m <= boundary:
                size = least_overlap(n, m, threshold)
                salt = np.uint64(min(n, m) * 1000 + max(n, m))
                keys.append(np.array([mixed(mixed(s[list(c)] + salt).sum(dtype=np.uint64, keepdims=True))[0]
                                      for c in combinations(range(n), size)], np.uint64))
    return np.concatenate(keys)


def _lists(docs: DataFrame, values, counts, threshold: int, boundary: int) -> DataFrame:
    """(key, doc_id, n): an entry for every list in which a document stands."""
    shared = docs.sparkSession.sparkContext.broadcast((values, counts))  # at most FREQUENT_MOST entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, c = shared.value
        for b, texts in blocks(batches, 1):
            ids = b[0].cast(pa.int64()).to_numpy(zero_copy_only=False)
            sets = shingle_sets(texts, SHINGLE)
            use = [i for i, s in enumerate(sets) if len(s)]
            if use:
                keys = [_list_keys(sets[i], v, c, threshold, boundary) for i in use]
                per = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids[use].astype(np.int64), per)),
                     pa.array(np.repeat(np.array([len(sets[i]) for i in use], np.int32), per))], ["key", "doc_id", "n"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint, n int")


def _with_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by key, those whose key stands at least twice; one entry is held back between batches."""
    held, known = None, None  # the last entry, and whether its key had company
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b])
        if not len(t):
            continue
        k = t["key"].to_numpy()
        same = k[1:] == k[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        if held is not None and known:
            keep[0] = True
        out = t.filter(pa.array(np.r_[keep[:-1], False]))
        yield from out.combine_chunks().to_batches()
        known = bool(keep[-1]) if len(k) > 1 or held is None else known
        held = t.slice(len(t) - 1).combine_chunks().to_batches()[0]
    if held is not None and known:
        yield held


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS hash places of ids (8 MB whatever their number): ids outside it
    are surely not among them. Made by chunks on the executors."""
    chunk = 1 << 16

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(chunk, np.uint8)
        bits[pdf["place"].to_numpy() % chunk] = 1
        return pd.DataFrame({"chunk": [int(pdf["place"].iloc[0]) // chunk], "bits": [np.packbits(bits).tobytes()]})

    place = ids.select(F.pmod(F.col("doc_id"), F.lit(1 << FILTER_BITS)).alias("place")).distinct()
    rows = (place.groupBy(F.floor(F.col("place") / chunk).alias("c"))
            .applyInPandas(run, "chunk bigint, bits binary").toLocalIterator())
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:
        out[r.chunk * chunk // 8:(r.chunk + 1) * chunk // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the wanted documents, written. Others are passed over by the bitmap
    before their text is made a set; the few that slip through are dropped by the joins."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted():
            for b in batches:
                b = b.filter(b[0].is_valid())
                place = b[0].cast(pa.int64()).to_numpy() % (1 << FILTER_BITS)
                yield b.filter(pa.array((bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1))
        for b, texts in blocks(wanted(), 1):
            yield pa.RecordBatch.from_arrays(
                [b[0].cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, SHINGLE)], pa.binary())],
                ["doc_id", "shingles"])

    return staged(docs.mapInArrow(run, "doc_id bigint, shingles binary"), "jac-sets")


CELL = ["group", "l_block", "r_block"]


def _cells(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the left and the right rows of every cell that has both."""
    cell = pdf[CELL].to_numpy()
    order = np.lexsort(cell.T[::-1])
    opens = np.flatnonzero(np.r_[True, (cell[order][1:] != cell[order][:-1]).any(axis=1)])
    side = pdf["side"].to_numpy()
    for at in np.split(order, opens[1:]):
        left, right = at[side[at] == 0], at[side[at] == 1]
        if len(left) and len(right):
            yield left, right


class _Inverted:
    """Some ascending or unordered arrays of values as one inverted list."""

    def __init__(self, arrays: list[np.ndarray]):
        self.n = len(arrays)
        token = np.concatenate(arrays)
        owner = np.repeat(np.arange(self.n), [len(x) for x in arrays])
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def shared(self, values: np.ndarray) -> np.ndarray:
        """How many of the values stand in each array."""
        lo, hi = np.searchsorted(self.token, values), np.searchsorted(self.token, values, "right")
        per = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(per)[:-1]], per) + np.arange(per.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _block_links(threshold: int):
    """Links between the left and the right sets of each cell: for every left set, one right set of
    each label that it links with."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in pdf["shingles"]]
        size = np.array([len(x) for x in sets])
        src, dst = [], []
        for left, right in _cells(pdf):
            lists = _Inverted([sets[j] for j in right])
            for i in left:
                both = lists.shared(sets[i])
                hit = right[(both * 100 >= threshold * (size[i] + size[right] - both)) & (label[right] != label[i])]
                hit = hit[np.unique(label[hit], return_index=True)[1]]
                src += [node[i]] * len(hit)
                dst += node[hit].tolist()
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})
    return run


def _block_survivors(threshold: int):
    """The left and right rows that may link with some row of the other side and another label, by
    the lists they share: shared shingles lie in both prefixes or behind the prefix of the set
    whose prefix ends first, so there are at most ``shared lists + size - prefix`` of them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, label = pdf["n"].to_numpy(np.int64), pdf["label"].to_numpy()
        behind = -(-threshold * n // 100) - 1
        keys = pdf["keys"].to_list()
        live = np.zeros(len(pdf), bool)
        for left, right in _cells(pdf):
            lists, m = _Inverted([keys[j] for j in right]), n[right]
            for i in left:
                shared = lists.shared(keys[i])
                small, large = np.minimum(n[i], m), np.maximum(n[i], m)
                need = -(-threshold * (n[i] + m) // (100 + threshold))
                ok = ((shared > 0) & (label[right] != label[i]) & (small * 100 >= threshold * large)
                      & ((shared + np.maximum(behind[i], behind[right]) >= need) | (small <= 2 * LARGEST_LIGHT)))
                live[i] |= ok.any()
                live[right[ok]] = True
        return pdf.loc[live, ["side", "group", "node", "label"]]
    return run


def _blocks(left: DataFrame, right: DataFrame, payload: DataFrame, columns: list[str]):
    """Rows of both sides with their payload, dealt to the cells of a grid of blocks of about
    BLOCK_SETS rows for every group; cells are gathered in batches of about BATCH_ROWS rows, so a
    task's memory is bounded however large a group is."""
    def blocks_of(df, rows, name):
        return df.groupBy("group").agg(F.count("*").alias(rows), F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias(name))

    grid = staged(blocks_of(left, "nl", "lefts").join(blocks_of(right, "nr", "rights"), "group"), "jac-grid")
    total = grid.agg(F.sum(F.col("nl") * F.col("rights") + F.col("nr") * F.col("lefts"))).first()[0] or 0

    def dealt(df, own, others, side):
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("lr"[side] + "_block")
        return (df.join(grid, "group").select("group", "node", "label", mine, F.explode(
            F.sequence(F.lit(0), F.col(others) - 1)).alias("rl"[side] + "_block"))
            .select(*CELL, F.lit(side).alias("side"), "node", "label"))

    both = dealt(left, "lefts", "rights", 0).union(dealt(right, "rights", "lefts", 1))
    batch = F.pmod(F.xxhash64(*CELL), F.lit(max(1, -(-total // BATCH_ROWS)))).alias("batch")
    return both.join(payload, "node").select(batch, *CELL, "side", "node", "label", *columns).groupBy("batch")


def _compare(left: DataFrame, right: DataFrame, lists: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links ``(src, dst)`` between ``left`` and ``right(group, node, label)`` rows of equal group
    and different label, written. Rows that can't link by their lists are left out before any
    set is made."""
    live = staged(_blocks(left, right, lists, ["n", "keys"]).applyInPandas(
        _block_survivors(threshold), "side int, group bigint, node bigint, label bigint"), "jac-live")
    sets = _sets_of(docs, live.select(F.col("node").alias("doc_id"))).select(F.col("doc_id").alias("node"), "shingles")
    sides = [live.where(F.col("side") == k).select("group", "node", "label").distinct() for k in (0, 1)]
    return staged(_blocks(*sides, sets, ["shingles"]).applyInPandas(
        _block_links(threshold), "src bigint, dst bigint"), "jac-links")


def _near_size(a, b, threshold: int):
    return F.least(a, b) * 100 >= threshold * F.greatest(a, b)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scanned = staged(_set_sizes(docs, max(16, size * 2 // 3 // RANGE_BYTES)), "jac-sizes")
    sizes = scanned.where("range IS NULL").select("doc_id", "n", "s1", "s2")
    values, counts, mean_list = _frequent(scanned.where("range IS NOT NULL").select("range", "once", "more", "counts"))
    histogram = {r.n: r["count"] for r in sizes.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").count().collect()}
    boundary = choose_boundary(histogram, mean_list, threshold)

    # equal sets are one node: the smallest id
    reps = staged(sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
                  .agg(F.min("doc_id").alias("rep")), "jac-reps")
    same = (sizes.where("n > 0 AND doc_id IS NOT NULL").join(reps, ["n", "s1", "s2"])
            .select("doc_id", "rep").distinct())
    same = staged(same, "jac-same")

    entries = _lists(docs.where("doc_id IS NOT NULL"), values, counts, threshold, boundary)
    shared = staged(entries.repartition("key").sortWithinPartitions("key")
                    .mapInArrow(_with_company, "key bigint, doc_id bigint, n int"), "jac-lists")
    alike = (shared.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("h"),
                                       F.min("doc_id").alias("least"))
             .groupBy("m", "h", "least").agg(F.min("key").alias("key")).select("key"))
    members = shared.join(alike, "key").join(same, "doc_id").select("key", F.col("rep").alias("node"), "n").distinct()
    members = staged(members, "jac-members")

    def pivots(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("m")).where("m > 1")

    heads = pivots(members).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"))
    stars = staged(members.join(heads, "key"), "jac-stars")
    nodes = stars.select(F.col("node").alias("doc_id")).distinct()
    lists = staged(shared.join(nodes, "doc_id").groupBy("doc_id", "n").agg(F.collect_set("key").alias("keys"))
                   .select(F.col("doc_id").alias("node"), "n", "keys"), "jac-keys")
    near = stars.where("node <> pivot").where(_near_size(F.col("n"), F.col("pn"), threshold))
    right = staged(near.select(F.col("pivot").alias("group"), "node", F.col("node").alias("label")).distinct(), "jac-right")
    left = right.select("group", F.col("group").alias("node"), F.col("group").alias("label")).distinct()
    label = connected_components(_compare(left, right, lists, docs, threshold))

    # members outside the component of their list's smallest member meet all members of the list
    home = label.select(F.col("node").alias("pivot"), F.col("component").alias("home"))
    placed = staged(stars.join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
                    .join(home, "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))
                    .select("key", "node", "pivot", "label", "home"), "jac-placed")
    others = placed.where("node <> pivot")
    unsettled = others.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    every = others.join(unsettled.select("key"), "key", "left_semi")
    out = every.where("label <> home")
    sides = [staged(x.select(F.col("home").alias("group"), "node", "label").distinct(), "jac-side") for x in (out, every)]
    more = _compare(*sides, lists, docs, threshold)
    # second round over the components of the first
    a = label.select(F.col("node").alias("src"), F.col("component").alias("ca"))
    b = label.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    joined = (more.join(a, "src", "left").join(b, "dst", "left")
              .select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst")))
    second = connected_components(joined).select(F.col("node").alias("c1"), F.col("component").alias("c2"))
    whole = (same.join(label, same["rep"] == label["node"], "left")
             .select("doc_id", F.coalesce("component", "rep").alias("c"))
             .join(second, F.col("c") == F.col("c1"), "left")
             .groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.coalesce("c2", "c")).alias("c")))
    return (sizes.join(whole, sizes["doc_id"] == whole["__id"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id")))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the document with the smallest id. Rows
    with an id that repeats are told apart by nothing, so they stay or go together."""
    found = jaccard_components(docs, id_col, text_col, threshold)
    gone = staged(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "jac-gone")
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
