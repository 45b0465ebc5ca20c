"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes: tokens A of a text with a space before it by byte-level BPE, tokens
B by the piece model, which adds that space itself. Offsets where tokens of both end cut the bytes into
groups; an A and a B token are linked where their bytes overlap, once per occurrence.

``align`` (A and B ids in one pass) deals documents to blocks of at most ``BLOCK_DOCS`` documents and
about ``BLOCK_BYTES`` bytes. For every pair of linked ids a block has a posting: a compressed bitmap of
its documents by number in the block (plane 0), and multiplicity planes: plane j + 1 holds the
documents in which bit j of the pair's links beyond the first is set. A plane is a list of 2-byte
numbers, or a bit set where that is shorter.

``pair_counts``: as blocks hold different documents, OR-merging a pair's bitmaps of all blocks lays them
side by side, and popcounts add up: those of plane 0 are its documents; with those of plane j + 1
times 2^j they are its links. ``scores``: every block asks for the counts of its pairs (a join by pair);
with them its postings, one group per block, which its bounds keep small, are added up per document.

Every row is a document of its own, also with equal or null ids. Texts that are null or empty, or
whose tokens' bytes differ from the text (of either tokenizer), have no tokens: zeros, and an empty
``groups``. Empty tables give empty results; other columns are ignored, whatever their names. A text
longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import staged

BLOCK_DOCS, BLOCK_BYTES = 1 << 16, 1 << 23
STEP_BYTES = 1 << 19  # of texts that are tokenized at once
_ROWS = ("block long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
         "pair long, plane int, dense boolean, bits binary, docs long")
_DOC = ["block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
_POSTING = ["block", "pair", "plane", "dense", "bits", "docs"]
_SIDE = 23  # bits of an id inside a pair
_LONG_RUN = re.compile(r"\s{5000}")


def byte_pieces(path: str):
    """The ids of texts under a rank file of byte-level BPE, and every id's bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = []

    def ids(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if len(t) > 5000 and _LONG_RUN.search(t):  # the pattern engine gives up on very long runs; the library of the file doesn't
                if not exact:
                    from tokenizers import Tokenizer

                    exact.append(Tokenizer.from_file(path.rsplit(".", 1)[0] + ".json"))
                    exact[0].encode_special_tokens = True
                out.append(np.array(exact[0].encode(" " + t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(encoding.encode_to_numpy(" " + t, disallowed_special=()))
        return out

    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return ids, table


def model_pieces(path: str):
    """The same of a piece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece_bytes(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[1:-1], 16)])
        return model.id_to_piece(i).replace("▁", " ").encode("utf-8")

    return (lambda texts: model.encode(texts, num_threads=1)), [piece_bytes(i) for i in range(model.get_piece_size())]


def planes_of(key: np.ndarray, times: np.ndarray, n_docs: int) -> Iterator[tuple]:
    """Sorted keys (pair << 16 | document) and how often each is linked -> per plane the pairs, bytes
    of each, all bytes, whether they are bit sets, and popcounts."""
    width = -(-n_docs // 8)
    for plane in range(1 + int(times.max(initial=1) - 1).bit_length()):
        here = key[(times - 1) >> (plane - 1) & 1 == 1] if plane else key
        if not len(here):
            continue
        pair, doc = here >> 16, (here & 0xFFFF).astype("<u2")
        at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        counts = np.diff(np.r_[at, len(pair)])
        dense = (counts >= 64) & (counts * 2 > width)
        if not dense.all():
            lists = doc[~np.repeat(dense, counts)]
            yield plane, pair[at[~dense]], 2 * counts[~dense], lists.tobytes(), False, counts[~dense]
        for start in range(0, int(dense.sum()), 1024):  # bit sets of some pairs at once
            some = np.flatnonzero(dense)[start:start + 1024]
            bits = np.zeros((len(some), width * 8), np.uint8)
            for k, i in enumerate(some.tolist()):
                bits[k, doc[at[i]:at[i] + counts[i]]] = 1
            yield (plane, pair[at[some]], np.full(len(some), width),
                   np.packbits(bits, axis=1, bitorder="little").tobytes(), True, counts[some])


def members(planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The documents in bit sets, one after the other, and how many each holds."""
    where = [np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")) for p in planes]
    return np.concatenate(where), np.fromiter(map(len, where), np.int64, len(where))


@dataclass
class Aligned:
    """``documents`` (block, doc, doc_id, n_a, n_b, n_groups, n_links, groups) and ``postings``
    (block, pair, plane, dense, bits, docs), both written tables."""

    documents: DataFrame
    postings: DataFrame


class _Aligner:
    """Turns the texts of a block into rows of documents and, at its end, of postings."""

    def __init__(self, a, b, block: int):
        (self.a, self.a_bytes), (self.b, self.b_bytes) = a, b
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.base = max(len(self.a_bytes), len(self.b_bytes))
        if self.base >> _SIDE:
            raise ValueError("ids of this size do not fit into a pair")
        # an id followed by what comes behind it: , inside a side, | behind A, ; behind a group, nothing at the end
        self.words = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.base)]
        self.open(block)

    def open(self, block: int) -> None:
        self.block, self.n, self.size, self.keys, self.times = block, 0, 0, [], []

    def add(self, ids: list, texts: list[str]) -> pa.RecordBatch:
        """The documents' rows; their links are kept for the postings."""
        n = len(texts)
        a_ids, b_ids, size = [np.empty(0, np.int64)], [], np.zeros(n, np.int64)
        n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        filled = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in filled]
        for i, t, a, b in zip(filled, some, self.a(some), self.b(some), strict=True):
            raw = b" " + t.encode("utf-8")
            # byte-level pieces are cut from the text's own bytes: their length tells whether all are there
            if b"".join([self.b_bytes[x] for x in b]) == raw and int(self.a_len[a].sum()) == len(raw):
                a_ids.append(a)
                b_ids += b
                n_a[i], n_b[i], size[i] = len(a), len(b), len(raw)
        a_ids, b_ids = np.concatenate(a_ids).astype(np.int64), np.array(b_ids, np.int64)
        a_end, b_end, doc_end = np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]), np.cumsum(size)
        ends = np.zeros((2, int(size.sum()) + 1), bool)  # offsets where an A, and a B token ends
        ends[0, a_end] = ends[1, b_end] = True
        both = ends[0] & ends[1]  # true of every document's end
        parts = np.flatnonzero(ends[0] | ends[1])  # every part between two ends lies in one A and one B token
        doc = np.searchsorted(doc_end, parts, "left")
        pair = a_ids[np.searchsorted(a_end, parts, "left")] << _SIDE | b_ids[np.searchsorted(b_end, parts, "left")]
        key, times = np.unique(pair << 16 | (doc + self.n), return_counts=True)
        self.keys.append(key)
        self.times.append(times)
        groups = self._groups(n_a, n_b, a_ids, b_ids, a_end, b_end, both, doc_end)
        out = _rows(block=np.full(n, self.block), doc=np.arange(self.n, self.n + n), doc_id=ids, n_a=n_a, n_b=n_b,
                    n_groups=np.bincount(np.searchsorted(doc_end, np.flatnonzero(both), "left"), minlength=n),
                    n_links=np.bincount(doc, minlength=n), groups=groups)
        self.n += n
        self.size += int(size.sum())
        return out

    def _groups(self, n_a, n_b, a_ids, b_ids, a_end, b_end, both, doc_end) -> list[str]:
        group = np.cumsum(both) - both  # of a token that ends at an offset
        final = np.zeros(len(both), bool)
        final[doc_end] = True
        a_word = a_ids + self.base * both[a_end]
        b_word = b_ids + self.base * np.where(final[b_end], 3, 2 * both[b_end])
        # sorted by group and side, in order
        word = np.r_[a_word, b_word][np.argsort(np.r_[group[a_end] * 2, group[b_end] * 2 + 1], kind="stable")].tolist()
        words, ends = self.words, np.cumsum(n_a + n_b).tolist()
        return ["".join([words[w] for w in word[s:e]]) for s, e in zip([0, *ends], ends, strict=False)]

    def close(self) -> Iterator[pa.RecordBatch]:
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key)
        for plane, pairs, sizes, raw, dense, docs in planes_of(key[order], times[order], self.n) if len(key) else ():
            m = len(pairs)
            bits = pa.Array.from_buffers(pa.binary(), m, [
                None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(raw)])
            yield _rows(block=np.full(m, self.block), pair=pairs, plane=np.full(m, plane), dense=np.full(m, dense),
                        bits=bits, docs=docs)
        self.open(self.block + 1)


_KINDS = {"block": pa.int64(), "doc": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
          "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "pair": pa.int64(), "plane": pa.int32(),
          "dense": pa.bool_(), "bits": pa.binary(), "docs": pa.int64()}


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["block"])
    arrays = [pa.nulls(n, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array)
              else pa.array(columns[c], t) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_KINDS))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          keep_groups: bool = True) -> Aligned:
    """The documents' alignments and the inverted index of their pairs. ``a_path``: a rank file with the
    vocabulary file of the same name beside it; ``b_path``: a piece model; both on every executor.
    ``keep_groups=False`` stores the SHA-256 of ``groups`` in its place ('' stays '')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(byte_pieces(a_path), model_pieces(b_path), TaskContext.get().partitionId() << 32)
        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= STEP_BYTES or aligner.n + len(ids) >= BLOCK_DOCS:
                    yield aligner.add(ids, texts)
                    ids, texts, size = [], [], 0
                    if aligner.size >= BLOCK_BYTES or aligner.n >= BLOCK_DOCS:
                        yield from aligner.close()
            if ids:
                yield aligner.add(ids, texts)
        if aligner.n:
            yield from aligner.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, _ROWS)
    if not keep_groups:
        rows = rows.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    rows = staged(rows, "align-rows")
    return Aligned(rows.where("doc is not null").select(*_DOC), rows.where("doc is null").select(*_POSTING))


def _weight():
    """The links that a document in a plane stands for."""
    return F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(pair, a, b, documents, links, best)``: of every linked pair the number of documents and of
    links in the corpus, and whether no other pair of its B id has more links."""
    counts = staged(postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("documents"),
        F.sum(F.col("docs") * _weight()).alias("links")), "align-counts")
    b = F.col("pair").bitwiseAND((1 << _SIDE) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select(
        "pair", F.shiftright("pair", _SIDE).alias("a"), "b", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def scores(aligned: Aligned, counts: DataFrame) -> DataFrame:
    """``documents`` with n_best (links of a pair that is best for its B id), count_sum (the links'
    corpus-wide counts, added up) and document_sum (the same of the numbers of documents)."""

    total = ["n_best", "count_sum", "document_sum"]

    def add_up(key, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dense", kind="stable")  # lists, then bit sets
        planes, dense = rows["bits"].tolist(), int(rows["dense"].sum())
        lists = planes[:len(planes) - dense]
        doc = np.frombuffer(b"".join(lists), "<u2").astype(np.int64)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 2
        if dense:
            more, counted = members(planes[len(lists):])
            doc, sizes = np.r_[doc, more], np.r_[sizes, counted]
        plane = rows["plane"].to_numpy(np.int64)
        weight = np.where(plane > 0, np.int64(1) << np.maximum(plane - 1, 0), 1)
        found = found.sort_values("of")
        place = np.searchsorted(found["of"].to_numpy(), rows["pair"].to_numpy())
        out = {"block": np.full(doc.max() + 1, key[0]), "doc": np.arange(doc.max() + 1, dtype=np.int32)}
        for name in total:
            out[name] = np.zeros(len(out["doc"]), np.int64)
            np.add.at(out[name], doc, np.repeat(found[name].to_numpy(np.int64)[place] * weight, sizes))
        return pd.DataFrame(out)

    # a block asks for the counts of its pairs; the bitmaps themselves travel once, by block
    asked = aligned.postings.where("plane = 0").select(F.col("block").alias("at"), F.col("pair").alias("of"))
    value = [F.col("best").cast("bigint"), F.col("links"), F.col("documents")]
    found = asked.join(counts, asked["of"] == counts["pair"]).select("at", "of", *[v.alias(c) for c, v in zip(total, value, strict=True)])
    scored = (aligned.postings.select("block", "pair", "plane", "dense", "bits").groupBy("block")
              .cogroup(found.groupBy("at"))
              .applyInPandas(add_up, "block long, doc int, n_best long, count_sum long, document_sum long"))
    return aligned.documents.join(scored, ["block", "doc"], "left").select(
        *aligned.documents.columns, *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in total])
