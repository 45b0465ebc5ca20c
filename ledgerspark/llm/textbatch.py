"""Array code over batches of texts: words, word hashes and distinct word shingles.

Words are maximal runs without ASCII white space after lower-casing A-Z, on UTF-8 bytes. Hashes are
64-bit: a polynomial over the bytes of a word and a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes of text handled at once (a longer text makes a block of its own)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply, shift, xor)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about BLOCK bytes of text, and their texts in UTF-8 (null: empty)."""
    for b in batches:
        texts = [(t or "").encode("utf-8") for t in b[text_at].to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= BLOCK:
                yield b.slice(start, i + 1 - start), texts[start:i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield b.slice(start), texts[start:]


class Words:
    """The words of some texts: ``start``, ``end`` in ``raw`` (lower-cased bytes), ``doc``, ``first`` word of each doc."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.cased = np.frombuffer(joined, np.uint8)
        self.raw = np.frombuffer(joined.lower(), np.uint8)
        space = _SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.r_[0, edge]
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.r_[0, np.cumsum(lengths + 1)]
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """A hash of every word, or of every ``raw[start:end]`` for each (start, end) given."""
        n = len(self.raw)
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        back = _inverse_power(n)  # hashes don't depend on the length of the block
        return [mixed((total[e] - total[s]) * power[n - e] * back + (e - s).astype(np.uint64))
                for s, e in spans or ((self.start, self.end),)]


def _inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), -n, 1 << 64))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of each text; a text with fewer
    words has its whole sequence as one shingle, one without words an empty set."""
    w = Words(texts)
    if not len(w.start):
        return [np.empty(0, np.uint64)] * len(texts)
    h = w.hashes()[0]
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h)
    acc = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        acc += h[j:n - size + 1 + j] * weights[j] if len(acc) else np.uint64(0)
    acc = mixed(acc + np.uint64(size))
    out = []
    for first, count in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if count >= size:
            s = np.sort(acc[first:first + count - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        elif count:
            part = (h[first:first + count] * weights[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mixed(np.array([part], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
