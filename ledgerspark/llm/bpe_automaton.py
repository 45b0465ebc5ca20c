"""BPE encoding by a tokenization automaton, and decoding by emitting its arcs' labels.

The merges are compiled into a deterministic automaton over tokens that accepts exactly the token
sequences that BPE gives. At first one state accepts every sequence of base symbols. Every merge
``(u, v) -> w`` then applies one merge gadget: the state behind ``u`` is split off as a copy that has
lost its arc ``v``; wherever ``u`` leads into such a state, a new arc ``w`` leads on to where ``v`` led.
All arcs of one token lead to the same state, so a state is named by its token and never stored
arc by arc: it keeps the arcs that its own gadgets cut (``cuts``), and below them it is the state of
the token's right half as that was when the token was made. A state has an arc made later if it has
the arc's left half. ``Automaton.follows`` reads a transition off these tables.

A word's encoding is the one path of the automaton that spells it. ``Automaton.spell`` finds it by
the longest arcs first and never visits a place of the word twice, hence it is linear in the word's
length (times the longest token). Words are told apart as the vocabulary file says: added tokens
first, then its normaliser and split pattern.

Null text is empty and gives no ids; null ids and repeated rows are kept as rows; an empty table gives
an empty result; columns other than the two that are named are ignored, whatever their names. Long
texts are handled in parts that end at white space; nothing is cut off.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 19  # characters of text whose words are listed at once
OUT_IDS = 1 << 21  # ids in a batch that is handed on (a longer text makes a batch of its own)
KEPT, KEY_KEPT = 1 << 18, 48  # encodings held by a task, and the longest words among them
TRANSITIONS_KEPT = 1 << 20  # transitions held by a task
# Characters for which Python's tables and the vocabulary's normaliser and split pattern agree and
# that never compose; texts with others go through the file's own normaliser and pattern.
_PLAIN = re.compile("[\x00-\x1b\x20-˿Ѐ-԰‐-‧‰-⁞₠-₿、-ゖァ-ヺ一-龥가-힣]*+")
_SPACE = re.compile("[ \t\n]")  # never part of a word


def byte_characters() -> str:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(rest)) for b in range(256))


class Automaton:
    """Tokens 0..n-1 with their labels; ``merges`` in order of rank as (left, right, made) ids."""

    def __init__(self, labels: list[str], merges: list[tuple[int, int, int]], end: str):
        self.labels, self.size = labels, len(labels)
        self.made = [-1] * self.size  # the merge that made a token, -1: a base symbol
        self.left, self.right = [0] * self.size, [0] * self.size
        self.cuts: dict[int, int] = {}  # (token whose state lost an arc, arc): the merge that cut it
        dead = set()
        for k, (u, v, w) in enumerate(merges):
            if u in dead or v in dead or not self.follows(u, v):
                dead.add(w)  # BPE never comes to apply this merge
                continue
            self.cuts[u * self.size + v] = k
            self.made[w], self.left[w], self.right[w] = k, u, v
        self.known: dict[int, bool] = {}  # transitions read off before, by (state, arc)
        self.inner = {t: i for i, t in enumerate(labels) if t and not t.endswith(end) and i not in dead}
        self.last = {t[:-len(end)]: i for i, t in enumerate(labels) if t.endswith(end) and i not in dead}
        self.reach: dict[str, int] = {}  # the longest token that begins with three characters
        for t in [*self.inner, *self.last]:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 3))

    def follows(self, before: int, arc: int) -> bool:
        """Whether the state behind ``before`` has the arc."""
        cuts, made, left, right, size = self.cuts, self.made, self.left, self.right, self.size
        since = len(made) * 2  # cuts up to then concern ``arc``, later ones what was made of it
        while True:
            state, until = before, since
            while True:
                k = cuts.get(state * size + arc)
                if k is not None and k <= until:
                    return False
                if made[state] < 0:
                    break
                until = min(until, made[state] - 1)
                state = right[state]
            if made[arc] < 0:
                return True
            since, arc = made[arc], left[arc]

    def spell(self, word: str) -> list[int]:
        """The ids of one word, given as byte characters; none for the empty word."""
        inner, last, reach, known, size, n = self.inner, self.last, self.reach, self.known, self.size, len(word)
        path, back, seen, place = [], [], {0}, 0
        size_left = reach.get(word[:3], 2)  # the longest arc not yet tried from this place
        while place < n:
            while size_left:
                to = place + size_left
                size_left -= 1
                token = inner.get(word[place:to]) if to < n else last.get(word[place:]) if to == n else None
                if token is None or to in seen:
                    continue
                if path:
                    transition = path[-1] * size + token
                    follows = known.get(transition)
                    if follows is None:
                        if len(known) >= TRANSITIONS_KEPT:
                            known.clear()
                        follows = known[transition] = self.follows(path[-1], token)
                    if not follows:
                        continue
                back.append((place, size_left))
                path.append(token)
                seen.add(to)
                place, size_left = to, reach.get(word[to:to + 3], 2)
                break
            else:  # no arc leads on from here: go back
                place, size_left = back.pop()
                path.pop()
        return path


class Vocabulary:
    """A vocabulary file: the automaton, added tokens, and how its texts become words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        ends = [s["type"] for s in steps] == ["Split", "ByteLevel"] and model.get("end_of_word_suffix")
        if not ends or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"not a BPE vocabulary with byte symbols, a split pattern and word ends: {path}")
        self.path, self.pattern = path, steps[0]["pattern"]["Regex"]
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = dict(zip(vocab.values(), vocab.keys(), strict=True)) | {i: t for t, i in self.added.items()}
        labels = [self.labels[i] if i in self.labels else "" for i in range(max(vocab.values()) + 1)]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.automaton = Automaton(labels, merges, ends)


class Lately(dict):
    """The values of the short keys met lately: when ``KEPT`` are held, they become ``older`` and
    replace those. Other values are made anew."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEY_KEPT:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids (as bytes) within one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(vocabulary.pattern)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")")
        self.characters = byte_characters()
        self.pieces = Lately(self.piece)  # runs of characters without white space, and their words
        self.exact = None

    def piece(self, run: str) -> bytes:
        words = [run] if run.isalpha() else self.pattern.findall(run)
        if len(words) > 1:
            return b"".join(map(self.pieces.__getitem__, words))
        return self.word(words[0]) if words else b""

    def word(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable():
            characters = self.characters
            word = "".join([characters[b] for b in word.encode("utf-8")])
        return array("i", self.vocabulary.automaton.spell(word)).tobytes()

    def segment(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if _PLAIN.fullmatch(text):  # words never reach over white space, which splits the same for both
            return b"".join(map(self.pieces.__getitem__, text.lower().split()))
        if self.exact is None:
            from tokenizers import Regex, Tokenizer
            from tokenizers.pre_tokenizers import Split

            normal = Tokenizer.from_file(self.vocabulary.path).normalizer
            by = Split(Regex(self.vocabulary.pattern), "removed", invert=True)
            self.exact = lambda t: [w for w, _ in by.pre_tokenize_str(normal.normalize_str(t))]
        return b"".join(map(self.word, self.exact(text)))

    def ids(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        out = []
        special = any(token in text for token in self.vocabulary.added)
        for k, segment in enumerate(self.added.split(text) if special else [text]):
            if k % 2:
                out.append(array("i", [self.vocabulary.added[segment]]).tobytes())
                continue
            at = 0
            while at < len(segment):
                to = len(segment)
                if to > at + PART:
                    space = _SPACE.search(segment, at + PART)
                    to = space.start() if space else to
                out.append(self.segment(segment[at:to]))
                at = to
        return b"".join(out)


def _parts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part holds about ``most`` bytes or values of a column."""
    for b in batches:
        sizes = np.diff(np.frombuffer(b[column].buffers()[1], np.int32, len(b) + 1, 4 * b[column].offset)) if len(b) else []
        start, held = 0, 0
        for i, n in enumerate(np.asarray(sizes).tolist()):
            held += n + 8
            if held >= most:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(b):
            yield b.slice(start)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every document; the vocabulary's file must be on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b in _parts(batches, 1, 2 * OUT_IDS):
            ids = [encoder.ids(text) if text else b"" for text in b[1].to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([b[0], lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, text)``: the labels of the ids' arcs, joined by a space as the file names no
    decoder. Ids without a token are left out; null ids give a null text."""
    labels = pa.array([vocabulary.labels.get(i) for i in range(max(vocabulary.labels) + 1)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 1, OUT_IDS):
            lists = b[1]
            ids = lists.flatten()
            held = np.diff(np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            number = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            known = (number >= 0) & (number < len(labels))
            known[known] = labels.is_valid().to_numpy(zero_copy_only=False)[number[known]]
            row = np.repeat(np.arange(len(b)), held)[known]
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(b)))]
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), labels.take(pa.array(number[known])))
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), pc.binary_join(words, " "))
            yield pa.RecordBatch.from_arrays([b[0], lists, texts], ["doc_id", "ids", "text"])

    return tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")) \
        .mapInArrow(run, "doc_id bigint, ids array<int>, text string")
