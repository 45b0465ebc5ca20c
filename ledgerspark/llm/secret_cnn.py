"""Secret scan: a character convolutional network over every candidate and its context.

Base findings come from three fixed patterns and are always reported. Candidates are all maximal
runs of ``MIN_RUN`` or more token characters; those that no base finding touches, and what base
findings leave of the others (again ``MIN_RUN`` or more characters), are scored by the network and reported as kind ``net`` when they pass. The network is trained on labelled findings:
candidates inside base findings are positive, the others negative, and every positive also appears
with a negative's context, so that the value counts and not only the words before it. Scores are
calibrated on held-out findings, and each character class has the highest threshold that keeps the wanted recall there,
but none below 0.5, and a class with fewer than 20 held-out positives the one of all classes and none
below 0.9: such floors put precision before the wanted recall.

All windows of all findings of all documents are learned from, equal ones once: three quarters (by the
window's hash) train, the rest calibrates; a label of which one side would be empty, or with fewer than
4 windows, does both. They are dealt by hash into shards of about ``SHARD`` windows. In every epoch
each shard takes the network a pass over its windows, one task a shard, and the next epoch starts from
the mean of their results (weights and Adam's moments). Calibration counts all held-out windows by
score, label and class; a score is the network's output in steps of 1 / ``SCORE``, so that these
counts are few and exact. Shards and sums in integers do not depend on how documents are partitioned.

Every text is scanned whole. Null text is empty; other columns are ignored; repeated rows are reported
each; only a table in which no candidate lies in a base finding, or every one does, gets no ``net`` spans.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import staged

# The base patterns, in the order in which kinds sort.
KINDS = ["assign", "access", "hex", "net"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

MIN_RUN, LEFT, BODY, RIGHT = 16, 24, 64, 8
WINDOW = LEFT + BODY + RIGHT
EMBED, WIDTH, FILTERS = 8, 5, 24
EPOCHS, SHARD, SCORE, EXACT = 4, 16_384, 1024, 1 << 40  # EXACT: steps to 1 in which means are summed
SLICE = 4096  # windows sent at once
RECALL = 0.98
_TOKEN = np.zeros(128, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def runs(codes: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` characters of the table."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = table[np.minimum(codes, 127)] & (codes < 128)
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    wide = end - start >= least
    return list(zip(start[wide].tolist(), end[wide].tolist(), strict=True))


def base_spans(text: str, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(s, 2, e) for s, e in runs(codes, _HEX, HEX_LEAST)]
    return sorted(found)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def windows(codes: np.ndarray, start: int, end: int) -> np.ndarray:
    """Character windows (bytes; 0 outside, 127 for non-ASCII; the top bit marks the candidate): one per BODY characters."""
    first = max(0, start - LEFT)
    near = codes[first:end + RIGHT]
    plain, start, end = np.where(near < 127, near, 127).astype(np.uint8), start - first, end - first
    out = np.zeros((-(-(end - start) // BODY), WINDOW), np.uint8)
    for k in range(len(out)):
        at = start + k * BODY
        stop = min(end, at + BODY)
        left = plain[max(0, at - LEFT):at]
        out[k, LEFT - len(left):LEFT] = left
        out[k, LEFT:LEFT + stop - at] = plain[at:stop] | 128
        right = plain[stop:stop + RIGHT]
        out[k, LEFT + stop - at:LEFT + stop - at + len(right)] = right
    return out


def char_class(window: np.ndarray) -> np.ndarray:
    """0 no digit, 1 digits only or with lower case, 2 with upper case only, 3 with both."""
    body, c = window >= 128, window & 127
    has = lambda a, b: (body & (c >= ord(a)) & (c <= ord(b))).any(axis=1)
    return np.where(~has("0", "9"), 0, 1 + 2 * (has("a", "z") & has("A", "Z")) + (has("A", "Z") & ~has("a", "z")))


class CharNet:
    """Embedding, one convolution, max and mean over places, logistic output; Adam in numpy."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        wide = WIDTH * (EMBED + 1)
        self.p = {"embed": r.normal(0, 0.3, (128, EMBED)), "conv": r.normal(0, (2 / wide) ** 0.5, (wide, FILTERS)),
                  "bias": np.zeros(FILTERS), "out": r.normal(0, 0.2, 2 * FILTERS), "shift": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}  # Adam's moments and steps
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step = 0
        self.scale, self.offset = 1.0, 0.0
        self.thresholds = np.ones(4)

    def _forward(self, x: np.ndarray):
        chars = x & 127
        e = np.concatenate([self.p["embed"][chars], (x >= 128)[..., None].astype(np.float32)], axis=2)
        col = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2)
        col = col.reshape(len(x), WINDOW - WIDTH + 1, -1)
        a = np.maximum(col @ self.p["conv"] + self.p["bias"], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(axis=1)], axis=1)
        return chars, col, a, top, pooled, pooled @ self.p["out"] + self.p["shift"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3):
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            self.epoch(x, y, float(y.mean()), r)
        return self

    def epoch(self, x: np.ndarray, y: np.ndarray, share: float, r: np.random.Generator, batch: int = 128, rate: float = 0.004):
        """One pass over all rows; ``share``: the positives among all that is learned from."""
        weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
        for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
            chars, col, a, top, pooled, z = self._forward(x[at])
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
            g = {"out": pooled.T @ d, "shift": d.sum(keepdims=True)}
            dp = d[:, None] * self.p["out"]
            da = np.repeat(dp[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
            np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dp[:, None, :FILTERS], 1)
            da = da * (a > 0)
            g["conv"] = np.tensordot(col, da, ([0, 1], [0, 1]))
            g["bias"] = da.sum(axis=(0, 1))
            dcol = (da @ self.p["conv"].T).reshape(len(at), a.shape[1], WIDTH, EMBED + 1)[..., :EMBED]
            de = np.zeros((len(at), WINDOW, EMBED), np.float32)
            for j in range(WIDTH):
                de[:, j:j + a.shape[1]] += dcol[:, :, j]
            g["embed"] = np.zeros_like(self.p["embed"])
            np.add.at(g["embed"], chars, de)
            self.step += 1
            for k in self.p:
                self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
                self.s[k] = 0.999 * self.s[k] + 0.001 * g[k] ** 2
                self.p[k] = (self.p[k] - rate * (self.m[k] / (1 - 0.9 ** self.step)) / (
                    np.sqrt(self.s[k] / (1 - 0.999 ** self.step)) + 1e-8)).astype(np.float32)

    def state(self) -> np.ndarray:
        """All that learning goes on from, as one vector."""
        return np.concatenate([d[k].ravel() for d in (self.p, self.m, self.s) for k in d] + [[self.step]]).astype(np.float64)

    def resume(self, state: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.m, self.s):
            for k, v in d.items():
                d[k] = state[at:at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
        self.step = int(round(state[at]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The network's output, in steps of 1 / SCORE from -30 to 30."""
        return np.floor(np.clip(self.logits(x), -30, 30) * SCORE).astype(np.int64)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> CharNet:
        rows, n = np.unique(np.stack([self.scores(x), char_class(x), y.astype(np.int64)]), axis=1, return_counts=True)
        return self.calibrate_counted(*rows, n, recall)

    def calibrate_counted(self, score: np.ndarray, kind: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> CharNet:
        """Platt scaling and, for every character class, the highest threshold with that recall,
        raised to the floors of 0.5 and, for classes with fewer than 20 positives, 0.9. ``n``
        windows have the score, class and label."""
        z, part = score / SCORE, n / n.sum()
        a, b = 1.0, 0.0
        for _ in range(500):
            d = (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y) * part
            a, b = a - 0.05 * float(d @ z), b - 0.05 * float(d.sum())
        self.scale, self.offset = a, b
        p = self._probability(score)

        def highest(of):
            q, many = p[of], n[of]
            if not len(q):
                return 1.1
            order = np.argsort(q)
            below = np.cumsum(many[order])
            return float(q[order][np.searchsorted(below, int((1 - recall) * below[-1]), "right")])

        overall = max(0.5, highest(y == 1))
        self.thresholds = np.array([max(0.5, highest(of)) if n[of := (y == 1) & (kind == k)].sum() >= 20 else
                                    max(overall, 0.9) for k in range(4)])
        return self

    def _probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * score / SCORE + self.offset, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._probability(self.scores(x))

    def secret(self, x: np.ndarray) -> np.ndarray:
        return self.probability(x) >= self.thresholds[char_class(x)]


def candidates(codes: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, touched by a base finding) of every candidate."""
    out, k = [], 0
    reach = sorted((s, e) for s, _, e in base)
    for s, e in runs(codes, _TOKEN, MIN_RUN):
        while k < len(reach) and reach[k][1] <= s:
            k += 1
        out.append((s, e, any(a < e and b > s for a, b in reach[k:k + 3])))
    return out


def free_parts(codes: np.ndarray, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of candidates that no base finding covers, from MIN_RUN characters on."""
    k = 0
    reach = sorted((s, e) for s, _, e in base)
    for s, e in runs(codes, _TOKEN, MIN_RUN):
        while k < len(reach) and reach[k][1] <= s:
            k += 1
        j = k
        while j < len(reach) and reach[j][0] < e:
            if reach[j][0] - s >= MIN_RUN:
                yield s, reach[j][0]
            s = max(s, reach[j][1])
            j += 1
        if e - s >= MIN_RUN:
            yield s, e


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(window, label)``: the distinct windows of all candidates of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["window", "label"]
        for b in batches:
            rows = []
            for text in b[0].to_pylist():
                text = text or ""
                codes = code_points(text)
                for s, e, hit in candidates(codes, base_spans(text, codes)):
                    for at in range(s, e, SLICE * BODY):
                        rows += [(w.tobytes(), hit) for w in windows(codes, at, min(e, at + SLICE * BODY))]
                        if len(rows) >= SLICE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                                zip(*rows, strict=True), (pa.binary(), pa.bool_()), strict=True)], names)
                            rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                              pa.array([r[1] for r in rows], pa.bool_())], names)

    return docs.select(F.col(text_col)).mapInArrow(run, "window binary, label boolean").distinct()


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of a shard, in an order of their own."""
    rows = sorted(zip(table["window"].to_pylist(), table["label"].to_pylist(), strict=True))
    return (np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(-1, WINDOW),
            np.array([label for _, label in rows], bool))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_findings: int = SHARD, recall: float = RECALL) -> CharNet | None:
    """A network from all labelled findings of all documents, about ``max_findings`` windows in a
    shard; None only if the documents have no positive or no negative one."""
    found = staged(findings(docs, text_col).withColumn("held", F.pmod(F.xxhash64("window"), F.lit(4)) == 0), "findings")
    n = {(r.label, r.held): r["count"] for r in found.groupBy("label", "held").count().collect()}
    for label in (True, False):
        trains, holds = n.get((label, False), 0), n.get((label, True), 0)
        if not trains + holds:
            return None
        if trains + holds < 4 or not trains or not holds:
            n[label, False] = n[label, True] = trains + holds
            found = found.withColumn("held", F.when(F.col("label") != label, F.col("held")))  # null: on both sides

    def sharded(held: bool) -> DataFrame:
        shards = -(-(n[True, held] + n[False, held]) // max_findings)
        return (found.where(F.coalesce(F.col("held") == held, F.lit(True)))
                .select("window", "label", F.pmod(F.xxhash64("window", F.lit(1)), F.lit(shards)).alias("shard"))
                .repartition(int(shards), "shard").groupBy("shard"))  # by number: tasks of one shard, however few its bytes

    net = CharNet()
    share = 2 * n[True, False] / (2 * n[True, False] + n[False, False])
    for epoch in range(EPOCHS):
        def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            x, y = _arrays(table)
            good, bad = x[y], x[~y]
            moved = good[:0]
            if len(bad):
                other = bad[np.random.default_rng([1, shard]).integers(len(bad), size=len(good))]
                moved = np.where(good >= 128, good, np.where(other < 128, other, 0))
            xs = np.concatenate([good, moved, bad])
            ys = np.r_[np.ones(len(good) + len(moved)), np.zeros(len(bad))].astype(np.float32)
            one = copy.deepcopy(net)
            one.epoch(xs, ys, share, np.random.default_rng([3, epoch, shard]))
            state = np.rint(one.state() * EXACT).astype(np.int64)
            return pa.table({"place": pa.array(range(len(state)), pa.int32()), "value": state})

        total = (sharded(False).applyInArrow(learn, "place int, value bigint")
                 .groupBy("place").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("shards")).collect())
        net.resume(np.array([r.value / r.shards / EXACT for r in sorted(total)]))

    def rate(table: pa.Table) -> pa.Table:
        x, y = _arrays(table)
        return pa.table({"score": net.scores(x), "kind": char_class(x).astype(np.int64), "y": y.astype(np.int64)})

    rated = (sharded(True).applyInArrow(rate, "score bigint, kind bigint, y bigint")
             .groupBy("score", "kind", "y").agg(F.count(F.lit(1)).alias("n")).collect())
    return net.calibrate_counted(*np.array(sorted(rated)).T, recall)


def scan(docs: DataFrame, net: CharNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its findings ``array<struct<kind,start,end>>`` in order."""
    schema = "doc_id bigint, findings array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, pending, at = [], [], []
            for i, text in enumerate(b[1].to_pylist()):
                text = text or ""
                codes = code_points(text)
                base = base_spans(text, codes)
                spans.append(list(base))
                if net is not None:
                    for s, e in free_parts(codes, base):
                        w = windows(codes, s, e)
                        pending.append(w)
                        at += [(i, s, e)] * len(w)
            if pending:
                for i, s, e in sorted({at[j] for j in np.flatnonzero(net.secret(np.concatenate(pending)))}):
                    spans[i].append((s, 3, e))
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([b[0].cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "findings"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""
    f = F.col("findings")

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter(f, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(joined(F.filter(f, lambda s: s["kind"] != "net")), 256).alias("base_sha256"),
                        joined(f).alias("spans"))
