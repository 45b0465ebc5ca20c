"""The network of the secret scan is learned from every finding of every document."""

import numpy as np


def _learned(net):
    return [*net.p["out"].tolist(), net.scale, net.offset]


def test_secret_network_learns_from_every_finding(spark):
    from ledgerspark.llm.secret_cnn import train

    r = np.random.default_rng(4)
    hexes = [(k, "key " + "".join(r.choice(list("0123456789abcdef"), 40))) for k in range(30)]
    words = [(100 + k, "see " + "".join(r.choice(list("etaoinshr"), 24))) for k in range(30)]
    docs = spark.createDataFrame(hexes + words, "doc_id long, text string").coalesce(2).cache()
    whole = _learned(train(docs, max_findings=6))
    assert whole == _learned(train(docs.repartition(3), max_findings=6))
    for k in (1, 17, 102, 125):  # no document may go without a trace, however few findings a shard holds
        assert _learned(train(docs.where(f"doc_id <> {k}"), max_findings=6)) != whole
    docs.unpersist()


def test_secret_findings_hold_every_window_of_a_long_run(spark):
    from ledgerspark.llm.secret_cnn import BODY, code_points, findings, windows

    r = np.random.default_rng(5)
    long = "".join(r.choice(list("0123456789abcdef"), 9 * BODY + 7))
    text = f"a {long} b some_plain_words_here c"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    got = {(bytes(w.window), w.label) for w in findings(docs).collect()}
    codes, at = code_points(text), text.index("some_")
    want = {(w.tobytes(), True) for w in windows(codes, 2, 2 + len(long))}
    want |= {(w.tobytes(), False) for w in windows(codes, at, at + 21)}
    assert got == want and len(want) == 11


def test_secret_counted_calibration_equals_rows():
    from ledgerspark.llm.secret_cnn import CharNet, char_class, code_points, windows

    r = np.random.default_rng(6)
    texts = ["".join(r.choice(list(a), 20)) for a in ("0123456789abcdef", "etaoinshr") for _ in range(200)]
    x = np.concatenate([windows(code_points(f"some {w} text"), 5, 25) for w in texts])
    y = np.r_[np.ones(200), np.zeros(200)]
    net = CharNet().fit(x, y.astype(np.float32)).calibrate(x, y, 0.9)
    p, kind = net.probability(x), char_class(x)
    q = np.sort(p[(y == 1) & (kind == 1)])
    assert net.thresholds[1] == max(0.5, q[int((1 - 0.9) * len(q))])
