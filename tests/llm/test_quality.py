import random
import zlib

import numpy as np

from marlstone.llm import quality as Q


def corpus(n, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(r.randint(20, 200))]
        good = r.random() < 0.7
        text = " ".join(words) if good else r.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 80), " ".join(w + "###" for w in words)])
        docs.append((i, text, "x"))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900)
    docs += [(10_000, None, "x"), (10_001, "", "x"), (None, docs[0][1], "x"), (0, docs[0][1], "x"), (10_002, "word " * 200_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (99_999, 0), labels[3]], "doc_id long, quality int")
    got = {(r.doc_id, r.held_out, r.score, r.predicted) for r in Q.score(df, lab).collect()}
    by = {r[0]: r for r in got}
    for d, held, score, pred in got:
        assert 0 <= score <= 1 and pred == (score >= Q.THRESHOLD)
        assert held == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)
    assert by[None][2] == by[0][2] and by[10_000][2] == by[10_001][2]
    test = [(by[i][3], y) for i, y in labels if by[i][1]]
    assert sum(a == b for a, b in test) / len(test) > 0.93
    kept = Q.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(1 for d in docs if by[d[0]][3] == 1)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(df, lab).first().score == 0.5
    assert Q.score(df.limit(0), lab).count() == 0


def plain(net, text):
    """The network's definition, one number at a time."""
    byte = lambda i: text[i] if i < len(text) else 0
    gram = lambda i: [byte(i + k) for k in range(4)]
    steps = -(-len(text) // Q.STEP)

    def inputs(step):
        out = []
        for i in range(step * Q.STEP, (step + 1) * Q.STEP):
            seen = byte(i) != 0 and any(i >= lag and gram(i) == gram(i - lag) for lag in Q.LAGS)
            out += [*map(float, net.E[byte(i)]), float(seen)]
        return np.array(out)

    xs = [inputs(s) for s in range(steps + 1)]
    acts = [np.maximum(xs[s] @ net.W[0].astype(float) + xs[s + 1] @ net.W[1].astype(float) + net.B, 0) for s in range(steps)]
    tops = np.zeros(Q.FILTERS)
    blocks = [acts[a : a + Q.BLOCK] for a in range(0, steps, Q.BLOCK)]
    for k in range(max(1, len(blocks) - 1)):
        chunk = [a for block in blocks[k : k + 2] for a in block]
        if chunk:
            tops = np.maximum(tops, np.mean(chunk, axis=0))
    return 1 / (1 + np.exp(-(tops @ net.V.astype(float) + float(net.c[0]))))


def test_scores_are_those_of_the_definition():
    docs, _ = corpus(12, 3)
    net = Q.Net(3)
    raw = [d[1].encode() for d in docs] + [b"", b"a", b"abc\0abc", b"xy" * 40, b"z" * 255, b"z" * 256, b"q w " * 200, "é🙂".encode() * 50]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    whole = net.double().score(np.frombuffer(b"".join(raw), np.uint8), offs)
    for x, s in zip(raw, whole):
        assert abs(plain(net, x) - s) < 1e-6


def test_grouping_does_not_change_scores():
    docs, _ = corpus(40, 3)
    net = Q.Net(3).double()
    raw = [d[1].encode() for d in docs]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    whole = net.score(np.frombuffer(b"".join(raw), np.uint8), offs)
    back = net.score(np.frombuffer(b"".join(raw[::-1]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw[::-1]])]))
    for x, s, t in zip(raw, whole, back[::-1]):
        assert net.score(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] == s == t


def test_segments_do_not_change_scores(monkeypatch):
    r = np.random.default_rng(4)
    net = Q.Net(5).double()
    for n in (4096, 4097, 9001, 60_000, 60_003):
        text = np.where(r.random(n) < 0.5, np.tile(r.integers(97, 110, 23), n // 23 + 1)[:n], r.integers(97, 122, n)).astype(np.uint8)
        monkeypatch.setattr(Q, "SEGMENT", 1 << 16)
        whole = net.forward(text, np.array([0, n]))[1][0]
        for size in (64, 128, 1024):
            monkeypatch.setattr(Q, "SEGMENT", size)
            assert np.allclose(net._long(text), whole, rtol=0, atol=1e-12)
    long = np.frombuffer(b"the same words again " * 500_000, np.uint8)  # 10 MB
    monkeypatch.setattr(Q, "SEGMENT", 1 << 16)
    assert 0 <= net.score(long, np.array([0, len(long)]))[0] <= 1


def test_gradients():
    r = np.random.default_rng(0)
    data = r.integers(32, 120, 3000).astype(np.uint8)
    offs, y, w = np.array([0, 900, 900, 3000]), np.array([1.0, 0.0, 0.0], np.float32), np.ones(3, np.float32)
    net = Q.Net(1)

    def loss():
        z = net.forward(data, offs)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.gradients(data, offs, y, w)
    for k, at in ((1, (0, 5, 3)), (1, (1, 9, 7)), (2, (4,)), (3, (2,)), (4, (0,)), (0, (65, 2))):
        p, eps = net.weights()[k], 1e-2
        old = p[at]
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 5e-3 + 0.1 * abs(g[k][at])
