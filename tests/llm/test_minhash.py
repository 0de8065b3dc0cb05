import random

import numpy as np
import pytest

from marlstone.llm import minhash


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent=85):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and d is not None and e is not None and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=3))
    rows = []
    for base in range(12):
        text = [word() for _ in range(r.choice([3, 6, 40, 200, 600]))]
        for c in range(r.randint(1, 8)):
            t = list(text)
            for _ in range(r.randint(0, max(1, len(t) // 60))):
                t[r.randrange(len(t))] = word()
            rows.append((base * 50 + c, r.choice([" ", "\n"]).join(t).upper() if c % 3 == 0 else " ".join(t)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one TWO"), (None, rows[0][1]), (rows[0][0], rows[0][1]), (9005, "É a b c d e"), (9006, "é a b c d e")]
    return rows


def got(df):
    return sorted(map(tuple, minhash.links(df).collect()), key=str)


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_at_eighty(spark):
    rows = corpus(5) + [(7000 + i, " ".join(f"v{j}" if j != 50 or i == 0 else f"e{i}" for j in range(92))) for i in range(3)]  # edits of one word in 92: 83 common of 93
    rows += [(7100 + i, " ".join(f"u{j}" if j != 30 or i == 0 else f"f{i}" for j in range(52))) for i in range(2)]  # 43 common of 53: 0.811
    got80 = sorted(map(tuple, minhash.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80).collect()), key=str)
    assert got80 == brute(rows, 80) and {r[2] for r in got80 if r[0] in (7100, 7101)} == {7100}
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((d for d, _, _, k in set(brute(rows, 80)) if k), key=str)


def test_repeated_rows_of_the_stage(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "w"), (1, "a b c", "w"), (1, "other words", "z"), (None, "n", "p"), (None, "n", "p"), (2, "A b c", "q")]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c", "w"), (1, "other words", "z"), (None, "n", "p"), (None, "n", "p")], key=str)


def test_shapes():
    for percent in (80, 85, 90):
        chunks, slots = minhash.shape(percent)
        p = percent / 100
        assert (1 - p**slots - slots * (1 - p) * p ** (slots - 1)) ** chunks <= 1e-6
    assert minhash.shape(85) == (minhash.CHUNKS, minhash.SLOTS)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    rows = corpus(8)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_large_clusters_that_are_no_group(spark, monkeypatch):
    """Chains and several groups in one coarse cluster: pivots settle a part of them only."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    r = random.Random(3)
    rows, text = [], [f"w{i}" for i in range(150)]
    for i in range(40):  # each a neighbour of the last, drifting away from the first
        rows.append((i, " ".join(text)))
        for _ in range(3):
            text[r.randrange(len(text))] = f"c{i}x{r.randrange(99)}"
    base = [f"u{i}" for i in range(120)]
    for g in range(3):
        own = [f"g{g}" if i % 20 == 0 else w for i, w in enumerate(base)]
        for c in range(9):
            t = list(own)
            t[r.randrange(120)] = f"e{c}"
            rows.append((1000 + 100 * g + c, " ".join(t)))
    rows.append((77, rows[3][1]))
    for percent in (85, 80):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, minhash.links(df, percent).collect()), key=str) == brute(rows, percent)


def test_keys_guarantee():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, (200, minhash.CHUNKS * minhash.SLOTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = r.choice(len(row), 2 * minhash.CHUNKS - 1, replace=False)
        row[at] ^= 1
    x, y = minhash.chunk_keys(a), minhash.chunk_keys(b)
    assert all(set(p.tolist()) & set(q.tolist()) for p, q in zip(x, y))


def test_common_counts():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    lay = lambda s: (np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])]))
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    m = minhash.common_counts(lay(sets), None)
    off = ~np.eye(70, dtype=bool)
    assert (m[off] == want[off]).all()
    assert (minhash.common_counts(lay(sets[:30]), lay(sets[30:])) == want[:30, 30:]).all()


def test_empty_and_stage(spark):
    df = spark.createDataFrame([], "doc_id long, text string, root int, keys string")
    assert got(df) == []
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, lang string, root int")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = [d for d, _, _, k in set(brute(rows)) if k]
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [300])
def test_hot_group(spark, n):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(n)]
    for i in range(n):
        t = list(base)
        t[i % 300] = f"edit{i}"
        rows.append((10_000 + i, " ".join(t)))
    assert {x.component_id for x in minhash.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == {0}


def test_components_with_hot_nodes(spark, monkeypatch):
    from marlstone.llm import graph

    monkeypatch.setattr(graph, "HOT", 5)
    r = random.Random(12)
    old = graph._contract
    for limit, chunk in ((1000, 0), (0, 0), (0, 1 << 20)):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(graph, "CHUNK", chunk)
        monkeypatch.setattr(graph, "_contract", old if chunk else lambda batches: batches)
        edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(7, i) for i in range(400, 450)] + [(i, 900) for i in range(500, 560)]
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(got.get(x, x) == find(x) for x in root)
