import hashlib
import random

import numpy as np

from marlstone.llm.debruijn import dedup_words
from marlstone.llm.suffixes import dedup_bytes


def brute_words(rows, length):
    windows = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            windows[k] = min(windows.get(k, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - length + 1):
            if windows[tuple(w[s : s + length])] < (i, s):
                gone.update(range(s, s + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(rows, length):
    first = {}
    split = [(i, (t or "").encode()) for i, t in rows]
    for i, b in split:
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in split:
        gone = [False] * (len(b) + 1)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        runs = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "délta", "e", "!!", "zeta"]
    passages = [" ".join(r.choices(vocab, k=r.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choices(vocab, k=r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        text = r.choice([" ", "\n", "  \t"]).join(parts)
        if r.random() < 0.3:
            cut = r.randint(0, len(text))
            text = text[cut:] + "x" + text[:cut]
        rows.append((i * 3 % 1009, text))
    rows += [(2000, "same same " * 60), (2001, "same same " * 80), (2002, ""), (2003, None), (2004, "a" * 400), (2005, "b" + "a" * 300)]
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, dedup_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == brute_words(rows, 20)
    got = sorted(map(tuple, dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == brute_bytes(rows, 50)


def test_against_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed))


def test_small_windows(spark):
    rows = corpus(9, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, dedup_words(df, length=3, gram=2).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == brute_words(rows, 3)


def test_hot_copies(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base) for i in range(150)] + [(500 + i, base + f" tail{i}") for i in range(50)]
    check(spark, rows)


def test_slices_of_a_long_text(spark, monkeypatch):
    import numpy as np

    from marlstone.llm import contexts as X, kernel

    r = random.Random(5)
    text = " ".join(r.choices([f"w{i}" for i in range(40)], k=30000)).encode()
    data = np.frombuffer(text, np.uint8)
    v = kernel._T[data]
    whole = X.contexts(v, np.array([0, len(v)]), 50, 20)
    monkeypatch.setattr(X, "SLICE", 10000)
    parts = X.contexts(v, np.array([0, len(v)]), 50, 20)
    expand = lambda c: sorted((s, a) for s0, n, a in zip(c.start, c.count, c.anchor) for s in range(s0, s0 + n))
    assert expand(whole) == expand(parts)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, open int")
    assert dedup_words(empty).count() == 0 and dedup_bytes(empty).count() == 0
    t = "one two three " * 30
    rows = [(1, t, "x", None), (1, t, "y", 2), (None, t, None, None), (2, None, None, None), (3, "short", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, open int")
    got = [tuple(x) for x in dedup_bytes(df).select("doc_id", "n_removed").collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 0), (2, 0), (3, 0)], key=str)
    words = {(x.doc_id, x.n_words, x.n_removed) for x in dedup_words(df).collect()}
    assert words == {(1, 90, 87), (None, 90, 0), (2, 0, 0), (3, 1, 0)}


def test_multikey():
    from marlstone.llm.suffixes import multikey

    r = np.random.default_rng(3)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    text[500:900] = text[1500:1900]
    text[2000:2300] = 97
    raw = text.tobytes()
    pos = r.permutation(4000 - 50)[:3000]
    for length in (3, 8, 20, 50):
        order, new = multikey(text, pos, length)
        got = [raw[p : p + length] for p in pos[order]]
        assert got == sorted(got)
        assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_boundaries_through_equal_strings(spark, monkeypatch):
    """One anchor in many contexts, and splitters that part their suffixes."""
    from marlstone.llm import suffixes

    r = random.Random(4)
    word = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    core = word(34)
    rows = []
    for i in range(120):
        left, right = r.choice(lefts) if i > 10 else word(16), r.choice(rights) if i > 10 else word(16)
        lefts, rights = ([left] if i == 0 else [*lefts, left]), ([right] if i == 0 else [*rights, right])
        rows.append((i, word(40) + left + core + right + word(40)))
    cut = []
    old = suffixes.splitters

    def fine(df, n, length, gram):
        got = old(df, 64, length, gram)
        cut.append(got)
        return got

    monkeypatch.setattr(suffixes, "splitters", fine)
    monkeypatch.setattr(suffixes, "keys", lambda df: 64)
    parted = []
    strings = suffixes._strings
    monkeypatch.setattr(suffixes, "_strings", lambda length: (parted.append(length), strings(length))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == brute_bytes(rows, 50)
    assert parted and len(cut[0]) == 63 and len({x[:20] for x in cut[0]}) < 40  # boundaries lie within one anchor
