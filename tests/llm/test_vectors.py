import numpy as np

from marlstone.llm import vectors as V


def brute(rows):
    ok = lambda e, l: l is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    n = len(rows)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i, (a, e, l) in enumerate(rows):
        for j, (b, f, m) in enumerate(rows):
            if i != j and a is not None and b is not None and ok(e, l) and ok(f, m) and l == m and len(e) == len(f):
                x, y = np.array(e, float), np.array(f, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i] += 1
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return sorted(((a, k, None if a is None else find(a), a is None or find(a) == a) for (a, _, _), k in zip(rows, links)), key=str)


def corpus(seed, n=160, dim=6):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    rows = []
    for i in range(n):
        x = base[r.integers(12)] + r.normal(size=dim) * r.choice([0.0, 0.05, 0.2, 1.0])
        rows.append((int(i * 7 % 1000), [float(np.float32(v)) for v in x * r.choice([1, 3])], int(r.integers(3)) if r.random() < 0.9 else None))
    one = rows[0][1]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [float("nan")] + one[1:], 1), (2004, [float("inf")] + one[1:], 1), (2005, [None] + one[1:], 1), (None, one, 0), (2006, one[:3], rows[0][2]), (2007, one[:3], rows[0][2]), rows[0], rows[0]]
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string").repartition(3)
    assert sorted(map(tuple, V.links(df).collect()), key=str) == brute(rows)


def test_against_brute_force(spark, monkeypatch):
    check(spark, corpus(0))
    monkeypatch.setattr(V, "CELL", 6)
    monkeypatch.setattr(V, "BLOCK", 20)
    check(spark, corpus(1))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.links(df).count() == 0


def test_one_id_with_several_vectors_and_long_vectors(spark, monkeypatch):
    r = np.random.default_rng(8)
    a, b = r.normal(size=(2, 5)).tolist()
    rows = [(1, a, 0), (1, b, 1), (2, [x * 2 for x in a], 0), (3, b, 1), (3, a, 0), (4, b, 1), (1, a, 0)]
    wide = r.normal(size=5000)
    rows += [(20 + i, (wide + 0.1 * i * r.normal(size=5000)).tolist(), 0) for i in range(6)]
    monkeypatch.setattr(V, "CELL", 2)
    monkeypatch.setattr(V, "BLOCK", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, V.links(df).collect()), key=str) == brute(rows)


def test_visits_grow_with_the_rows():
    """Rows that travel to a comparison, at two sizes of a label in one block."""
    r = np.random.default_rng(1)
    sent = []
    for n in (1000, 5000):
        x = V.unit(r.normal(size=(n, 64)))
        c = V.k_means(x, max(2, -(-n // V.CELL)))
        sent.append(n + int(V.visits(x, c, V.COSINE)[1].sum()))
    assert np.log(sent[1] / sent[0]) / np.log(5) < 1.1


def test_visits_miss_nothing():
    r = np.random.default_rng(2)
    x = V.unit(np.repeat(r.normal(size=(300, 8)), 4, axis=0) + 0.12 * r.normal(size=(1200, 8)))
    c = V.k_means(x, 40)
    home, seen = V.visits(x, c, 0.93)
    p, q = np.nonzero(x @ x.T >= 0.93)
    assert seen[p, home[q]].all() and seen.mean() < 0.9
