import random

from marlstone.llm import decontaminate as D


def plain_tokens(text):
    """The same canonical tokens, one character at a time."""
    raw = (text or "").encode()
    out, cur, start_ok, gap, i = [], b"", True, b"", 0
    runs = []
    while i < len(raw):
        if D._LETTER[raw[i]]:
            j = i
            while j < len(raw) and D._LETTER[raw[j]]:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    lowered = lambda w: "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in w)
    inner, at = set(), 0
    for k, (a, b) in enumerate(runs):
        w, gap = raw[a:b].decode(), raw[at:a]
        begins = k == 0 or any(c in gap for c in b"\n!.?")
        cap = "A" <= w[0] <= "Z" or ("À" <= w[0] <= "Þ" and w[0] != "×")
        known = lowered(w) in D.NUMBER_WORDS.split() + D.UNIT_WORDS.split()
        if cap and not begins and len(w) > 1 and not "A" <= w[1] <= "Z" and not known:
            inner.add(lowered(w))
        at = b
    prev_end, prev = 0, None
    for k, (a, b) in enumerate(runs):
        word = raw[a:b].decode()
        low = "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in word)
        gap = raw[prev_end:a]
        begins = k == 0 or any(c in gap for c in b"\n!.?")
        upper = lambda c: "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×")
        shout = len(word) > 1 and "A" <= word[1] <= "Z"
        if word[0].isdigit() and word[0].isascii() or low in D.NUMBER_WORDS.split():
            kind = "num"
        elif low in D.UNIT_WORDS.split():
            kind = "unit"
        elif upper(word[0]) and not begins and not shout and len(word) > 1:
            kind = "name"
        elif upper(word[0]) and not shout and begins and len(word) > 0 and low in inner:
            kind = "name"
        else:
            kind = ""
        digit = word[0].isascii() and word[0].isdigit()
        drop = prev is not None and ((gap in (b".", b",") and digit and prev[1]) or (kind == "name" and prev[0] == "name"))
        if not drop:
            out.append((kind or low, low))
        prev, prev_end = (kind, digit), b
    return out


def brute(docs, items, share=0.8):
    out = set()
    for i, q in items:
        if i is None or q is None or not plain_tokens(q):
            continue
        tq = plain_tokens(q)
        win = lambda t: [tuple(x[0] for x in t[k : k + 5]) for k in range(len(t) - 4)] if len(t) >= 5 else [tuple(x[0] for x in t)] * bool(t)
        wq = win(tq)
        for d, text in docs:
            if d is None:
                continue
            td = plain_tokens(text)
            wd = win(td)
            hits = sorted((p - k, p, k) for k, x in enumerate(wq) for p, y in enumerate(wd) if x == y)
            width = max(5, len(tq) // 4)
            for n, (s, _, _) in enumerate(hits):
                part = [h for h in hits[n:] if h[0] <= s + width]
                if len({wq[k] for _, _, k in part}) < share * len(set(wq)):
                    continue
                at = {}
                for _, p, k in part:
                    for o in range(min(5, len(tq))):
                        at.setdefault(k + o, p + o)
                pairs = {}
                for k, p in at.items():
                    if tq[k][0] in ("num", "unit", "name"):
                        pairs.setdefault(tq[k][1], []).append(td[p][1])
                total = sum(map(len, pairs.values()))
                if sum(max(v.count(x) for x in v) for v in pairs.values()) >= share * total:
                    out.add((d, i))
                    break
    return out


ITEMS = [
    (1, "A train leaves the old station at 40 km per hour and Maria Lopez waits 3 hours for the second train. Maria Lopez has 3 coins."),
    (2, "short item"), (3, None), (None, "nobody owns this text at all"), (4, "..."), (5, "the river of the north flows past the hill and the town of the king, it is said."),
    (6, "3 of 3 and 3 of 3 and 5 of 5 and 5 of 5 end here"),
]
DOCS = [
    (1, "intro words. A TRAIN LEAVES THE OLD STATION AT 40 KM PER HOUR and Maria Lopez waits 3 hours for the second train. Maria Lopez has 3 coins. end"),
    (2, "A train leaves the old station at 75 miles per hour and Ana waits 9 hours for the second train. Ana has 9 coins."),
    (3, "A train leaves the old station at 75 miles per hour and Ana waits 9 hours for the second train. Bob has 8 coins."),
    (4, "The river of the north FLOWS past the hill, and the town of the king it is said"), (5, None), (6, ""), (7, "nothing here " * 30),
    (8, "a short item"), (None, "short item"), (9, "x short. item y 3.5 4,5 1 2"), (10, "the river of the south flows by a hill and some town of a king"),
    (12, "8 of 8 and 8 of 8 and 9 of 9 and 9 of 9 end here"), (13, "1 of 2 and 3 of 4 and 6 of 7 and 8 of 9 end here"),
]


def test_tokens_equal_a_plain_reading():
    r = random.Random(1)
    texts = [t or "" for _, t in DOCS + ITEMS] + ["".join(r.choices(["Ab", "É", "Ñandú", "3", ".", ",", " ", " ", "two", "km", "!", "x", "\n", "THE", "é"], k=40)) for _ in range(400)]
    t = D.tokens(*D.laid(texts))
    names = {int(D.NUM): "num", int(D.UNIT): "unit", int(D.NAME): "name"}
    import numpy as np

    from marlstone.llm import kernel

    for i, text in enumerate(texts):
        want = plain_tokens(text)
        a, b = t.first[i], t.first[i + 1]
        assert b - a == len(want), text
        hashed = lambda w: int(kernel.word_hashes(np.frombuffer(w.encode(), np.uint8), kernel.Words(np.array([0]), np.array([len(w.encode())]), None))[0])
        assert [names.get(int(c), int(c)) for c in t.code[a:b]] == [w if w in ("num", "unit", "name") else hashed(w) for w, _ in want], text


def test_against_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, item_id string").repartition(3)
    want = brute(DOCS, ITEMS)
    assert {(1, 1), (2, 1), (4, 5), (12, 6)} <= want and (13, 6) not in want
    for bound in (D.BROADCAST_WINDOWS, 0):
        assert {(r.doc_id, r.item_id) for r in D.matches(docs, items, broadcast_windows=bound).collect()} == want
    changed = {(r.doc_id, r.item_id): r.n_changed for r in D.matches(docs, items).collect()}
    assert changed[1, 1] == 0 and changed[2, 1] > 0


def test_random_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["the", "of", "Rome", "Ana", "7", "12", "km", "runs", "sees", "old", "hill.", "and", "two"]
    items = [(k, " ".join(r.choices(vocab, k=r.randint(3, 25)))) for k in range(15)]
    docs = []
    for d in range(60):
        parts = [" ".join(r.choices(vocab, k=r.randint(0, 15)))]
        text = items[r.randrange(15)][1]
        parts.append(text.replace("Rome", r.choice(["Rome", "Oslo"])).replace("7", r.choice(["7", "31"])) if r.random() < 0.7 else " ".join(r.choices(vocab, k=30)))
        docs.append((d, " ".join(parts)))
    want = brute(docs, items)
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_stage(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, item_id string")
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - len({d for d, _ in brute(DOCS, ITEMS)})
    assert D.matches(docs.limit(0), items).count() == 0 and D.matches(docs, items.limit(0)).count() == 0


def test_copy_behind_a_table_of_numbers(spark):
    numbers = lambda n: " ".join(str(k) for k in range(n))
    items = [(1, f"Find the median of {numbers(11)} and report it")]
    docs = [(1, f"{numbers(400)} rows. {items[0][1]}"), (2, f"{numbers(400)} rows"), (3, f"{items[0][1]}. {numbers(400)}")]
    assert brute(docs, items) == {(1, 1), (3, 1)}
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (D.BROADCAST_WINDOWS, 0):
        assert {(r.doc_id, r.item_id) for r in D.matches(docs, items, broadcast_windows=bound).collect()} == {(1, 1), (3, 1)}


def test_texts_that_share_an_item_id(spark):
    items = [(1, ITEMS[0][1]), (1, ITEMS[5][1]), (1, ITEMS[5][1]), (2, ITEMS[6][1])]
    docs = [(1, f"first {ITEMS[0][1]}"), (2, f"then {ITEMS[5][1]}"), (3, "neither of them"), (3, ITEMS[6][1])]
    want = brute(docs, items)
    assert want == {(1, 1), (2, 1), (3, 2)}
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    both = [sorted(map(tuple, D.matches(docs, items, broadcast_windows=bound).collect())) for bound in (D.BROADCAST_WINDOWS, 0)]
    assert both[0] == both[1] and {r[:2] for r in both[0]} == want
