import zlib

import numpy as np
import pytest

from marlstone.llm import packing
from marlstone.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


def test_cut_encoding_equals_whole(tok):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    texts += ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\nx y", "x  y", "don't it's  'll", "<|endoftext|> x<|endoftext|>y", "ünï 123 45,6 🙂 🙂x", "tab\t tab", "x  y", "a\x1c b \x85c", "1 2 3", "..., !? a"]
    for ranks, k in [(r, k) for r in (None, packing.vocabulary("byte_bpe_50k.tiktoken")) for k in range(0, len(texts), 40)]:
        if not k:
            enc = Encoder(packing.vocabulary(), ranks, kept=500)
        got = enc.encode(texts[k : k + 40])
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts[k : k + 40]]


def check(spark, rows, tok, best=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack(packing.pieces(df, with_ids=True)).collect()
    want = []
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        head = n % 1024 or 1024
        cuts = [0, *range(head, n, 1024), n]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    counts = np.bincount([r.length for r in got], minlength=1025)
    assert packing.lower_bound(counts) <= len(seqs) <= packing.lower_bound(counts) + (best or 1)


def test_packs_all(spark, tok):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = [(i, x, "") for i, x in zip(t["doc_id"], t["text"])]
    rows += [(7, "same", ""), (7, "same", ""), (None, "x", ""), (8, None, ""), (9, "", ""), (10, "word " * 9000, "")]
    check(spark, rows, tok)


def test_rounds(spark, tok, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PARTITION", 20)
    check(spark, [(i, "a b c " * (7 + i * 37 % 130), "") for i in range(300)], tok, best=4)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(df)).count() == 0


def test_bound_is_below_any_packing():
    r = np.random.default_rng(3)
    for _ in range(200):
        c = int(r.integers(5, 60))
        sizes = r.integers(1, c + 1, int(r.integers(1, 40)))
        seq, offs, fill = packing.best_fit(sizes, c)
        assert fill.max() <= c and fill.sum() == sizes.sum()
        assert packing.lower_bound(np.bincount(sizes, minlength=c + 1)) <= len(fill)
    assert packing.lower_bound(np.bincount([6] * 10, minlength=11)) == 10


def test_best_fit_exact_on_small_cases():
    from functools import lru_cache

    def optimum(sizes, c):
        sizes = tuple(sorted(sizes, reverse=True))

        @lru_cache(None)
        def fits(k, rooms):
            if k == len(sizes):
                return True
            return any(fits(k + 1, tuple(sorted((*rooms[:i], r - sizes[k], *rooms[i + 1 :])))) for i, r in enumerate(rooms) if r >= sizes[k] and (not i or rooms[i - 1] != r))

        n = 1
        while not fits(0, (c,) * n):
            n += 1
        return n

    r = np.random.default_rng(1)
    for _ in range(40):
        sizes = r.integers(1, 11, 8)
        low = packing.lower_bound(np.bincount(sizes, minlength=11))
        best = optimum(sizes.tolist(), 10)
        assert low <= best <= len(packing.best_fit(sizes, 10)[2]) <= best + 1


def test_best_fit_is_that_of_its_definition():
    r = np.random.default_rng(5)
    for _ in range(60):
        c = int(r.integers(5, 200))
        sizes = r.integers(1, c + 1, int(r.integers(1, 120)))
        rooms, want = [], []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [x for x in rooms if x >= s]
            if fits:
                rooms[rooms.index(min(fits))] -= s
            else:
                rooms.append(c - s)
        assert sorted(c - x for x in rooms) == sorted(packing.best_fit(sizes, c)[2].tolist())
