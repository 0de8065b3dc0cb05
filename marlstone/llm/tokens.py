"""Token ids of whole texts by a public byte-level BPE vocabulary, fast enough for a corpus.

The vocabulary's pre-tokenisation always breaks before a single space between two characters that are not white space,
so a text cut at such spaces encodes to the same ids as a whole. Pieces repeat, and each distinct one is encoded
once and kept in a bounded table. Texts where a cut isn't certain (white space beside a space) are encoded whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

from marlstone.llm.kernel import spans


SPECIAL = "<|"


def _fast(ranks_path: str):
    """A second reader of the same vocabulary, faster on plain text; and the bytes of each id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


class Encoder:
    """``path``: the tokenizer's file; ``ranks_path``: the same vocabulary as ranks, used for plain pieces if given.

    Pieces that could hold a special token are always left to the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None, kept: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fast, self.sizes = _fast(ranks_path) if ranks_path else (None, None)
        self.kept = kept
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n = 0
        self.offs = np.zeros(1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with their space, laid end to end, and how many each has."""
        if self.fast is not None and not any(SPECIAL in p for p in pieces):
            flat = np.asarray(self.fast.encode_ordinary("".join(pieces)), np.int64)
            ends = np.cumsum(self.sizes[flat])
            want = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
            upto = np.searchsorted(ends, want) + 1
            if len(ends) and upto[-1] == len(ends) and (ends[upto - 1] == want).all():
                return flat.astype(np.uint32), np.diff(upto, prepend=0)
        ids = [e.ids for e in self.tok.encode_batch(pieces, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, pieces: list[str]) -> None:
        """Add pieces, written with their leading space. One that can't be cut out gets -2."""
        plain, odd = [], []
        for p in pieces:
            if len(p) < 2 or p[1].isspace() or p[-1].isspace():
                self.at[p[1:]] = -2
            elif SPECIAL in p:
                odd.append(p)
            else:
                plain.append(p)
        for good in (plain, odd):
            if not good:
                continue
            ids, sizes = self._ids(good)
            used = int(self.offs[-1])
            if used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * len(ids), np.uint32)])
            self.flat[used : used + len(ids)] = ids
            self.offs = np.append(self.offs, used + np.cumsum(sizes))
            self.at.update(zip((p[1:] for p in good), range(self.n, self.n + len(good)), strict=True))
            self.n += len(good)

    def _heads(self, texts: list[str]) -> list:
        if self.fast is None or any(SPECIAL in t for t in texts):
            return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) for t in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text; give texts of a few MB in all at a time."""
        if self.n > self.kept:
            self._clear()
        split = [t.split(" ") for t in texts]
        heads = self._heads([s[0] for s in split])
        tails = [p for s in split for p in s[1:]]
        idx = np.fromiter(map(self.at.get, tails, repeat(-1)), np.int64, len(tails))
        unknown = np.flatnonzero(idx == -1)
        if len(unknown):
            self._learn([" " + p for p in dict.fromkeys(tails[i] for i in unknown.tolist())])
            get = self.at
            idx[unknown] = [get[tails[i]] for i in unknown.tolist()]
        first = np.concatenate([[0], np.cumsum([len(s) - 1 for s in split])])
        whole = {i for i, s in enumerate(split) if len(s) > 1 and (not s[0] or s[0][-1].isspace())}
        whole.update(np.unique(np.searchsorted(first, np.flatnonzero(idx == -2), "right") - 1).tolist())
        idx = np.maximum(idx, 0)
        size = (self.offs[idx + 1] - self.offs[idx]) if self.n else np.zeros(len(idx), np.int64)
        ids = self.flat[spans(self.offs[idx], size)] if self.n else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        out = [np.concatenate([np.asarray(h, np.uint32), ids[a:b]]) for h, a, b in zip(heads, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        if whole:
            at = sorted(whole)
            for i, e in zip(at, self.tok.encode_batch([texts[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, np.uint32)
        return out
