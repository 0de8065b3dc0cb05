"""Quality scores by a byte-level convolutional network, written in numpy.

Every byte has a learned embedding and one more channel that says whether its 4-gram stood within the last few dozen
bytes. Learned filters of 8 bytes slide over the whole text, 4 bytes at a time; their rectified outputs are averaged
over overlapping chunks of 512 bytes, the largest average over all chunks is taken for each filter, and a logistic unit
combines these maxima into one probability. Nothing else of a row enters a score.

The network is fitted on the driver on at most TRAIN_DOCS labelled rows (of those whose text has at most TRAIN_BYTES bytes,
those with the smallest hashes of their ids) that aren't held out: a sample whose size does not grow. Scoring covers
every byte of every text; one of any length is taken in segments that see what lies beside them, so segments and neighbours
in a batch change nothing. Scores are computed in double precision and rounded to six places, so repeated rows get equal scores,
ties included. Null texts are empty; an empty text has all maxima 0. A null doc_id is kept (held_out false). Of several labels of
one doc_id the lowest counts. Without usable labels every score is the prior, 0.5. An empty table gives an empty result. Extra
columns are ignored by ``score`` and returned by ``keep_good``, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import kernel
from marlstone.llm.session import prepare, table

TRAIN_DOCS = 1600
TRAIN_BYTES = 1 << 13
THRESHOLD = 0.3
D, FILTERS, STEP, BLOCK = 7, 24, 4, 64
LAGS = range(3, 29)
EPOCHS, RATE, BATCH = 5, 0.02, 32
PLACES = 6
#: steps of a long text that are taken at once, whole blocks
SEGMENT = 1 << 16


def layout(data: np.ndarray, offsets: np.ndarray):
    """Texts padded to whole steps: (bytes, recurrence, first step of each text)."""
    size = np.diff(offsets)
    steps = -(-size // STEP)
    first = np.concatenate([[0], np.cumsum(steps + 1)])  # one empty step between texts
    x = np.zeros(int(first[-1]) * STEP, np.uint8)
    x[kernel.spans(first[:-1] * STEP, size)] = data
    again = np.zeros(len(x), bool)
    inside = np.zeros(len(x), np.int32)  # a byte's place in its text: what stood before belongs to another
    inside[kernel.spans(first[:-1] * STEP, size)] = kernel.spans(np.zeros(len(size), np.int64), size)
    if len(x) > 3:
        g = x[:-3].astype(np.uint32) | (x[1:-2].astype(np.uint32) << 8) | (x[2:-1].astype(np.uint32) << 16) | (x[3:].astype(np.uint32) << 24)
        for lag in LAGS:
            if len(g) > lag:
                again[lag : len(g)] |= (g[lag:] == g[:-lag]) & (inside[lag : len(g)] >= lag)
        again &= x != 0
    return x, again, first, steps


class Net:
    """Weights: E embeddings, W filters over two neighbouring steps, B their biases, V and c the logistic unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.E = (r.normal(size=(256, D)) * 0.5).astype(np.float32)
        self.W = (r.normal(size=(2, STEP * (D + 1), FILTERS)) * 0.2).astype(np.float32)
        self.B = np.zeros(FILTERS, np.float32)
        self.V = (r.normal(size=FILTERS) * 0.3).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def weights(self):
        return [self.E, self.W, self.B, self.V, self.c]

    def double(self) -> Net:
        out = Net.__new__(Net)
        out.E, out.W, out.B, out.V, out.c = (w.astype(np.float64) for w in self.weights())
        return out

    def act(self, x: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, rectified filter outputs) of each step."""
        wide = np.zeros((256, D + 1), self.E.dtype)
        wide[:, :D] = self.E
        h = np.take(wide, x, axis=0)
        h[:, D] = again
        h = h.reshape(-1, STEP * (D + 1))
        act = h @ self.W[0]
        act[:-1] += h[1:] @ self.W[1]
        act += self.B
        np.maximum(act, 0, out=act)
        return h, act

    def forward(self, data: np.ndarray, offsets: np.ndarray):
        x, again, first, steps = layout(data, offsets)
        n = len(steps)
        h, act = self.act(x, again)
        some = steps > 0
        blocks = np.where(some, -(-steps // BLOCK), 0)
        start = np.repeat(first[:-1], blocks) + BLOCK * kernel.spans(np.zeros(n, np.int64), blocks)
        row = np.repeat(np.arange(n), blocks)
        size = np.minimum(BLOCK, np.repeat(first[:-1] + steps, blocks) - start)
        top = np.zeros((n, FILTERS), act.dtype)
        arg = np.zeros((n, FILTERS), np.int64)
        if len(start):
            ends = start + size
            cut = np.stack([start, ends], 1).ravel()
            sums = np.add.reduceat(np.concatenate([act, np.zeros((1, FILTERS), act.dtype)]), cut, axis=0)[::2]
            pair = np.append(row[1:] == row[:-1], False)
            both, count = sums.copy(), size.astype(act.dtype)
            nxt = np.flatnonzero(pair)
            both[nxt] += sums[nxt + 1]
            count = count.copy()
            count[nxt] += size[nxt + 1]
            mean = both / count[:, None]
            last = ~pair & np.append(False, row[1:] == row[:-1])  # a text's last block is in the chunk before
            mean[last] = -1
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            top[row[at]] = np.maximum.reduceat(mean, at, axis=0)
            if n <= 4 * BATCH:
                for i, (a, z) in zip(row[at].tolist(), zip(at.tolist(), np.append(at[1:], len(row)).tolist(), strict=True), strict=True):
                    arg[i] = a + mean[a:z].argmax(0)
            np.maximum(top, 0, out=top)
            state = (x, h, act, start, size, pair, count, arg, some)
        else:
            state = None
        return top @ self.V + self.c, top, state

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rounded probabilities; a text of more than SEGMENT steps is to be given alone."""
        if len(offsets) == 2 and len(data) > SEGMENT * STEP:
            z = self._long(data) @ self.V + self.c
        else:
            z = self.forward(data, offsets)[0]
        return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), PLACES)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Maxima of one long text: block sums segment by segment, each with the bytes beside it that its own steps look at."""
        n = -(-len(data) // STEP)
        before, after = -(-LAGS.stop // STEP) * STEP, 2 * STEP
        sums, size = [], []
        for lo in range(0, n, SEGMENT):
            hi = min(n, lo + SEGMENT)
            a = max(0, lo * STEP - before)
            part = data[a : min(len(data), hi * STEP + after)]
            x, again, _, _ = layout(part, np.array([0, len(part)]))
            act = self.act(x, again)[1][lo - a // STEP : hi - a // STEP]
            starts = np.arange(0, hi - lo, BLOCK)
            sums.append(np.add.reduceat(act, starts, axis=0))
            size.append(np.minimum(BLOCK, hi - lo - starts))
        sums, size = np.concatenate(sums), np.concatenate(size)
        mean = (sums[:-1] + sums[1:]) / (size[:-1] + size[1:])[:, None]
        return np.maximum(mean.max(0), 0)

    def gradients(self, data, offsets, y, weight):
        z, top, state = self.forward(data, offsets)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - y) * weight / len(y)).astype(np.float32)
        gV, gc = top.T @ dz, np.array([dz.sum()], np.float32)
        if state is None:
            return [np.zeros_like(self.E), np.zeros_like(self.W), np.zeros_like(self.B), gV, gc]
        x, h, act, start, size, pair, count, arg, some = state
        dtop = dz[:, None] * self.V[None, :]
        at = np.flatnonzero(some)
        k, f = arg[at], np.broadcast_to(np.arange(FILTERS), (len(at), FILTERS))
        share = (dtop[at] / count[k]).astype(act.dtype)
        of_block = np.zeros((len(start), FILTERS), act.dtype)
        np.add.at(of_block, (k, f), share)
        two = pair[k]
        np.add.at(of_block, (k[two] + 1, f[two]), share[two])
        dact = np.zeros_like(act)
        dact[kernel.spans(start, size)] = np.repeat(of_block, size, axis=0)
        dact *= act > 0
        gW = np.stack([h.T @ dact, h[1:].T @ dact[:-1]])
        dh = dact @ self.W[0].T
        dh[1:] += dact[:-1] @ self.W[1].T
        dh = dh.reshape(-1, D + 1)[:, :D]
        gE = np.stack([np.bincount(x, weights=dh[:, k], minlength=256) for k in range(D)], 1).astype(np.float32)
        gE[0] = 0
        return [gE, gW.astype(np.float32), dact.sum(0), gV, gc]


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Net:
    """Adam on the log loss; both classes weigh half of it, up to a factor of 4."""
    net = Net(seed)
    y = np.asarray(labels, np.float32)
    if not len(y):
        net.V[:] = 0
        return net
    share = float(np.clip(y.mean(), 0.01, 0.99))
    low = min(4.0, max(1.0, share / (1 - share)))
    weight = np.where(y == 0, low, 1.0).astype(np.float32)
    net.c[:] = np.log(share / (1 - share) / low)
    r = np.random.default_rng(seed)
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    t, total = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            part = [texts[i] for i in pick]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
            g = net.gradients(np.frombuffer(b"".join(part), np.uint8), offs, y[pick], weight[pick])
            t += 1
            rate = RATE * min(1.0, t / 20, 2 * (1 - t / (total + 1)) + 0.05)
            for w, gw, mw, vw in zip(net.weights(), g, m, v, strict=True):
                mw += 0.1 * (gw - mw)
                vw += 0.01 * (gw * gw - vw)
                w -= (rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> Net:
    """Fit on at most ``sample`` documents with a label; ``labels``: doc_id, quality."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    text = docs.select("doc_id", "text").where(F.octet_length("text").between(1, TRAIN_BYTES))
    ids = text.select("doc_id").join(ids, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # at most ``sample`` rows
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in ids], "doc_id long, quality int")
    rows = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = sorted(rows.collect())  # bounded: sample * TRAIN_BYTES
    return fit([r.text.encode() for r in rows], np.array([r.quality for r in rows]))


def _score(net: Net):
    net = net.double()

    def run(batches):
        for b in batches:
            data, offs = kernel.buffers(b.column(b.schema.get_field_index("text")))
            out = np.empty(b.num_rows, np.float64)
            for lo, hi in kernel.groups(offs, 1 << 18):
                out[lo:hi] = net.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield b.append_column("score", pa.array(out))

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.mapInArrow(_score(train(docs, labels, sample)), "doc_id long, text string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    prepare(docs.sparkSession)
    one = _score(train(docs, labels, sample))

    def run(batches):
        for b in batches:
            s = next(one(iter([b]))).column(b.num_columns)
            yield b.filter(pa.array(s.to_numpy() >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", True), table(spark, sf_dir, "labels"))
