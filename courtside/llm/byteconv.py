"""A byte-level convolutional network in numpy for document quality.

Input planes: the bytes (one-hot, so a filter is a table of weights per byte and tap) and a recurrence plane,
1 where the four bytes at a place also stood 3 to 24 bytes before. ``FILTERS`` filters of ``TAPS`` bytes run over
every second place, ReLU, and are averaged over chunks of ``CHUNK`` bytes that overlap by half and cover the whole
text. A hidden layer reads each chunk; its units are max-pooled over the chunks of a document and combined into
one probability. Trained with Adam on a bounded sample of labelled rows, gradients written out below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .shared import refuse_clash
from .sample import id_remainder, labelled_sample

TAPS, FILTERS, HIDDEN, CHUNK, STRIDE = 6, 12, 8, 256, 2
HALF = CHUNK // 2
LAGS = range(3, 25)


def planes(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text padded with zero bytes to whole half chunks: bytes, recurrence, half chunks per row.

    The padding is longer than any lag and filter, so rows don't see each other.
    """
    n = np.diff(offs)
    halves = -(-(n + LAGS[-1] + 4) // HALF)
    start = np.concatenate(([0], np.cumsum(halves * HALF)))
    out = np.zeros(start[-1] + TAPS, np.uint8)
    out[np.arange(len(b)) + np.repeat(start[:-1] - offs[:-1], n)] = b
    x = out.astype(np.uint32)
    g = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    again = np.zeros(len(g), bool)
    for lag in LAGS:
        again[lag:] |= g[lag:] == g[:-lag]
    again &= g != 0
    return out, again[: start[-1]].astype(np.float32), halves


class Net:
    SHAPES = {"table": (TAPS, 256, FILTERS), "recur": (FILTERS,), "b0": (FILTERS,), "w1": (FILTERS + 1, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN,), "b2": (1,)}

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 0.3, s) if k in ("table", "w1", "w2") else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.shift = 0.0

    def forward(self, b, offs, keep=False):
        p = self.p
        x, again, halves = planes(b, offs)
        at = np.arange(0, int(halves.sum()) * HALF, STRIDE)
        a = np.repeat(p["b0"][None], len(at), 0)
        taps = [x[at + k] for k in range(TAPS)]
        ends = np.cumsum(halves) * HALF
        for k in range(TAPS):
            for back in range(STRIDE, k + 1, STRIDE):  # what a row's last places would read of the next row
                taps[k][(ends - back) // STRIDE] = 0
            a += p["table"][k].take(taps[k], 0)
        a += again[at, None] * p["recur"]
        np.maximum(a, 0, out=a)
        per = HALF // STRIDE
        real = x[at] != 0
        sums = a.reshape(-1, per, FILTERS).sum(1)
        more = again[at].reshape(-1, per).sum(1)
        n = real.reshape(-1, per).sum(1).astype(np.float32)
        row = np.repeat(np.arange(len(halves)), halves)
        first = np.concatenate(([0], np.cumsum(halves)[:-1]))
        # chunk i: half chunks i and i + 1 of the same row; a row's last stands with the one before, or alone
        nxt = np.minimum(np.arange(len(row)) + 1, len(row) - 1)
        nxt = np.where(row[nxt] == row, nxt, np.arange(len(row)))
        size = np.maximum(np.where(nxt != np.arange(len(row)), n + n[nxt], n), 1)[:, None]
        two = (nxt != np.arange(len(row)))[:, None]
        c = np.concatenate([(sums + sums[nxt] * two) / size, ((more + more[nxt] * two[:, 0]) / size[:, 0])[:, None]], 1)
        h = np.maximum(c @ p["w1"] + p["b1"], 0)
        top = np.maximum.reduceat(h, first)
        z = top @ p["w2"] + p["b2"]
        if not keep:
            return z
        return z, (a, taps, again[at], row, first, nxt, two, size, c, h, top, per)

    def gradients(self, b, offs, y, weight):
        p = self.p
        z, (a, taps, again, row, first, nxt, two, size, c, h, top, per) = self.forward(b, offs, True)
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / weight.sum()).astype(np.float32)
        g = {"w2": top.T @ dz, "b2": dz.sum(keepdims=True)}
        dtop = dz[:, None] * p["w2"]
        ishere = h == top[row]
        share = np.maximum(np.add.reduceat(ishere, first, 0), 1)
        dh = np.where(ishere & (h > 0), (dtop / share)[row], 0).astype(np.float32)
        g["w1"], g["b1"] = c.T @ dh, dh.sum(0)
        dc = (dh @ p["w1"].T)[:, :FILTERS] / size
        ds = dc.copy()
        np.add.at(ds, nxt, dc * two)
        da = np.repeat(ds, per, 0) * (a > 0)
        g["b0"], g["recur"] = da.sum(0), again @ da
        g["table"] = np.stack([np.stack([np.bincount(t, da[:, f], minlength=256) for f in range(FILTERS)], 1) for t in taps])
        return g

    def probability(self, b, offs):
        return self._curve(self.forward(b, offs))

    def _curve(self, z):
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) + self.shift, -30, 30)))

    def probability_in_pieces(self, b, piece: int) -> np.ndarray:
        """``probability`` of one long text, ``piece`` half chunks at a time: each piece is read with the half chunk
        before it (for recurrences) and the two after it (for its last chunk and filters)."""
        halves = -(-(len(b) + LAGS[-1] + 4) // HALF)
        top = None
        for s in range(0, halves, piece):
            e, at = min(halves, s + piece), max(0, s - 1)
            x = b[at * HALF : (e + 2) * HALF]
            h = self.forward(x, np.array([0, len(x)]), True)[1][9]
            own = h[s - at : e - at].max(axis=0)
            top = own if top is None else np.maximum(top, own)
        return self._curve((top @ self.p["w2"] + self.p["b2"])[:1])


def fit(texts: list[str], y: list[int], share: float, epochs: int = 8, rows: int = 24, seed: int = 7) -> Net:
    """Trained on classes of equal weight; then the intercept is moved to their true shares. One class: constant."""
    net = Net(seed)
    y = np.array(y, np.float32)
    if len(set(y.tolist())) < 2:
        net.p["w2"][:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    t, total = 0, epochs * -(-len(y) // rows)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), rows):
            own = order[i : i + rows]
            raw, offs = vec.buffers(pa.array([texts[k] for k in own], pa.string()))
            g = net.gradients(raw[offs[0] : offs[-1]], offs - offs[0], y[own], weight[own])
            t += 1
            rate = 0.02 * (1 - t / (total + 1))
            for k in net.p:
                d = g[k].astype(np.float32) + 1e-5 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    net.shift = float(np.log(share / (1 - share)))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 600, threshold: float = 0.3, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each document, held_out, score (probability of label 1, 0 to 1), predicted.

    Fitted on at most ``per_class`` labelled rows of either class whose crc32(doc_id) mod 5 is not 0; held_out
    tells the others (null id: false). Null and empty texts are scored as one empty chunk; very long texts wholly,
    in pieces of 128 KB that give the same maxima; repeated rows each; an empty table gives no rows; without labels
    the score is a constant. Columns named score, held_out or predicted are refused. Only labelled texts of ``sample.MAX_CHARS`` characters at most are fitted on.
    """
    refuse_clash(columns, "score", "held_out", "predicted")
    spark = docs.sparkSession
    net = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "quality", per_class)))
    cols = list(dict.fromkeys((*columns, "text")))
    own = docs.select(*cols)
    out_cols = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            for i, j in vec.slices(offs, 1 << 17):
                b = raw[offs[i] : offs[j]]
                p = net.value.probability_in_pieces(b, 1 << 10) if len(b) > 1 << 18 else net.value.probability(b, offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in out_cols), pa.array(p)], names=[*out_cols, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*out_cols).dtypes)
    scored = own.mapInArrow(run, f"{kinds}, score double")
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
