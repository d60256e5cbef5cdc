"""Quality rules: counts against fixed limits, and a calibrated logistic regression over hashed n-grams.

Features are hashed words, word pairs and byte 3- and 4-grams (A-Z kept as they are, since shouting is a sign),
each as its share of the document's n-grams of that sort. The weights are fitted by Adagrad on a bounded sample
of labelled rows; a Platt curve fitted on a third of the sample that the weights never saw turns the margin into
a probability, with the classes' true shares. Scoring runs in Arrow batches: hash, look up, and mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .sample import labelled_sample

U64 = np.uint64
BITS = 18
SYMBOL = vec._table(lambda i: chr(i) in "#*$%&|<>")
SORTS = 4  # words, word pairs, 3-grams, 4-grams
#: added to the number of n-grams, so that a few of them decide little
SHRINK = 20


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[offs[1:]] - c[offs[:-1]]


def counts(b: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(offs) - 1
    s, e, rows = vec.word_spans(b, offs)
    own = vec.WORD[b]
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": _per_row(own & ((b & 0xC0) != 0x80), offs), "n_symbols": _per_row(SYMBOL[b], offs)}
    # lines
    breaks = np.flatnonzero(b == 10)
    starts = np.union1d(offs[:-1][offs[:-1] < offs[1:]], breaks + 1)
    starts = starts[starts < len(b)]
    row = np.searchsorted(offs, starts, "right") - 1
    ends = np.minimum(np.concatenate((starts[1:], [len(b)])), offs[row + 1]) if len(starts) else starts
    ends = ends - ((ends > starts) & (b[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    words = np.concatenate(([0], np.cumsum(own, dtype=np.int64)))
    full = words[ends] > words[starts] if len(starts) else np.zeros(0, bool)
    starts, ends, row = starts[full], ends[full], row[full]
    key = vec.mix(vec.span_hash(b, starts, ends) ^ vec.mix(row.astype(U64))) if len(starts) else np.zeros(0, U64)
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)
    # five-word windows found twice or more
    repeat = np.zeros(n, np.int64)
    if len(s) >= 5:
        w = vec.span_hash(b, s, e)
        ok = np.flatnonzero(rows[:-4] == rows[4:])
        sh = sum(w[k : len(w) - 4 + k] * vec.SEQ[k] for k in range(5))[ok]
        key = vec.mix(vec.mix(sh) ^ vec.mix(rows[ok].astype(U64)))
        order = np.sort(key)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        if len(again):
            at = np.minimum(np.searchsorted(again, key), len(again) - 1)
            hit = ok[again[at] == key]
            mark = np.zeros(len(s) + 6, np.int32)
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + 5, -1)
            repeat = np.bincount(rows[np.cumsum(mark)[: len(s)] > 0], minlength=n)
    out["n_repeat_words"] = repeat
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(b: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each sort of n-gram the hashed features and their rows."""
    s, e, rows = vec.word_spans(b, offs)
    w = vec.span_hash(b, s, e)
    cut = lambda h, k: ((vec.mix(h ^ U64(k)) >> U64(64 - BITS)).astype(np.int32))
    yield cut(w, 1), rows
    same = rows[1:] == rows[:-1]
    yield cut(w[:-1] * U64(3) + w[1:], 2)[same], rows[1:][same]
    x = b.astype(np.uint32)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for k in (3, 4):
        if len(b) < k:
            yield np.zeros(0, np.int32), np.zeros(0, np.int64)
            continue
        g = x[: len(x) - k + 1].copy()
        for i in range(1, k):
            g = (g << np.uint32(8)) | x[i : len(x) - k + 1 + i]
        same = row[: len(g)] == row[k - 1 :]
        yield ((g * np.uint32(2654435761) + np.uint32(k)) >> np.uint32(32 - BITS)).astype(np.int32)[same], row[: len(g)][same]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def margin(self, b: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.bias)
        for k, (f, rows) in enumerate(features(b, offs)):
            n = np.bincount(rows, minlength=len(out))
            out += np.bincount(rows, self.weights[k][f], minlength=len(out)) / (n + SHRINK)
        return out

    def probability(self, b: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(b, offs) + self.shift, -30, 30)))


def fit(texts: list[str], y: list[int], share: float, rounds: int = 60, penalty: float = 1e-4) -> Model:
    """Weights from two thirds of the rows, the Platt curve from the rest. One class or no row: a constant."""
    y = np.array(y, float)
    if len(set(y)) < 2 or min(np.bincount(y.astype(int))) < 6:
        c = float(np.log(share / (1 - share)))
        return Model(np.zeros((SORTS, 1 << BITS), np.float32), c, 1.0, 0.0)
    raw, offs = vec.buffers(pa.array(texts, pa.string()))
    b = raw[offs[0] : offs[-1]]
    rows_of = [(f, r) for f, r in features(b, offs - offs[0])]
    n_rows = len(y)
    fold = np.arange(n_rows) % 3 == 0
    true = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    # one row of each feature and document, with its share
    data = []
    for k, (f, r) in enumerate(rows_of):
        n = np.bincount(r, minlength=n_rows) + SHRINK
        u, c = np.unique(r.astype(np.int64) << BITS | f, return_counts=True)
        r = (u >> BITS).astype(np.int32)
        data.append((r, (u & ((1 << BITS) - 1)).astype(np.int32), (c / n[r]).astype(np.float32), k))
    w, seen, bias, seen_b = np.zeros((SORTS, 1 << BITS)), np.full((SORTS, 1 << BITS), 1e-8), 0.0, 1e-8
    fit_w = np.where(fold, 0.0, 1.0)
    fit_w /= fit_w.sum()
    for _ in range(rounds):
        m = np.full(n_rows, bias)
        for r, f, x, k in data:
            m += np.bincount(r, w[k][f] * x, minlength=n_rows)
        g = (1 / (1 + np.exp(-m)) - y) * fit_w
        seen_b += g.sum() ** 2
        bias -= 0.3 * g.sum() / np.sqrt(seen_b)
        for r, f, x, k in data:
            d = np.bincount(f, g[r] * x, minlength=1 << BITS) + penalty * w[k] * 1e-3
            seen[k] += d * d
            w[k] -= 0.5 * d / np.sqrt(seen[k])
    m = np.full(n_rows, bias)
    for r, f, x, k in data:
        m += np.bincount(r, w[k][f] * x, minlength=n_rows)
    m, t, v = m[fold], y[fold], true[fold] / true[fold].sum()
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the Platt curve, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(scale * m + shift, -30, 30)))
        g = np.array([((p - t) * v * m).sum() + 1e-4 * scale, ((p - t) * v).sum()])
        q = p * (1 - p) * v
        h = np.array([[(q * m * m).sum() + 1e-4, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        scale, shift = scale - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return Model(w.astype(np.float32), bias, float(scale), float(shift))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, labels: DataFrame, per_class: int = 800, threshold: float = 0.3, fold: int | None = 5) -> DataFrame:
    """Per document doc_id, the five counts, base_failed, probability, kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated five-word windows. kept: not
    base_failed and probability of good quality of at least ``threshold``. Weights are fitted on at most
    ``per_class`` rows of either class. Null and empty texts have no words and fail; rows that repeat are scored
    each; other columns are ignored; without labels the probability is constant.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "quality", per_class, fold)))  # 2**20 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            for i, j in vec.slices(offs, 1 << 19):
                b, o = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                c = counts(b, o)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(c[k]) for k in COLUMNS), pa.array(model.value.probability(b, o))], names=["doc_id", *COLUMNS, "probability"])

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COLUMNS) + ", probability double")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("probability") >= threshold))
    )
