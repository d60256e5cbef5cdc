"""Language identification with a bit-sliced Bloom filter of n-grams.

For each language the 4-grams of bytes (A-Z lower-cased, all but letters and non-ASCII bytes as one space) that make
at least ``min_share`` of the language's n-grams enter its Bloom filter, however frequent they are in others. The
filters are stored sliced: each position holds a bitmask with one bit for each language, so ANDing the masks at an
n-gram's positions returns all languages that contain it at once. For each document and language the n-grams returned
are counted, each with one over the number of languages returned as its weight, so that what languages share says
little. Counts are corrected for false positives with the filter's measured fill; the largest corrected one decides.

``min_share`` says when a language contains an n-gram and bounds the model: no language has more than
``1 / min_share`` n-grams whatever the corpus. More than ``MAX_LANGS`` languages are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .sample import id_remainder
from .shared import drop_written, written

U64 = np.uint64
HASHES, WIDTH = 3, 4
#: the driver and every task hold up to this many languages' n-grams
MAX_LANGS = 128
#: the weight of an n-gram that one language contains; whole numbers, so that sums don't depend on how texts are cut
UNIT = 1 << 20
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams with at least one letter and no two spaces side by side, and their places."""
    x = FOLD[b].astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    sp = x == 32
    pair = sp[:-1] & sp[1:]
    edge = np.zeros(len(b) + 1, bool)
    edge[offs] = True
    cross = edge[1:-1]  # place i + 1 begins a row
    bad = pair | cross
    ok = ~(bad[:-2] | bad[1:-1] | bad[2:])
    at = np.flatnonzero(ok)
    return g[at], at


def cut(raw: np.ndarray, offs: np.ndarray, limit: int = vec.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, offsets and row range of slices; a longer row comes in pieces that share what an n-gram may span."""
    for i, j in vec.slices(offs, limit):
        for s in range(offs[i], max(offs[j], offs[i] + 1), limit) if j == i + 1 else (offs[i],):
            e = min(offs[j], s + limit + WIDTH - 1) if j == i + 1 else offs[j]
            yield raw[s:e], offs[i : j + 1] - s if j > i + 1 else np.array([0, e - s]), i, j


def has_letter(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a letter; what pieces cut off a character is in the next piece whole."""
    ascii_letter = np.concatenate(([0], np.cumsum((FOLD[b] != 32) & (b < 128))))
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(ch.isalpha() for ch in b[offs[k] : offs[k + 1]].tobytes().decode(errors="ignore"))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            g, c = merge(parts)
            g, c = np.concatenate(([-1], g.astype(np.int64))), np.concatenate(([0], c))  # a language without n-grams is one too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    def merge(parts):
        g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv = np.unique(g, return_inverse=True)
        return u, np.bincount(inv, c, minlength=len(u))

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        raw, offs = vec.buffers(batch.column("text"))
        for b, o, i, j in cut(raw, offs):
            g, at = grams(b, o)
            row = np.searchsorted(o, at, "right") - 1
            own = langs[i:j]
            for lang in set(own):
                mine = np.flatnonzero(own == lang)
                flag = np.zeros(j - i, bool)
                flag[mine] = True
                u, c = np.unique(g[flag[row]], return_counts=True)
                held.setdefault(lang, []).append((u, c))
                size += len(u)
        if size > 4_000_000:
            for lang in held:
                held[lang] = [merge(held[lang])]
            size = sum(len(p[0][0]) for p in held.values())
            if size > 2_000_000:
                yield from flush()
                size = 0
    yield from flush()


def _places(g: np.ndarray, size: int) -> list[np.ndarray]:
    h = vec.mix(g.astype(U64) + vec.STEP)
    a, b = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    return [((a + U64(k) * b) & U64(size - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters of up to 64 languages a word; more languages take more words."""

    def __init__(self, langs: list[str], sets: dict[str, np.ndarray], weight: dict[str, int], bits_per_gram: int = 24):
        self.langs = langs
        most = max((len(sets[x]) for x in langs), default=1)
        self.size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * bits_per_gram / HASHES))))
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(langs) <= n or n == 64)
        self.words = [np.zeros(self.size, kind) for _ in range(0, max(1, len(langs)), 64)]
        fill = []
        for i, lang in enumerate(langs):
            for p in _places(sets[lang], self.size):
                np.bitwise_or.at(self.words[i // 64], p, kind(1 << (i % 64)))
            fill.append(((self.words[i // 64] >> kind(i % 64)) & kind(1)).mean())
        self.false = np.array(fill) ** HASHES
        self.most = max(langs, key=lambda x: (weight[x], x), default=None)

    def popcounts(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each row's n-grams, and by language of those that its filter returns: ``UNIT`` over the
        number of languages returned, ``UNIT`` if none is."""
        g, at = grams(b, offs)
        ends = np.searchsorted(at, offs)
        places = _places(g, self.size)
        masks = []
        for w in self.words:
            m = w[places[0]]
            for p in places[1:]:
                m &= w[p]
            masks.append(m)
        weight = UNIT // np.maximum(sum(np.bitwise_count(m).astype(np.int64) for m in masks), 1)

        def by_row(x: np.ndarray) -> np.ndarray:
            c = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
            return c[ends[1:]] - c[ends[:-1]]

        out = [by_row(((masks[i // 64] >> masks[i // 64].dtype.type(i % 64)) & masks[i // 64].dtype.type(1)).astype(np.int64) * weight) for i in range(len(self.langs))]
        return by_row(weight), np.stack(out, 1) if out else np.zeros((len(offs) - 1, 0), np.int64)

    def decide(self, total: np.ndarray, c: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of rows with such weights."""
        if not self.langs:
            return ["und"] * len(total), np.zeros(len(total))
        c = np.maximum(0, (c - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9))
        best = c.argmax(1)
        score = np.minimum(1, c[np.arange(len(total)), best] / np.maximum(total, 1))
        return [self.langs[k] if s > 0 else self.most for k, s in zip(best, score, strict=True)], score


def train(docs: DataFrame, min_share: float = 1e-5) -> Filters:
    """Filters from rows of non-null lang whose crc32(doc_id) mod 5 is not 0 (null ids don't train)."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", 5) != 0)).select("lang", "text")
    n = written(own.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))
    weight = {r.lang: r.total for r in total.limit(MAX_LANGS + 1).collect()}
    if len(weight) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    kept = n.filter("gram >= 0").join(F.broadcast(total), "lang").filter(F.col("n") >= min_share * F.col("total")).select("lang", "gram").toArrow()
    drop_written(n)
    langs, g = kept["lang"].combine_chunks().dictionary_encode(), kept["gram"].to_numpy().astype(np.uint32)
    codes = langs.indices.to_numpy()
    sets = {x: np.sort(g[codes == k]) for k, x in enumerate(langs.dictionary.to_pylist())}
    names = sorted(weight)
    return Filters(names, {x: sets.get(x, g[:0]) for x in names}, weight)


def identify(docs: DataFrame, min_share: float = 1e-5) -> DataFrame:
    """doc_id, held_out, lang_pred, score (corrected share of the weight of its n-grams that the language contains).

    ``und`` with score 0 for null texts and texts without a letter, and if nothing was learned. A text with
    letters but no known n-gram gets the language of most training text, score 0. Equal counts go to the first
    language by name. Repeated rows are scored each; very long texts wholly, a megabyte at a time; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, min_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            n = batch.num_rows
            total, counts, letter = np.zeros(n, np.int64), np.zeros((n, len(f.langs)), np.int64), np.zeros(n, bool)
            for b, o, i, j in cut(raw, offs):
                t, c = f.popcounts(b, o)
                total[i:j] += t
                counts[i:j] += c
                letter[i:j] |= has_letter(b, o)
            lang, score = f.decide(total, counts)
            lang = pa.array([x if ok else "und" for x, ok in zip(lang, letter, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, pa.array(np.where(letter, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
