"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words (A-Z lower-cased, other ASCII but digits and letters as separators) and
cut to windows of ``width`` words. All windows are patterns of one automaton. Each document is normalised the
same way and scanned once; word positions of hits map back to offsets in the original text.

The automaton goes to the executors inside the task's closure, so its size is checked first: patterns of more
than ``max_mb`` are dealt to several automata by hash, each scanned in turn by the same task over the same text.
The windows are cut and made distinct on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .shared import refuse_clash

TO_WORDS = bytes(int(vec.LOWER[i]) if vec.ALNUM[vec.LOWER[i]] else 32 for i in range(256))


def normalise(text: str | None) -> bytes:
    """Words joined by single spaces, as UTF-8."""
    return b" ".join((text or "").encode().translate(TO_WORDS).split())


def windows(text: str | None, width: int) -> list[str]:
    w = normalise(text).decode().split(" ")
    if w == [""]:
        return []
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = set(windows(t, width))
                ids += [i] * len(w)
                found += w
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["item_id", "pattern"])

    return run


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (item_id as text, window)."""
    return benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_windows(width), "item_id string, pattern string").distinct()


_built: dict[bytes, list] = {}


def _automata(parts: list[list[tuple[str, tuple[str, ...]]]], mark: bytes):
    if mark not in _built:
        _built.clear()
        made = []
        for part in parts:
            a = ahocorasick.Automaton()
            for pattern, items in part:
                a.add_word(f" {pattern} ", (pattern.count(" ") + 1, len(pattern), items))
            if part:
                a.make_automaton()
                made.append(a)
        _built[mark] = made
    return _built[mark]


def word_hits(text: str, automata) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, hit flags of the words (None: no hit), items that occur."""
    norm = normalise(text).decode()
    if not norm:
        return 0, None, set()
    padded, hits, items = f" {norm} ", [], set()
    for a in automata:
        for end, (n, length, own) in a.iter(padded):
            hits.append((end - length - 1, n))
            items.update(own)
    n_words = norm.count(" ") + 1
    if not hits:
        return n_words, None, items
    gaps = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)
    first = np.searchsorted(gaps, np.array([h[0] for h in hits]))
    mark = np.zeros(n_words + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + np.array([h[1] for h in hits]), -1)
    return n_words, np.cumsum(mark)[:n_words] > 0, items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of the original text that runs of hit words cover."""
    raw = np.frombuffer(text.encode().translate(vec.LOWER_BYTES), np.uint8)
    s, e, _ = vec.word_spans(raw, np.array([0, len(raw)]), vec.ALNUM)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [(int(points[s[a]]), int(points[e[b - 1]])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _scan(parts, mark: bytes, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(parts, mark)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = {k: [] for k in ("n_words", "n_hit", "items", "hit_spans")}
                for text in batch.column("text").to_pylist():
                    n, hit, items = word_hits(text or "", automata)
                    out["n_words"].append(n)
                    out["n_hit"].append(0 if hit is None else int(hit.sum()))
                    out["items"].append(sorted(items))
                    out["hit_spans"].append([] if hit is None else [{"start": a, "end": b} for a, b in original_spans(text, hit)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())),
                     pa.array(out["hit_spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=[*columns, "n_words", "n_hit", "items", "hit_spans"],
                )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_mb: float = 16, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns``, n_words, n_hit, items (sorted, as text), hit_spans (code points of the original).

    A word is hit if it lies in an occurrence of a window: ``width`` consecutive words of an item, or the whole
    item if it has fewer. Null and empty texts have no words. Items without words have no window; items with a
    null id are ignored; repeated items count once. Repeated documents give a row each. An empty benchmark hits
    nothing. Other columns pass if named, unless they have the name of a column of the result; text must be.

    The benchmark is a test set, small against any corpus; the size of its distinct windows is measured and
    bounds what one automaton holds. Above 64 automata (a gigabyte of windows) this raises rather than overload.
    """
    refuse_clash(columns, "n_words", "n_hit", "items", "hit_spans")
    pairs = item_windows(benchmark, width).groupBy("pattern").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    size = pairs.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    n_parts = 1 + int(size / (max_mb * 1_000_000))
    if n_parts > 64:
        raise ValueError("the benchmark is too large to be held by every executor")
    parts: list[list] = [[] for _ in range(n_parts)]
    for row in pairs.orderBy("pattern").toLocalIterator():
        parts[int(hashlib.md5(row.pattern.encode()).hexdigest()[:8], 16) % n_parts].append((row.pattern, tuple(row["items"])))
    mark = hashlib.sha256(repr(parts).encode()).digest()
    own = docs.select(*columns)
    kinds = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    return own.mapInArrow(_scan(parts, mark, columns), f"{kinds}, n_words long, n_hit long, items array<string>, hit_spans array<struct<start:long,end:long>>")


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_contamination(docs, benchmark, width).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
