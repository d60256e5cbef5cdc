"""Language-model scoring by context-tree weighting over byte contexts.

Each byte is decomposed into eight binary decisions. A node is a context (the last 0 to ``depth`` bytes) with
the bits of the next byte decided so far; it counts zeros and ones over the whole training text and its
Krichevsky-Trofimov block probability Pe follows from the counts. Bottom-up, each node's weighted probability is
``Pw = Pe / 2 + (product of Pw of the contexts one byte longer) / 2``. A bit is predicted by mixing the KT
estimates of all depths on the path with the weights ``Pe / 2 / Pw`` that this leaves; where the text leaves the
tree, the deepest node that exists keeps all remaining weight.

No node is left out. Tasks count (context, byte) n-grams, which are added up by n-gram. The tree is built in parts
that hold all n-grams of the same last ``SPLIT`` context bytes; what is shorter (a table of 256 contexts by 256 paths,
whatever the input) is folded on the driver and handed back, so that each part scores its distinct n-grams alone.
Texts then add up the scores of their n-grams: the most frequent ``hot_grams`` are looked up where the text is, all
others are joined. So are words, for the unigram baseline with add-one smoothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .sample import id_remainder
from .shared import shuffles_end, written

U64 = np.uint64
BEGIN, END = 0xFF, 0xFE  # no UTF-8 text has these bytes
END_WORD = U64(0x656E645F746F6B65)
#: context bytes that a part of the tree has in common
SPLIT = 2
#: bytes of text for each part of the counts, distinct n-grams for each part of the tree
PART_BYTES, PART_GRAMS = 1 << 24, 200_000
GRAM, WORD, TEXT = 0, 1, 2
LOG_PI = float(np.log(np.pi))


def byte_grams(b: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) n-grams as integers, the byte lowest, for each byte and one end; and row offsets into them."""
    n = np.diff(offs)
    start = np.concatenate(([0], np.cumsum(n + depth + 1)))
    x = np.full(start[-1], BEGIN, np.uint8)
    x[np.arange(len(b)) + np.repeat(start[:-1] + depth - offs[:-1], n)] = vec.LOWER[b]
    x[start[1:] - 1] = END
    return _pack(x, start, depth), np.concatenate(([0], np.cumsum(n + 1)))


def _pack(x: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    size = max(0, len(x) - depth)
    g = np.zeros(size, U64)
    for k in range(depth + 1):
        g <<= U64(8)
        g |= x[k : size + k]
    ok = np.ones(size, bool)
    for k in range(depth):  # those that would reach into the next row
        ok[start[1:-1] - 1 - k] = False
    return g[ok]


def pieces(raw: np.ndarray, offs: np.ndarray, limit: int = vec.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool, bool]]:
    """Slices of rows as bytes, offsets, first and last row, and whether the piece begins and ends its rows: a longer
    row is cut after white space, so that no word is (a run without any is cut nowhere)."""
    for i, j in vec.slices(offs, limit):
        b = raw[offs[i] : offs[j]]
        if j > i + 1 or len(b) <= limit:
            yield b, offs[i : j + 1] - offs[i], i, j, True, True
            continue
        ends = np.concatenate((np.flatnonzero(~vec.WORD[b]) + 1, [len(b)]))
        ends = ends[np.concatenate((np.diff(ends // limit) > 0, [True]))]
        at = 0
        for e in ends.tolist():
            yield b[at:e], np.array([0, e - at]), i, j, at == 0, e == len(b)
            at = e


class Pieces:
    """n-grams and words of pieces, each n-gram's context reaching back into the piece before."""

    def __init__(self, depth: int) -> None:
        self.depth, self.before = depth, np.zeros(0, np.uint8)

    def grams(self, b: np.ndarray, offs: np.ndarray, begins: bool, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        if begins and ends:
            return byte_grams(b, offs, self.depth)
        head = np.full(self.depth, BEGIN, np.uint8) if begins else self.before
        x = np.concatenate((head, vec.LOWER[b], np.array([END] if ends else [], np.uint8)))
        self.before = x[len(x) - self.depth :]
        g = _pack(x, np.array([0, len(x)]), self.depth)
        return g, np.array([0, len(g)])


def _merge(keys, *counts):
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
    return (k[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts))


def _count(depth: int, n_parts: int):
    """Texts -> (kind, part, keys, n, m) of packed n-grams and words: n counts training rows, m all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = [0, 0]

        def packed(kind):
            k, n, m = _merge(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
            held[kind], size[kind] = [(k, n, m)], len(k)

        def flush(kind):
            k, n, m = held[kind][0]
            held[kind], size[kind] = [], 0
            part = (vec.mix(k) % U64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, n, m = k[order], n[order], m[order]
            cut = np.searchsorted(part[order], np.arange(n_parts + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), kind)), pa.array(some)] + [pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary()) for x in (k, n.astype(np.uint32), m.astype(np.uint32))], names=["kind", "part", "keys", "n", "m"]
            )

        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False)
            cutter = Pieces(depth)
            for b, o, i, j, begins, ends in pieces(raw, offs):
                g, cut = cutter.grams(b, o, begins, ends)
                s, e, rows = vec.word_spans(b, o)
                w = vec.span_hash(vec.LOWER[b], s, e)
                own = train[i:j]
                for kind, x, of in ((GRAM, g, np.repeat(own, np.diff(cut))), (WORD, w, own[rows])):
                    for seen in (True, False):
                        u, c = np.unique(x[of == seen], return_counts=True)
                        if len(u):
                            held[kind].append((u, (c * seen).astype(np.uint32), c.astype(np.uint32)))
                            size[kind] += len(u)
                if ends:
                    held[WORD].append((np.array([END_WORD]), np.array([own.sum()], np.uint32), np.array([j - i], np.uint32)))
                    size[WORD] += 1
                for kind in (GRAM, WORD):
                    if size[kind] > 2_000_000:
                        packed(kind)
                        if size[kind] > 1_000_000:
                            yield from flush(kind)
        for kind in (GRAM, WORD):
            if held[kind]:
                packed(kind)
                yield from flush(kind)

    return run


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One part of the counts, each key once."""
    raw = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", U64), ("n", np.uint32), ("m", np.uint32))]
    k, n, m = _merge(raw[0], raw[1].astype(np.int64), raw[2].astype(np.int64))
    return pa.table({"kind": np.full(len(k), key[0].as_py()), "key": k.view(np.int64), "n": n, "m": m})


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series after six steps up; the error is below 1e-9."""
    y = x + 6
    up = x
    for k in range(1, 6):
        up = up * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(up)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - LOG_PI


class Level:
    """Nodes of one depth: id (context << 8 | path), counts, Pw, and the weight ``own`` against longer contexts."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, longer: np.ndarray | None) -> None:
        self.ids, self.n0, self.n1 = ids, n0, n1
        pe = log_kt(n0, n1)
        if longer is None:
            self.log_pw, self.own = pe, np.ones(len(pe))
        else:
            self.log_pw = np.logaddexp(pe, longer) + np.log(0.5)
            self.own = np.exp(pe + np.log(0.5) - self.log_pw)

    def above(self, depth: int) -> tuple[Level, np.ndarray]:
        """The nodes of contexts one byte shorter, and where each node's is among them."""
        mask = ((1 << (8 * (depth - 1))) - 1) << 8 | 255
        ids, up = np.unique(self.ids & mask, return_inverse=True)
        n0, n1, longer = (np.bincount(up, x, len(ids)) for x in (self.n0, self.n1, self.log_pw))
        return Level(ids, n0, n1, longer), up

    def mixed(self, state: tuple) -> tuple:
        """Carries (probability of a one so far, weight left, estimate of the deepest node that exists) down to here."""
        p, left, last = state
        seen = self.n0 + self.n1 > 0
        one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        return np.where(seen, p + left * self.own * one, p), np.where(seen, left * (1 - self.own), left), np.where(seen, one, last)


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | path) of the eight decisions of each n-gram's byte, and the bits decided: 8 by n-grams."""
    v = key & 255
    path = np.stack([(1 << k) | (v >> (8 - k)) for k in range(8)])
    return (key >> 8 << 8) | path, np.stack([(v >> (7 - k)) & 1 for k in range(8)])


def build(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels ``depth`` to ``least`` of n-grams; each node's place in the level above; each decision's deepest node."""
    ids, bit = _bits(key)
    own, at = np.unique(ids.ravel(), return_inverse=True)
    n = np.tile(n.astype(float), 8)
    one = bit.ravel() == 1
    levels, ups = [Level(own, np.bincount(at, np.where(one, 0, n), len(own)), np.bincount(at, np.where(one, n, 0), len(own)), None)], []
    for d in range(depth, least, -1):
        level, up = levels[-1].above(d)
        levels.append(level)
        ups.append(up)
    return levels, ups, at


def _lower_levels(depth: int, least: int):
    """One part of the tree: its shortest contexts' nodes."""

    def run(table: pa.Table) -> pa.Table:
        top = build(table.column("key").to_numpy(), table.column("n").to_numpy(), depth, least)[0][-1]
        some = top.n0 + top.n1 > 0
        return pa.table({"id": top.ids[some], "n0": top.n0[some], "n1": top.n1[some], "log_pw": top.log_pw[some]})

    return run


def top_state(nodes: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Level.mixed`` carries at contexts of ``least - 1`` bytes, dense by id."""
    size = 1 << (8 * least)
    none = (np.zeros(1), np.ones(1), np.full(1, 0.5))
    ids = nodes.column("id").to_numpy()
    levels, ups = [Level(ids, *(nodes.column(c).to_numpy() for c in ("n0", "n1", "longer")))], []
    for d in range(least - 1, 0, -1):
        level, up = levels[-1].above(d)
        levels.append(level)
        ups.append(up)
    state = levels[-1].mixed(tuple(np.repeat(x, len(levels[-1].ids)) for x in none))
    for level, up in zip(reversed(levels[:-1]), reversed(ups), strict=True):
        state = level.mixed(tuple(x[up] for x in state))
    # a context that the training text lacks: that of the shorter one
    out = [np.full(size, x[0]) for x in none]
    if least == 2:
        short, full = levels[-1], levels[0]
        root = short.mixed(tuple(np.repeat(x, len(short.ids)) for x in none))
        for x, y in zip(out, root, strict=True):
            x.reshape(-1, 256)[:, short.ids] = y
        ids = full.ids
    for x, y in zip(out, state, strict=True):
        x[ids] = y
    return tuple(out)


def _gram_scores(depth: int, least: int, shared):
    """One part of the tree -> log10 probability of the last byte of each distinct n-gram given those before."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        levels, ups, at = build(key, table.column("n").to_numpy(), depth, least)
        short = levels[-1].ids & (((1 << (8 * (least - 1))) - 1) << 8 | 255)
        state = levels[-1].mixed(tuple(x[short] for x in shared.value))
        for level, up in zip(reversed(levels[:-1]), reversed(ups), strict=True):
            state = level.mixed(tuple(x[up] for x in state))
        one = (state[0] + state[1] * state[2])[at].reshape(8, -1)
        score = np.log10(np.where(_bits(key)[1] == 1, one, 1 - one)).sum(axis=0)
        return pa.table({"kind": np.full(len(key), GRAM), "key": key, "m": table.column("m").to_numpy(), "value": score, "known": np.zeros(len(key), np.int64)})

    return run


class Hot:
    """A fixed set of keys with values, looked up by hash: each table holds the most frequent key of each slot."""

    def __init__(self, keys: np.ndarray, m: np.ndarray, value: np.ndarray, known: np.ndarray) -> None:
        order = np.argsort(-m, kind="stable")
        self.keys, self.value, self.known = keys[order], value[order], known[order].astype(bool)
        self.tables: list | None = None

    def _build(self) -> None:
        self.tables, left = [], np.arange(len(self.keys))
        while len(left):
            bits = max(4, len(left).bit_length())
            slot = vec.mix(self.keys[left] + U64(len(self.tables))) >> U64(64 - bits)
            first = np.unique(slot, return_index=True)[1]
            at = np.full(1 << bits, -1, np.int32)
            at[slot[first].astype(np.int64)] = left[first]
            key = np.zeros(1 << bits, U64)
            key[slot[first].astype(np.int64)] = self.keys[left[first]]
            self.tables.append((bits, key, at))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left = left[rest]

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where each key is in ``keys``, -1 if it is none of them."""
        if self.tables is None:
            self._build()
        out = np.full(len(x), -1, np.int32)
        todo = None
        for t, (bits, key, at) in enumerate(self.tables):
            own = x if todo is None else x[todo]
            slot = vec.mix(own + U64(t)) >> U64(64 - bits)
            found = np.where(key[slot] == own, at[slot], -1)
            if todo is None:
                out = found
                todo = np.flatnonzero(found < 0)
            else:
                out[todo] = found
                todo = todo[found < 0]
            if not len(todo):
                break
        return out


def _hot(table: DataFrame, most: int) -> tuple[Hot, int]:
    """The most frequent keys, ``most`` at the most, and the least count that makes one."""
    step = F.when(F.col("m") < 4096, F.col("m")).otherwise((F.floor(F.log2("m") * 64) + 4096 - 768).cast("long"))
    seen, least = 0, None
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("m").alias("m")).collect(), key=lambda r: -r.step):
        if seen + r.n > most:
            break
        seen, least = seen + r.n, r.m
    rows = (table.filter(F.col("m") >= least) if least is not None else table.limit(0)).select("key", "m", "value", "known").toArrow()
    return Hot(rows["key"].to_numpy().view(U64), rows["m"].to_numpy(), rows["value"].to_numpy(), rows["known"].to_numpy()), least or 1 << 62


NAMES = ["kind", "doc_id", "mark", "key", "tf", "n_tokens", "n_known", "n_bytes", "logs", "score"]


def _scored(depth: int, shared):
    """Rows of a text with the sums over its hot keys, then of its other keys with their numbers. A row that is cut
    gives several, to be added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = shared.value
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            cutter = Pieces(depth)
            for b, o, i, j, begins, ends in pieces(raw, offs):
                n = j - i
                g, cut = cutter.grams(b, o, begins, ends)
                s, e, wr = vec.word_spans(b, o)
                w = vec.span_hash(vec.LOWER[b], s, e)
                if ends:
                    w, wr = np.concatenate((w, np.full(n, END_WORD))), np.concatenate((wr, np.arange(n)))
                gr = np.repeat(np.arange(n), np.diff(cut))
                at, cold = grams.find(g), []
                hot = at >= 0
                score = np.bincount(gr[hot], grams.value[at[hot]], n)
                cold.append((GRAM, g[~hot], gr[~hot]))
                at = words.find(w)
                hot = at >= 0
                logs, known = np.bincount(wr[hot], words.value[at[hot]], n), np.bincount(wr[hot], words.known[at[hot]], n)
                cold.append((WORD, w[~hot], wr[~hot]))
                ids, mark = batch.column("doc_id").slice(i, n), batch.column("mark").slice(i, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TEXT)), ids, mark, pa.nulls(n, pa.int64()), pa.array(np.full(n, int(ends))), pa.array(np.bincount(wr, minlength=n)), pa.array(known.astype(np.int64)), pa.array(np.diff(o).astype(np.int64)), pa.array(logs.astype(float)), pa.array(score.astype(float))], names=NAMES)
                for kind, x, r in cold:
                    order = np.lexsort((x, r))
                    x, r = x[order], r[order]
                    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (r[1:] != r[:-1])))[: len(x)])
                    if len(first):
                        none, take = pa.nulls(len(first), pa.int64()), pa.array(r[first])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind)), ids.take(take), mark.take(take), pa.array(x[first].view(np.int64)), pa.array(np.diff(np.concatenate((first, [len(x)])))), none, none, none, none.cast(pa.float64()), none.cast(pa.float64())], names=NAMES)

    return run


def score_texts(docs: DataFrame, depth: int = 5, hot_grams: int = 1 << 20, hot_words: int = 1 << 19) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Trained on the rows whose crc32(doc_id) mod 7 is not 2 (a null id trains). Null text: empty, one end token.
    score: log10 probability of the lower-cased bytes and an end; bits_per_byte: its code length over bytes + 1.
    Repeated rows count in training and are scored each. Very long texts are cut for memory, their contexts reach
    over the cut. Without training rows every bit has probability 1/2 and the baseline is 0. Other columns are
    ignored; an empty table gives no rows. ``hot_grams`` and ``hot_words`` say only what is looked up and what joined.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6: an n-gram is one integer")
    spark = docs.sparkSession
    least = min(SPLIT, depth)
    held = F.coalesce(id_remainder("doc_id", 7) == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_parts = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / PART_BYTES) + 8
    counted = docs.select("text", (~held).alias("train")).mapInArrow(_count(depth, n_parts), "kind long, part long, keys binary, n binary, m binary")
    counted = written(counted.groupBy("kind", "part").applyInArrow(_added, "kind long, key long, n long, m long"), "ctw-counts")
    n_all, n_kinds = counted.filter((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    grams = counted.filter(F.col("kind") == GRAM).select("key", "n", "m")
    n_trees = int(grams.count() / PART_GRAMS) + 8
    suffix = F.shiftright("key", 8).bitwiseAND((1 << (8 * least)) - 1)
    parts = grams.withColumn("part", F.pmod(F.xxhash64(suffix), F.lit(n_trees))).groupBy("part")
    nodes = parts.applyInArrow(_lower_levels(depth, least), "id long, n0 double, n1 double, log_pw double")
    short = F.col("id").bitwiseAND(((1 << (8 * (least - 1))) - 1) << 8 | 255)
    with shuffles_end(spark):  # 256 contexts by 255 paths at most
        top = nodes.groupBy(short.alias("id")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("longer")).toArrow()
    state = spark.sparkContext.broadcast(top_state(top, least))
    kinds = "kind long, key long, m long, value double, known long"
    scores = written(parts.applyInArrow(_gram_scores(depth, least, state), kinds), "ctw-scores")
    words = counted.filter(F.col("kind") == WORD).select("kind", "key", "m", F.log10(F.col("n") + 1.0).alias("value"), (F.col("n") > 0).cast("long").alias("known"))

    with shuffles_end(spark):
        (hot_g, least_g), (hot_w, least_w) = _hot(scores, hot_grams), _hot(words, hot_words)
    shared = spark.sparkContext.broadcast((hot_g, hot_w))
    kinds = "kind long, doc_id long, mark long, key long, tf long, n_tokens long, n_known long, n_bytes long, logs double, score double"
    found = written(docs.withColumn("mark", F.xxhash64("text")).mapInArrow(_scored(depth, shared), kinds), "ctw-texts")
    rest = scores.filter(F.col("m") < least_g).unionByName(words.filter(F.col("m") < least_w)).select("kind", "key", "value", "known")
    cold = found.filter(F.col("kind") != TEXT).select("kind", "doc_id", "mark", "key", "tf").join(rest, ["kind", "key"])
    cold = cold.groupBy("doc_id", "mark").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("tf") * F.col("value")).otherwise(0.0)).alias(c) for k, c in ((WORD, "cold_logs"), (GRAM, "cold_score"))), F.sum(F.col("known") * F.col("tf")).alias("cold_known")
    )
    cold = cold.select(F.col("doc_id").alias("cold_id"), F.col("mark").alias("cold_mark"), "cold_logs", "cold_score", "cold_known")
    # rows that repeat doc_id and text have the same sums: each has the mean. A row gives one piece that ends it
    sums = found.filter(F.col("kind") == TEXT).groupBy("doc_id", "mark").agg(F.sum("tf").alias("copies"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "logs", "score")))
    out = sums.join(cold, F.col("doc_id").eqNullSafe(F.col("cold_id")) & (F.col("mark") == F.col("cold_mark")), "left").na.fill(0, ["cold_logs", "cold_score", "cold_known"])
    n_tokens, score = F.col("n_tokens") / F.col("copies"), (F.col("score") + F.col("cold_score")) / F.col("copies")
    return out.select(
        F.explode(F.expr("sequence(1, copies)")).alias("_copy"), "doc_id", held.alias("held_out"), n_tokens.cast("long").alias("n_tokens"), ((F.col("n_known") + F.col("cold_known")) / F.col("copies")).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), ((F.col("logs") + F.col("cold_logs")) / F.col("copies") - n_tokens * float(np.log10(n_all + n_kinds + 1))).alias("base_score"),
        score.alias("score"), (-score * float(np.log2(10)) / (F.col("n_bytes") / F.col("copies") + 1)).alias("bits_per_byte"),
    ).drop("_copy")
