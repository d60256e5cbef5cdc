"""Fuzzy line deduplication.

1. Lines are normalised (A-Z lower-cased; words of digits, letters and non-ASCII bytes, single spaces). Lines of at
   least ``min_words`` words take part. Equal normalised lines form one class, found by a 64-bit hash.
2. Classes meet by a prefix filter that loses no pair: one word edit changes at most ``GRAM`` of a line's runs of
   ``GRAM`` words, so lines within the allowed edits share a known number of runs, and under one order of runs the
   first few of both (``prefixes``) have one in common. Any order is right; rare runs go first, so that what many
   lines share joins nothing. How frequent runs are is counted over all texts into ``2 ** LEVEL_BITS`` counters, a
   megabyte whatever the input. Blocks of one run are joined as stars around a few of their lines, then what the
   stars left unlinked is joined with all of its block. All are filtered by what any link must meet: the numbers of
   words, the places of the run in both lines, which edits shift, and the parities of the words in 256 bins.
3. Candidates are verified by edit similarity over their normalised words: ``1 - edits / more words``. What the stars
   left is verified family by family, and no link is sought between lines that are joined already. Lines with words
   changed in place and additional words at one place are told without an edit table.
4. Verified links and classes form connected groups; the first occurrence by (doc_id, line) of each group stays.

SimHash blocks were built first and given up: at the similarities that edit distance allows, few edited lines share a
block (README). Texts are read four times: for the classes and counts, the runs, the words of candidates, the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .components import components
from .shared import drop_written, refuse_clash, shuffles_end, written

U64 = np.uint64
GRAM = 3
#: a run's hash, below its counter's level and its line's number in one sort key
KEY_BITS, LEVEL = 40, 6
KEY_MASK = U64((1 << KEY_BITS) - 1)
#: counters of runs, and those that travel in one row
LEVEL_BITS, CHUNK = 18, 1 << 14
#: bits of the filter that finds the lines to be verified
FILTER_BITS = 25
#: the place of a run that stands more than once, or that far in a line; longest line that is told apart
ANYWHERE = 0xFFFF
#: stars of a block; lines of a block that are looked at two by two
STARS, WIDE = 4, 64
#: runs of lines for each part of the keys, which one task sorts
PART_RUNS = 2_000_000
#: a line as it travels with many others in one binary; bits of its hash that name its part; lines that are dealt at a time
LINE = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("mark", "<i8"), ("line", "<i4"), ("h", "<i8"), ("n", "<i4"), ("parity", "<u8", 4)])
LINE_BITS, DEALT = 8, 250_000
#: likewise a line of a block that can be linked yet, with their number; and one that has its component, in a tile (a, b)
OPEN = np.dtype([("h", "<i8"), ("key", "<i8"), ("place", "<u2"), ("size", "<i4")])
MEMBER = np.dtype([("key", "<i8"), ("a", "<i4"), ("b", "<i4"), ("own", "<i4"), ("n", "<i4"), ("place", "<u2"), ("h", "<i8"), ("c", "<i8"), ("parity", "<u8", 4)])
#: lines of one sort; of one tile of a block; of the tiles that one task compares
LINES, TILE, PART_LINES = 1 << 17, 1 << 11, 20_000
#: pairs that are verified at a time; bins of words as bags, and pairs that meet as bags at a time
BATCH, BINS, CHECKED = 20_000, 128, 5_000
PARITIES = ("p0", "p1", "p2", "p3")


def edits(n, similarity: float):
    """Word edits allowed where the longer line has ``n`` words."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def gram_width(similarity: float, fuzzy_words: int) -> int:
    """The widest runs, up to ``GRAM``, of which lines of any length share one at least."""
    for q in range(GRAM, 1, -1):
        n = np.arange(max(q, fuzzy_words), max(q, fuzzy_words) + 1000)
        if fuzzy_words >= q and (n - q + 1 - q * edits(n, similarity)).min() > 0 and 1 > q * (1 - similarity):
            return q
    return 1


def prefixes(n: np.ndarray, similarity: float, q: int) -> np.ndarray:
    """How many of its least runs a line of ``n`` words shows: all but those that any line near it must share, and one."""
    if not len(n):
        return n
    m = np.arange(int(n.max() / similarity) + 2)
    need = m - q + 1 - q * edits(m, similarity)
    # the longer of the two has n words or more, and edits(longer) more than n at most: need falls by less than q a step
    own, which = np.unique(n, return_inverse=True)
    return n - q + 2 - np.array([need[k : int(k / similarity) + 2].min() for k in own])[which]


#: bytes of a text -> lower-cased ones of words, 0 for all else
WORD_BYTE = np.where(vec.ALNUM[vec.LOWER], vec.LOWER, 0).astype(np.uint8).tobytes()
#: the first k of eight bytes
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: longest word that is hashed eight bytes at a time
LONG = 64


def word_hash(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of ``b``. No byte of a word is 0, so eight of them, filled up, tell words of up to eight apart."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    at = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = e - s
    out = vec.mix((at[s] & HEAD[np.minimum(size, 8)]) + vec.STEP)
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        x = at[s[more] + k] & HEAD[np.minimum(size[more] - k, 8)]
        out[more] = vec.mix((out[more] ^ x) * vec.STEP)
        k += 8
        more = more[size[more] > k]
    if len(more):
        out[more] = vec.span_hash(b, s[more], e[more])
    return out


def lines_of(b: np.ndarray, offs: np.ndarray):
    """Of every line with a word: row, number in its row, hash, words; and the hashes of all words."""
    z = np.zeros(0, np.int64)
    if not len(b):
        return z, z, z.view(U64), z, z.view(U64)
    breaks = np.flatnonzero(b == 10)
    b = np.frombuffer(b.tobytes().translate(WORD_BYTE), np.uint8)
    own = b > 0
    edge = np.flatnonzero(own[1:] != own[:-1]) + 1
    # words that meet where one row ends and the next begins
    inner = np.unique(offs[(offs > 0) & (offs < len(b))])
    meet = inner[own[inner - 1] & own[inner]]
    edge = np.concatenate(([0] * int(own[0]), edge, [len(b)] * int(own[-1]))).astype(np.int64)
    if len(meet):
        edge = np.sort(np.concatenate((edge, meet, meet)))
    s, e = edge[::2], edge[1::2]
    if not len(s):
        return z, z, z.view(U64), z, z.view(U64)
    # a line begins with the first word of the slice, after a break, or of a row
    first = np.unique(np.concatenate(([0], np.searchsorted(s, breaks), np.searchsorted(s, offs))))
    first = first[first < len(s)]
    rows = np.searchsorted(offs, s[first], "right") - 1
    number = np.searchsorted(breaks, s[first]) - np.searchsorted(breaks, offs[rows])
    n = np.diff(np.concatenate((first, [len(s)])))
    w = word_hash(b, s, e)
    up, down = vec._powers(len(w))
    c = np.concatenate((np.zeros(1, U64), np.cumsum(w * up[: len(w)], dtype=U64)))
    return rows, number, vec.mix((c[first + n] - c[first]) * down[first] + n.astype(U64)), n, w


def runs_of(w: np.ndarray, n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``q`` words in lines of ``n`` words each, and their lines."""
    own = np.repeat(np.arange(len(n)), n)
    if len(w) < q:
        return np.zeros(0, U64), own[:0]
    g = np.zeros(len(w) - q + 1, U64)
    for k in range(q):
        g += w[k : len(w) - q + 1 + k] * vec.SEQ[k]
    inside = own[: len(g)] == own[q - 1 :]
    return vec.mix(g[inside] + U64(q)) & KEY_MASK, own[: len(g)][inside]


def shown_runs(w: np.ndarray, n: np.ndarray, similarity: float, q: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that each line of ``n`` words (``q`` at least) shows, rare ones first, their places (ANYWHERE if the line
    has the run more than once), and how many."""
    key, own = runs_of(w, n, q)
    runs = n - q + 1
    begin = np.concatenate(([0], np.cumsum(runs)[:-1]))
    level = lambda k: levels[(k >> U64(KEY_BITS - LEVEL_BITS)).astype(np.int64)].astype(U64)
    packed = (own.astype(U64) << U64(KEY_BITS + LEVEL)) | (level(key) << U64(KEY_BITS)) | key
    order = np.argsort(packed)
    x = packed[order]
    place = order - begin[own[order]]
    same = x[1:] == x[:-1]
    if same.any():
        # a run's repeats in its line are runs of their own: its first, its second ...
        place[np.concatenate((same, [False])) | np.concatenate(([False], same))] = ANYWHERE
        again = np.flatnonzero(same) + 1
        start = np.flatnonzero(np.concatenate(([True], again[1:] != again[:-1] + 1)))
        nth = np.arange(len(again)) - np.repeat(start, np.diff(np.append(start, len(again)))) + 1
        key = vec.mix((x[again] & KEY_MASK) + nth.astype(U64) * vec.STEP) & KEY_MASK
        line = x[again] >> U64(KEY_BITS + LEVEL)
        x[again] = (line << U64(KEY_BITS + LEVEL)) | (level(key) << U64(KEY_BITS)) | key
        # only their lines are sorted anew
        moved = np.zeros(len(n), bool)
        moved[line.astype(np.int64)] = True
        moved = np.flatnonzero(np.repeat(moved, runs))
        order = moved[np.argsort(x[moved])]
        x[moved], place[moved] = x[order], place[order]
    shown = np.minimum(runs, prefixes(n, similarity, q))
    keep = np.arange(len(x)) - np.repeat(begin, runs) < np.repeat(shown, runs)
    return x[keep] & KEY_MASK, np.minimum(place[keep], ANYWHERE).astype(np.uint16), shown


def near_places(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether lines of ``n`` and ``m`` words that hold a run at ``i`` and ``j`` can be linked by ``most`` edits with the run in place:
    the edits before it are as many as its shift at least, those after it as the shift of the lines' ends from it."""
    shift, ends = np.abs(i - j), np.abs((n - i) - (m - j))
    return (np.abs(n - m) <= most) & ((i == ANYWHERE) | (j == ANYWHERE) | (n >= ANYWHERE) | (m >= ANYWHERE) | (shift + ends <= most))


def pieces(raw: np.ndarray, offs: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, int]]:
    """Bytes, offsets, row range and first line of slices of rows; a longer row is cut between its lines."""
    for i, j in vec.slices(offs, limit):
        if j > i + 1 or offs[j] - offs[i] <= limit:
            yield raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, j, 0
            continue
        b = raw[offs[i] : offs[j]]
        ends = np.concatenate((np.flatnonzero(b == 10) + 1, [len(b)]))
        at = line = 0
        while at < len(b):
            k = max(int(np.searchsorted(ends, at + limit, "right")) - 1, line)
            yield b[at : ends[k]], np.array([0, ends[k] - at]), i, j, line
            at, line = int(ends[k]), k + 1


def _first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines by class, the first by (doc_id, mark, line) of each; and whether a line is its class's first. Repeated rows
    hold one line."""
    order = np.lexsort((rows["line"], rows["mark"], rows["doc_id"], rows["known"], rows["h"]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = rows["h"][1:] != rows["h"][:-1]
    again = np.zeros(len(rows), bool)
    for c in ("known", "doc_id", "mark", "line"):
        again[1:] |= rows[c][1:] != rows[c][:-1]
    keep = new | again
    return rows[keep], new[keep]


def _by_mark(rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Marks and, for each, the numbers of its lines."""
    rows = rows[np.argsort(rows["mark"], kind="stable")]
    mark, cut = np.unique(rows["mark"], return_index=True)
    return pa.array(mark), pa.ListArray.from_arrays(pa.array(np.append(cut, len(rows)).astype(np.int32)), pa.array(rows["line"]))


def _table(kinds: dict[str, pa.DataType], **columns: pa.Array) -> pa.RecordBatch:
    """Columns of one length; those of ``kinds`` that are not given are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))


EVERY = {"part": pa.int32(), "lines": pa.binary(), "mark": pa.int64(), "gone": pa.list_(pa.int32()), "chunk": pa.int64(), "counts": pa.binary()}


def _part(h: np.ndarray) -> np.ndarray:
    return (h.view(U64) >> U64(64 - LINE_BITS)).astype(np.int64)


def _packed(rows: np.ndarray, part: np.ndarray | None = None) -> tuple[pa.Array, pa.Array]:
    """Parts, and the rows (lines, or their hashes) of each as one binary."""
    part = _part(np.ascontiguousarray(rows["h"] if rows.dtype.names else rows)) if part is None else part
    order = np.argsort(part, kind="stable")
    rows = rows[order]
    some, cut = np.unique(part[order], return_index=True)
    cut = np.append(cut, len(rows))
    return pa.array(some), pa.array([rows[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())


def _all_lines(min_words: int, fuzzy_words: int, q: int):
    """Every line that takes part, dealt by its hash. Of a class's lines in one task only the first does: the others can't
    be the first of all and are listed by mark (gone). Then the counters of the task's runs, in rows of ``CHUNK``."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, first = _first(np.concatenate(held))
        part, lines = _packed(rows[first])
        yield _table(EVERY, part=part, lines=lines)
        if not first.all():
            mark, gone = _by_mark(rows[~first])
            yield _table(EVERY, mark=mark, gone=gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << LEVEL_BITS, np.int64)
        held, size = [], 0
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            ids, marks = batch.column("doc_id"), batch.column("mark").to_numpy()
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for b, o, i, _, line in pieces(raw, offs):
                row, number, h, n, w = lines_of(b, o)
                parity = np.zeros((len(n), 4), U64)
                fuzzy = n >= fuzzy_words
                if fuzzy.any():
                    x, m = w[np.repeat(fuzzy, n)], n[fuzzy]
                    cut = np.concatenate(([0], np.cumsum(m)[:-1]))
                    bit = U64(1) << ((x >> U64(56)) & U64(63))
                    for k in range(4):
                        parity[fuzzy, k] = np.bitwise_xor.reduceat(np.where(x >> U64(62) == U64(k), bit, U64(0)), cut)
                    counts += np.bincount((runs_of(x, m, q)[0] >> U64(KEY_BITS - LEVEL_BITS)).astype(np.int64), minlength=len(counts))
                ok = n >= min_words
                out = np.zeros(int(ok.sum()), LINE)
                for c, v in (("known", known[row + i]), ("doc_id", ids[row + i]), ("mark", marks[row + i]), ("line", number + line), ("h", h.view(np.int64)), ("n", n), ("parity", parity)):
                    out[c] = v[ok]
                held.append(out)
                size += len(out)
                if size > DEALT:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)
        if counts.any():
            yield _table(EVERY, chunk=pa.array(np.arange(len(counts) // CHUNK)), counts=pa.array([x.tobytes() for x in counts.reshape(-1, CHUNK)], pa.binary()))

    return run


def _rows(table: pa.Table, kind=LINE, column: str = "lines") -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x), kind)


def _component(comp: pa.Table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each class is linked with another, and its component, itself if not."""
    node, component = (comp.column(c).drop_null().to_numpy() for c in ("node", "component"))
    if not len(node):
        return np.zeros(len(h), bool), h
    order = np.argsort(node)
    at = np.minimum(np.searchsorted(node[order], h), len(node) - 1)
    linked = node[order][at] == h
    return linked, np.where(linked, component[order][at], h)


def _classes(key: tuple[pa.Scalar, ...], seen: pa.Table, every: pa.Table) -> pa.Table:
    """Of one part, the classes that are seen: any of their lines."""
    h, rows = np.unique(_rows(seen, np.int64)), _rows(every)
    rows = rows[np.isin(rows["h"], h)]
    rows = rows[np.unique(rows["h"], return_index=True)[1]]
    return pa.table({"h": rows["h"], "mark": rows["mark"], "n": rows["n"].astype(np.int64)} | {p: rows["parity"][:, k].view(np.int64) for k, p in enumerate(PARITIES)})


GROUPS = {"mark": pa.int64(), "gone": pa.list_(pa.int32()), "g": pa.int64(), "doc_id": pa.int64(), "line": pa.int32()}


def _groups(key: tuple[pa.Scalar, ...], every: pa.Table, comp: pa.Table) -> pa.Table:
    """Of one part, lines that are not their class's first, by mark (gone); and the first of each class in a group (g)."""
    rows, first = _first(_rows(every))
    mark, gone = _by_mark(rows[~first])
    rows = rows[first]
    linked, g = _component(comp, rows["h"])
    rows, g = rows[linked], g[linked]
    own = _table(GROUPS, mark=pa.array(rows["mark"]), g=pa.array(g), doc_id=pa.array(rows["doc_id"], mask=rows["known"] == 0), line=pa.array(rows["line"]))
    return pa.Table.from_batches([_table(GROUPS, mark=mark, gone=gone), own])


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])


def _counted(every: DataFrame) -> np.ndarray:
    """The counters' sums over all tasks."""
    part = every.filter("chunk is not null").select("chunk", "counts").mapInArrow(_add_chunks, "chunk long, counts binary")
    both = part.groupBy("chunk").applyInArrow(lambda table: pa.Table.from_batches(_add_chunks(iter(table.to_batches())), pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])), "chunk long, counts binary")
    counts = np.zeros((1 << LEVEL_BITS) // CHUNK * CHUNK, np.int64)
    for r in both.toArrow().to_pylist():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return counts


def _dealt(fuzzy_words: int, similarity: float, q: int, part_bits: int, levels):
    """Texts -> parts of the keys that their lines show, many keys in a row: the low 32 bits of each key, then each h."""
    shift = U64(KEY_BITS - part_bits)

    def flush(held):
        h, words, n, k, place = (np.concatenate(x) for x in zip(*held, strict=True))
        # a line that is repeated shows its keys once
        own = np.zeros(len(h), bool)
        own[np.unique(h, return_index=True)[1]] = True
        every, n = np.repeat(own, n), n[own]
        k, place = k[every], place[every]
        order = np.argsort((k >> shift).astype(np.uint16) if part_bits <= 16 else k, kind="stable")  # 16 bits: by radix
        line = np.repeat(np.flatnonzero(own), n)[order]
        k, columns = k[order], [k[order].astype(np.uint32), h[line], np.minimum(words, 0xFFFF).astype(np.uint16)[line], place[order]]
        cut = np.searchsorted(k >> shift, np.arange((1 << part_bits) + 1).astype(U64))
        some = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array([c[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary()) for c in columns], names=["part", "low", "hs", "ns", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            for b, o, *_ in pieces(raw, offs):
                _, _, h, n, w = lines_of(b, o)
                fuzzy = n >= fuzzy_words
                w, h, n = w[np.repeat(fuzzy, n)], h[fuzzy], n[fuzzy]
                cut = np.concatenate(([0], np.cumsum(n)))
                for i in range(0, len(n), LINES):
                    m = n[i : i + LINES]
                    keys, places, shown = shown_runs(w[cut[i] : cut[i + len(m)]], m, similarity, q, levels.value)
                    held.append((h[i : i + LINES], m, shown, keys, places))
                    size += len(keys)
                if size > 500_000:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


MET = {"u": pa.int64(), "v": pa.int64(), "part": pa.int32(), "lines": pa.binary(), "open": pa.binary(), "n_open": pa.int64()}


def _met(part_bits: int, similarity: float):
    """Of one part's keys that several lines show: pairs (u, v) of ``STARS`` stars of each block, of lines that can be
    linked; the hashes of all that meet (lines) and the lines that can be linked with others yet (open), dealt as lines are."""
    top = KEY_BITS - part_bits

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, h, n, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("low", np.uint32), ("hs", np.int64), ("ns", np.uint16), ("places", np.uint16)))
        order = np.argsort(k)
        x = k[order]
        same = x[1:] == x[:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((h[order], k[order]))]
        k, h = k[order], h[order]
        # a line that tasks repeat shows its keys to each
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])))[: len(k)]
        k, h, n, place = k[new], h[new], n[order][new].astype(np.int64), place[order][new].astype(np.int64)
        most = edits(n, similarity)
        left, pairs, star = np.arange(len(k)), [], np.full(len(k), -1)
        for _ in range(STARS):
            first = np.flatnonzero(np.concatenate(([True], k[left][1:] != k[left][:-1]))[: len(left)])
            size = np.diff(np.concatenate((first, [len(left)])))
            pivot = np.repeat(left[first], size)
            near = near_places(n[pivot], n[left], place[pivot], place[left], np.maximum(most[pivot], most[left])) & (size.repeat(size) > 1)
            star[left[near]] = pivot[near]
            hit = near & (left != pivot)
            pairs.append(np.stack([h[pivot[hit]], h[left[hit]]]))
            left = left[~near & (left != pivot)]
        u, v = np.concatenate(pairs, axis=1)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        once = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))[: len(u)]
        # who can be linked with another line of the block than its star's pivot; of wide blocks, all
        open_ = np.zeros(len(k), bool)
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
        size = np.diff(np.concatenate((first, [len(k)])))
        open_[np.repeat(size, size) > WIDE] = True
        i, step = np.flatnonzero(np.repeat(size, size) <= WIDE), 0
        while len(i):
            step += 1
            i = i[i + step < len(k)]
            i = i[k[i] == k[i + step]]
            j = i + step
            near = near_places(n[i], n[j], place[i], place[j], np.maximum(most[i], most[j])) & (star[i] != j) & (star[j] != i)
            open_[i[near]] = open_[j[near]] = True
        out = np.zeros(int(open_.sum()), OPEN)
        out["h"], out["key"], out["place"] = h[open_], ((key[0].as_py() << top) & ~0xFFFFFFFF) | k[open_].astype(np.int64), place[open_]
        out["size"] = np.repeat(np.diff(np.concatenate(([0], np.cumsum(open_)))[np.append(first, len(k))]), size)[open_]
        part, lines = _packed(np.unique(np.concatenate((u[once], v[once], out["h"]))))
        pairs, seen = _table(MET, u=pa.array(u[once]), v=pa.array(v[once])), _table(MET, part=part, lines=lines)
        part, lines = _packed(out)
        tiles = -(-out["size"].astype(np.int64) // TILE)
        return pa.Table.from_batches([pairs, seen, _table(MET, part=part, open=lines), _table(MET, n_open=pa.array([int(tiles.sum())]))])

    return run


def _near(x: dict[str, np.ndarray], block: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of lines of one block, in different components, that pass the filters. Lines stand by number of
    words in each block, so a line meets only those whose number allows a link. Tiles of one line meet others only."""
    parity, most = np.stack([x[p].view(U64) for p in PARITIES], axis=1), edits(x["n"], similarity)
    i, step = np.arange(len(block)), 0
    while len(i):
        step += 1
        i = i[i + step < len(block)]
        j = i + step
        gap = x["n"][j] - x["n"][i]
        near = (block[i] == block[j]) & (gap <= most[j])
        i, j, gap = i[near], j[near], gap[near]
        ok = (x["c"][i] != x["c"][j]) & ((x["a"][i] == x["b"][i]) | (x["own"][i] != x["own"][j]))
        if "place" in x:
            ok &= near_places(x["n"][i], x["n"][j], x["place"][i], x["place"][j], most[j])
        u, v = i[ok], j[ok]
        ok = np.bitwise_count(parity[u] ^ parity[v]).sum(axis=1) + gap[ok] <= 2 * most[v]
        yield u[ok], v[ok]


def _labelled(n_parts: int):
    """Of one part of the lines, those of blocks that can be linked yet with their components, dealt to tiles of the blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, rows = _rows(table, OPEN, "open"), _rows(table)
        rows = rows[np.unique(rows["h"], return_index=True)[1]]
        at = np.searchsorted(rows["h"], found["h"])
        out = np.zeros(len(found), MEMBER)
        for c in ("key", "place", "h"):
            out[c] = found[c]
        out["c"], out["n"], out["parity"] = _component(table, found["h"])[1], rows["n"][at], rows["parity"][at]
        tiles = -(-found["size"].astype(np.int64) // TILE)
        out["own"] = (vec.mix(found["h"].astype(U64)) % tiles.astype(U64)).astype(np.int32)
        other = np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        out = np.repeat(out, tiles)
        out["a"], out["b"] = np.minimum(out["own"], other), np.maximum(out["own"], other)
        part = (vec.mix(out["key"].astype(U64) ^ vec.mix(out["a"].astype(U64) << U64(32) | out["b"].astype(U64))) % U64(n_parts)).astype(np.int64)
        part, members = _packed(out, part)
        return pa.table({"part": part, "members": members})

    return run


def _ordered(x: dict[str, np.ndarray], group: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns, the order of the rows in them, and the tile of each: by group, tile and number of words."""
    order = np.lexsort((x["n"], x["b"], x["a"], x[group]))
    x = {k: v[order] for k, v in x.items()}
    start = np.zeros(len(order), bool)
    start[:1] = True
    for c in (group, "a", "b"):
        start[1:] |= x[c][1:] != x[c][:-1]
    return x, order, np.cumsum(start)


def _root(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        k = root[k]
    return k


def _families(similarity: float):
    """Of tiles of blocks, pairs (u, v) that join the lines that may be linked: no more than there are lines."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = _rows(table, MEMBER, "members")
        x = {c: rows[c].astype(np.int64) for c in ("key", "a", "b", "n", "h", "c", "own", "place")} | {p: rows["parity"][:, k] for k, p in enumerate(PARITIES)}
        x, _, block = _ordered(x, "key")
        # tiles whose members, but for the stars, span components
        cut = np.flatnonzero(np.diff(block, prepend=0))
        mixed = np.minimum.reduceat(x["c"], cut) < np.maximum.reduceat(x["c"], cut)
        keep = np.repeat(mixed, np.diff(np.append(cut, len(block))))
        x, block = {k: v[keep] for k, v in x.items()}, block[keep]
        name, at = np.unique(x["h"], return_inverse=True)
        root, found = np.arange(len(name)), []
        for u, v in _near(x, block, similarity):
            u, v = at[u], at[v]
            open_ = root[u] != root[v]  # all else is joined: of a dense family only the first steps are looked at singly
            for a, b in zip(u[open_].tolist(), v[open_].tolist(), strict=True):
                p, q = _root(root, a), _root(root, b)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((a, b))
            while open_.any() and (root[root] != root).any():
                root = root[root]
        some = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": name[some[:, 0]], "v": name[some[:, 1]]})

    return run


def _family_links(similarity: float):
    """Of tiles of families, links (u, v) that join all that is linked: those between lines joined already are not sought."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, order, block = _ordered({c: table.column(c).to_numpy() for c in ("family", "a", "b", "n", "h", "c", "own", *PARITIES)}, "family")
        raw = table.column("words").to_pylist()
        words = [np.frombuffer(raw[k], np.uint32) for k in order]
        root = np.unique(x["c"], return_inverse=True)[1]
        name = np.arange(int(root.max(initial=-1)) + 1)  # of each component, the least number it is joined to
        found: list[tuple[int, int]] = []

        def find(k: int) -> int:
            while name[k] != k:
                name[k] = name[name[k]]
                k = name[k]
            return k

        def verify(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
            u, v = (np.concatenate(z) for z in zip(*held, strict=True))
            top = np.array([find(k) for k in range(len(name))])
            name[:] = top
            open_ = top[root[u]] != top[root[v]]
            u, v = u[open_], v[open_]
            if len(u):
                ok = near_lines(words, u, v, similarity)
                for a, b in zip(u[ok].tolist(), v[ok].tolist(), strict=True):
                    p, q = find(root[a]), find(root[b])
                    if p != q:
                        name[max(p, q)] = min(p, q)
                        found.append((x["h"][a], x["h"][b]))

        held, size = [], 0
        for u, v in _near(x, block, similarity):
            held.append((u, v))
            size += len(u)
            if size > BATCH:
                verify(held)
                held, size = [], 0
        if size:
            verify(held)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return run


def _filter_of(hashes: DataFrame, col: str) -> np.ndarray:
    """A bitmap of ``2 ** FILTER_BITS`` bits, in words of 64, with those of all hashes set."""
    found = hashes.select(F.shiftrightunsigned(col, 64 - FILTER_BITS).alias("b")).selectExpr("b >> 6 as k", "shiftleft(1L, cast(b & 63 as int)) as b").groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found["k"].to_numpy()] = found["b"].to_numpy()
    return out


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    x = hashes.view(U64) >> U64(64 - FILTER_BITS)
    return (bits[(x >> U64(6)).astype(np.int64)].view(U64) >> (x & U64(63))) & U64(1) == 1


def _words_of(marks, lines):
    """(mark, text) -> (h, words) of the lines that may be wanted, four bytes of hash for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(_in_filter(marks.value, whole.column("mark").to_numpy())))
            raw, offs = vec.buffers(batch.column("text"))
            for b, o, *_ in pieces(raw, offs):
                _, _, h, n, w = lines_of(b, o)
                ok = _in_filter(lines.value, h)
                code = (w[np.repeat(ok, n)] >> U64(32)).astype(np.uint32)
                cut = np.concatenate(([0], np.cumsum(n[ok]))).astype(np.int32) * 4
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(code)])], names=["h", "words"])

    return run


def bag_distance(words: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How far the words of each pair of lines differ as bags, counted in ``BINS`` bins: a word changed for another
    counts 2 at most, one added or lost 1. Unlike parities it also tells lines of repeated words apart."""
    name, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    size = np.array([len(words[k]) for k in name])
    flat = np.concatenate([words[k] for k in name])
    bins = np.bincount(np.repeat(np.arange(len(name)) * BINS, size) + flat % np.uint32(BINS), minlength=len(name) * BINS).reshape(-1, BINS).astype(np.int32)
    return np.abs(bins[at[: len(u)]] - bins[at[len(u) :]]).sum(1)


def aligned(words: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For pairs of lines, the longer first: edits that make one the other, if words were changed in place and the
    longer has its additional words at one place. The least number of edits is this at most."""
    name, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    size = np.array([len(words[k]) for k in name])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    flat = np.concatenate([words[k] for k in name])
    a, b = at[: len(u)], at[len(u) :]
    m, more = size[b], size[a] - size[b]
    cut = np.concatenate(([0], np.cumsum(m)[:-1]))
    step = np.arange(m.sum()) - np.repeat(cut, m)
    y, i = flat[np.repeat(begin[b], m) + step], np.repeat(begin[a], m) + step
    left, right = flat[i] != y, flat[i + np.repeat(more, m)] != y
    # changed words before the additional ones, which stand behind any number of words, and after them
    gain = np.concatenate(([0], np.cumsum(left.astype(np.int64) - right)))
    least = np.minimum(0, np.minimum.reduceat(gain[1:], cut) - gain[cut])
    return np.add.reduceat(right, cut, dtype=np.int64) + least + more


def near_lines(words: list[np.ndarray], u: np.ndarray, v: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each pair of lines is within its edits, by a band of the edit table for many pairs at a time."""
    n, m = (np.array([len(words[k]) for k in z], np.int64) for z in (u, v))
    u, v = np.where(n >= m, u, v), np.where(n >= m, v, u)  # the longer first
    n, m = np.maximum(n, m), np.minimum(n, m)
    most = edits(n, similarity)
    out = np.zeros(len(u), bool)
    near = np.concatenate([bag_distance(words, u[i : i + CHECKED], v[i : i + CHECKED]) for i in range(0, len(u), CHECKED)] or [n]) + n - m <= 2 * most
    some = np.flatnonzero(near & (m > 0))
    for k in (some[i : i + CHECKED] for i in range(0, len(some), CHECKED)):
        out[k] = aligned(words, u[k], v[k]) <= most[k]
    order = np.flatnonzero(near & ~out)
    order = order[np.argsort(n[order], kind="stable")]
    i, sizes = 0, n[order]
    while i < len(order):
        wide = int(most[order[i]])
        # lines of about the same length, cells of the band that fit a cache
        j = i + max(1, min(int(np.searchsorted(sizes[i:], sizes[i] * 1.15 + 2, "right")), 60_000 // (2 * wide + 1)))
        own = order[i:j]
        out[own] = _in_band([words[k] for k in u[own]], [words[k] for k in v[own]], n[own], m[own], most[own])
        i = j
    return out


def _in_band(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    band, rows = int(most.max()), int(n.max())
    width = 2 * band + 1
    kind = np.int16 if rows + width < 1 << 14 else np.int32
    far = kind(rows + width)
    x = np.zeros((len(a), rows), np.uint32)
    y = np.zeros((len(a), rows + width), np.uint32)  # shifted by the band; columns past a line's end don't reach back
    for k in range(len(a)):
        x[k, : n[k]] = a[k]
        y[k, band : band + m[k]] = b[k]
    col = np.arange(width, dtype=kind)
    # cell c of row i is column i + c - band of the table
    now = np.where(col < band, far, col - kind(band)).astype(kind)[None].repeat(len(a), 0)
    out, live, last = np.zeros(len(a), bool), np.arange(len(a)), n.min()
    for i in range(1, rows + 1):
        change = now + (y[:, i - 1 : i - 1 + width] != x[:, i - 1, None])
        np.minimum(change[:, :-1], now[:, 1:] + kind(1), out=change[:, :-1])
        if i <= band:
            change[:, : band - i] = far
            change[:, band - i] = i  # column 0
        change -= col
        np.minimum.accumulate(change, axis=1, out=change)
        now = change + col
        ended = np.zeros(len(live), bool)
        if i >= last:
            ended = n[live] == i
            k = live[ended]
            cell = m[k] - i + band  # within the band, as the gap is within the edits
            inside = (cell >= 0) & (cell < width)
            out[k] = inside & (now[ended, np.clip(cell, 0, width - 1)] <= most[k])
        if i % 8 == 0 or ended.any():
            keep = ~ended & (now.min(axis=1) <= most[live])
            if not keep.any():
                break
            if ended.any() or 4 * keep.sum() < 3 * len(keep):
                live, now, x, y = live[keep], now[keep], x[keep], y[keep]
    return out


def _linked(similarity: float):
    """(u, v, a, b) -> the pairs whose words are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                words = [np.frombuffer(x, np.uint32) for c in ("a", "b") for x in batch.column(c).to_pylist()]
                k = np.arange(batch.num_rows)
                yield batch.select(["u", "v"]).filter(pa.array(near_lines(words, k, k + batch.num_rows, similarity)))

    return run


def _remove(columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out, n, gone = [], [], []
                for text, drop in zip(b.column("text").to_pylist(), b.column("_dropped_lines").to_pylist(), strict=True):
                    n.append(0 if text is None else text.count("\n") + 1)
                    drop = set(drop or ())
                    gone.append(len(drop))
                    if drop:
                        text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                    out.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in columns] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return run


def _mark() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def line_part(h: str) -> F.Column:
    """The part of a class's lines."""
    return F.shiftrightunsigned(h, 64 - LINE_BITS).cast("int").alias("part")


def line_groups(docs: DataFrame, min_words: int = 5, fuzzy_words: int = 6, similarity: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Lines (part, lines, or mark, gone: not their class's first) and, for lines tied by verified links, (node: h, component: group)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.col("text").cast("string").alias("text")).filter("text is not null")
    q = gram_width(similarity, fuzzy_words)
    every = written(texts.mapInArrow(_all_lines(min_words, fuzzy_words, q), "part int, lines binary, mark long, gone array<int>, chunk long, counts binary"), "line-table")
    lines = every.filter("part is not null").select("part", "lines")
    counts = _counted(every)
    part_bits = max(KEY_BITS - 32, int(counts.sum() / PART_RUNS).bit_length())
    levels = spark.sparkContext.broadcast(np.ceil(np.log2(counts + 1.0)).astype(np.uint8))
    dealt = texts.select("text").mapInArrow(_dealt(fuzzy_words, similarity, q, part_bits, levels), "part long, low binary, hs binary, ns binary, places binary")
    met = written(dealt.groupBy("part").applyInArrow(_met(part_bits, similarity), "u long, v long, part int, lines binary, open binary, n_open long"), "line-blocks")
    # classes that meet another; any occurrence stands for its class here
    seen = met.filter("lines is not null").select("part", "lines")
    one = written(seen.groupBy("part").cogroup(lines.groupBy("part")).applyInArrow(_classes, "h long, mark long, n long, p0 long, p1 long, p2 long, p3 long"), "line-classes")

    def close(a: str, b: str):
        x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
        bits = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in PARITIES), F.lit(0))
        allowed = F.floor((1 - similarity) * F.greatest(x, y) + 1e-9)
        gap = F.abs(x - y)
        # a word changed for another flips two bits, a word added or lost one: edits are half of bits and gap at least
        return (gap <= allowed) & (bits + gap <= 2 * allowed)

    def words_of(need: DataFrame) -> DataFrame:
        """(h, words) of the lines named in ``need`` (h, and mark of a text that has it), read where they stand."""
        with shuffles_end(spark):
            marks, hashes = (spark.sparkContext.broadcast(_filter_of(need, c)) for c in ("mark", "h"))
        return written(texts.select("mark", "text").mapInArrow(_words_of(marks, hashes), "h long, words binary").groupBy("h").agg(F.first("words").alias("words")), "line-words")

    star = met.filter("u is not null").select("u", "v").distinct()
    star = star.join(one.alias("x"), F.col("u") == F.col("x.h")).join(one.alias("y"), F.col("v") == F.col("y.h")).filter(close("x", "y"))
    star = written(star.select("u", "v", F.col("x.mark").alias("u_mark"), F.col("y.mark").alias("v_mark")), "line-stars")
    words = words_of(star.select(F.explode(F.array(*(F.struct(F.col(c).alias("h"), F.col(f"{c}_mark").alias("mark")) for c in "uv"))).alias("x")).select("x.*"))
    side = lambda pair, own: words.select(F.col("h").alias(pair), F.col("words").alias(own))
    links = written(star.select("u", "v").join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_linked(similarity), "u long, v long"), "line-links")
    comp = components(links)

    # blocks whose members, but for the stars, span components: lines that may be linked are joined to families
    none = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    label = met.filter("open is not null").select("part", "open", *none(lines="binary", node="long", component="long"))
    label = label.unionByName(lines.select("part", "lines", *none(open="binary", node="long", component="long")))
    label = label.unionByName(comp.select(line_part("node"), "node", "component", *none(lines="binary", open="binary")))
    n_parts = int(met.agg(F.coalesce(F.sum("n_open"), F.lit(0))).first()[0] / PART_LINES) + 8
    blocks = written(label.groupBy("part").applyInArrow(_labelled(n_parts), "part long, members binary"), "line-mixed")
    near = written(blocks.groupBy("part").applyInArrow(_families(similarity), "u long, v long").distinct(), "line-families")
    if not near.isEmpty():
        family = components(near).select(F.col("node").alias("h"), F.col("component").alias("family"))
        rows = family.join(comp.select(F.col("node").alias("h"), "component"), "h", "left").select("h", "family", F.coalesce("component", "h").alias("c"))
        known = written(rows.join(one, "h"), "line-known")
        rows = known.drop("mark").join(words_of(known.select("h", "mark")), "h").join(family.groupBy("family").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "family")
        rows = written(rows, "line-members")
        # dealt to pairs of tiles (a, b) of their family, and those to parts
        n_parts = int(rows.agg(F.sum("tiles")).first()[0] / PART_LINES) + 8
        tiled = rows.withColumn("own", F.expr("pmod(xxhash64(h), tiles)")).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
        tiled = tiled.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "tiles")
        more = written(tiled.groupBy(F.pmod(F.xxhash64("family", "a", "b"), F.lit(n_parts)).alias("part")).applyInArrow(_family_links(similarity), "u long, v long"), "line-links")
        comp = components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
        drop_written(known, rows, more)
    drop_written(one, met, star, words, links, blocks, near)
    return every, comp


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), **params) -> DataFrame:
    """``columns`` with ``text`` less its repeated lines, n_lines, n_dropped.

    The first occurrence of each group by (doc_id, line) stays, within a document and across documents. Lines of
    fewer than ``min_words`` words are never dropped, nor are documents, which may become empty; lines of fewer than
    ``fuzzy_words`` words (of which 0.85 allows no edit) are dropped where equal. Null text: null, no lines. Very long
    texts are cut between lines for the search, never shortened. Rows that repeat doc_id and text are one document:
    both keep the same lines. Null ids come first. An empty table gives no rows; other columns pass if named, but for n_lines and n_dropped.
    """
    refuse_clash(columns, "n_lines", "n_dropped")
    every, comp = line_groups(docs, **params)
    at = F.struct("doc_id", "mark", "line")
    comp = comp.select("node", "component", line_part("node"))
    lines = every.filter("part is not null").select("part", "lines")
    group = written(lines.groupBy("part").cogroup(comp.groupBy("part")).applyInArrow(_groups, "mark long, gone array<int>, g long, doc_id long, line int"), "line-groups")
    linked = group.filter("g is not null").select("g", "doc_id", "mark", "line")
    # written, so that a hot group's join can be split
    first = written(linked.groupBy("g").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").select("g", "first"), "line-first")
    gone = linked.join(first, "g").filter(~at.eqNullSafe(F.col("first"))).select("mark", F.array("line").alias("gone"))
    for rows in (every, group):
        gone = gone.unionByName(rows.filter("gone is not null").select("mark", "gone"))
    dropped = gone.groupBy(F.col("mark").alias("_line_mark")).agg(F.flatten(F.collect_list("gone")).alias("_dropped_lines"))
    own = docs.select(*columns, _mark().alias("_line_mark"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    # a table of the dropped lines by mark, so that texts needn't be sorted
    return own.join(dropped.hint("shuffle_hash"), "_line_mark", "left").select(*columns, "_dropped_lines").mapInArrow(_remove(columns), f"{kinds}, n_lines long, n_dropped long")
