"""Vectorised text primitives over UTF-8 buffers.

Texts arrive in Arrow batches. All word classes used here are decided by ASCII bytes alone (bytes of
0x80 and more are always word bytes), so words can be found on the raw UTF-8 bytes without decoding.
Work is done on slices of about a megabyte, which bounds memory whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20


def _table(test) -> np.ndarray:
    return np.array([test(i) for i in range(256)], dtype=bool)


#: ``[^\x20\x09-\x0D]+``
WORD = _table(lambda i: not (i == 0x20 or 9 <= i <= 13))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on text whose A-Z were lower-cased
ALNUM = _table(lambda i: 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | U64(1)
STEP = U64(0x9E3779B97F4A7C15)
STEP_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SEQ = _rng.integers(1, 2**64, 64, dtype=np.uint64) | U64(1)
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        for k, base in enumerate((STEP, STEP_INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _pow[k] = np.cumprod(x, dtype=U64)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_spans(b: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of the rows that ``offs`` delimits in ``b``."""
    if not len(b):
        e = np.zeros(0, np.int64)
        return e, e, e
    own = table[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offs] = True
    first = own.copy()
    first[1:] &= ~own[:-1] | edge[1:-1]
    last = own.copy()
    last[:-1] &= ~own[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums of a polynomial over random byte codes."""
    up, down = _powers(len(b))
    c = np.zeros(len(b) + 1, U64)
    np.cumsum(BYTE_CODE[b] * up[: len(b)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and their rows; a row with fewer words gives one run of all."""
    out = np.zeros(max(0, len(words) - width + 1), U64)
    for k in range(width):
        out += words[k : len(words) - width + 1 + k] * SEQ[k]
    ok = rows[: len(out)] == rows[width - 1 :] if len(out) else np.zeros(0, bool)
    out, where = mix(out[ok] + U64(width)), rows[: len(ok)][ok]
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))[short]
        extra = np.zeros(len(short), U64)
        for k in range(width - 1):
            more = count[short] > k
            extra[more] += words[first[more] + k] * SEQ[k]
        out, where = np.concatenate((out, mix(extra + count[short].astype(U64)))), np.concatenate((where, short))
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where


def distinct_shingles(b: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct shingle hashes of its lower-cased words."""
    b = LOWER[b]
    s, e, rows = word_spans(b, offs)
    sh, where = shingles(span_hash(b, s, e), rows, len(offs) - 1, width)
    cut = np.searchsorted(where, np.arange(len(offs)))
    return [np.unique(sh[cut[i] : cut[i + 1]]) for i in range(len(offs) - 1)]
