"""Compressing vectors to short codes with integer codebooks (product quantisation).

A vector's components become integers, its dimensions are cut into equal consecutive parts, and each part is coded by
the nearest of the few entries of that part's codebook. Everything is integer arithmetic, so the same rows give the
same codes whatever their order, their partitions or the machine.

The codebooks (parts x entries x width numbers, a size fixed by parameters and not by rows) are broadcast. Arrow batches
find all distances of a part at once as |x|^2 - 2 x.c + |c|^2 with an exact int64 matrix product; the first least wins.
A round of training leaves each task with one sum per entry; those are merged by a grouped shuffle, and the driver
divides them. Vectors are read once a round and never shuffled.

What is coded: rows whose vector isn't null and holds no null, NaN or infinity ("kept"). Of those, a vector whose length
isn't that of the codebooks, or with a component of ``limit(dims)`` or more, has a null code and error and is left out of
training; with one length of 64 and components under 2^18 there are none. Ids needn't be distinct: rows of one id are
coded each, and the first entries go by id, then vector. A null id comes last in that order. Repeated rows count as
often as they occur. Other columns are ignored unless named in ``columns``; the names ``codes`` and ``error`` are refused.
An empty table gives no codebooks and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, ShortType, StructField, StructType


@dataclass
class Codebooks:
    """``entries[part, entry, position]``; ``scale``: a component x stands for floor(scale * x)."""

    entries: np.ndarray
    scale: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal, comma-joined by part, entry, position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit(dims: int, scale: int = 256) -> float:
    """Components under this bound (in absolute value) can't overflow 64 bits in any distance or error."""
    return 2.0**29 / np.sqrt(max(dims, 1)) / scale


def kept(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector holds finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return rows.filter(F.col(vector).isNotNull() & F.forall(vector, finite))


def _codable(vector: str, dims: int, scale: int):
    bound = F.lit(limit(dims, scale))
    return (F.size(vector) == dims) & F.forall(vector, lambda x: F.abs(x.cast("double")) < bound)


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """A list column without nulls, all of length ``dims``, as floor(scale * x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of ``book`` for each row of ``x``, and the squared distance, both exact."""
    off = (book * book).sum(1)[None, :] - 2 * (x @ book.T)  # |c|^2 - 2 x.c
    at = off.argmin(1)
    return at, off[np.arange(len(x)), at] + (x * x).sum(1)


def _batches(table: pa.Table | pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for start in range(0, table.num_rows, rows):
        yield table.slice(start, rows)


def first_entries(rows: DataFrame, vector: str, id_col: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The vectors of the smallest ids, cut into parts. Their number is ``entries`` at most, so they may be collected."""
    usable = kept(rows.select(F.col(id_col).alias("i"), F.col(vector).alias("v")), "v").filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.asc_nulls_last("i"), "v"]
    top = usable.orderBy(*order).limit(entries).select("v", F.size("v").alias("n")).collect()
    if not top:
        return None
    dims = top[0].n
    top = usable.filter(_codable("v", dims, scale)).orderBy(*order).limit(entries).select("v").collect()
    if not top:
        return None
    x = np.floor(np.array([r.v for r in top], dtype=np.float64) * scale).astype(np.int64)
    return np.ascontiguousarray(x.reshape(len(top), parts, dims // parts).transpose(1, 0, 2))


def _round(rows: DataFrame, vector: str, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: every part to its nearest entry, then each entry to the floor of its parts' mean."""
    parts, k, width = books.shape
    dims, sent = parts * width, rows.sparkSession.sparkContext.broadcast(books)
    names = [f"s{j}" for j in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, total = sent.value, np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for big in batches:
            for b in _batches(big):
                x = integers(b.column(0), dims, scale).reshape(-1, parts, width)
                for p in range(parts):
                    at, _ = nearest(x[:, p], own[p])
                    n[p] += np.bincount(at, minlength=k)
                    np.add.at(total[p], at, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(total[p, e, j]) for j in range(width))], ["part", "entry", "n", *names])

    schema = "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names)
    own = kept(rows.select(F.col(vector).alias("v")), "v").filter(_codable("v", dims, scale))
    merged = own.mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))
    out = books.copy()  # entries that nothing is near stay
    for r in merged.collect():  # parts * entries rows at most
        out[r.part, r.entry] = [r[s] // r.n for s in names]
    sent.unpersist()
    return out


def train(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds from the vectors of the smallest ids; None if no vector can be coded."""
    if min(parts, entries) < 1 or rounds < 0:
        raise ValueError("parts and entries must be positive")
    books = first_entries(rows, vector, id_col, parts, entries, scale)
    if books is None:
        return None
    for _ in range(rounds):
        books = _round(rows, vector, books, scale)
    return Codebooks(books, scale)


def encode(rows: DataFrame, books: Codebooks | None, vector: str = "embedding", columns: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``columns``, codes (array<short>, an index for each part) and error (squared distance, summed over parts) of the kept rows."""
    if {"codes", "error"} & set(columns):
        raise ValueError("rename the columns codes and error: the result has its own")
    own = StructType([rows.schema[c] for c in columns])
    schema = StructType([*own.fields, StructField("codes", ArrayType(ShortType())), StructField("error", LongType())])
    if books is None:
        bad = kept(rows.select(*columns, F.col(vector).alias("_vector")), "_vector").drop("_vector")
        return bad.select(*columns, F.lit(None).cast("array<short>").alias("codes"), F.lit(None).cast("long").alias("error"))
    parts, _, width = books.entries.shape
    dims, scale, last = books.dims, books.scale, len(columns)
    sent = rows.sparkSession.sparkContext.broadcast(books.entries)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        for big in batches:
            for b in _batches(big):
                ok = b.column(last + 1)
                x = integers(b.column(last).filter(ok), dims, scale).reshape(-1, parts, width)
                codes, error = np.empty((len(x), parts), np.int16), np.zeros(len(x), np.int64)
                for p in range(parts):
                    codes[:, p], d = nearest(x[:, p], entries[p])
                    error += d
                where = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
                at = np.full(b.num_rows, -1)
                at[where] = np.arange(len(where))
                take = pa.array(at, mask=at < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * parts + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(last)), lists.take(take), pa.array(error).take(take)], schema.names)

    given = kept(rows.select(*columns, F.col(vector).alias("_vector")), "_vector").withColumn("_ok", _codable("_vector", dims, scale))
    return given.mapInArrow(code, schema)


def decode(coded: DataFrame, books: Codebooks, columns: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``columns`` and the vector (array<double>) that each row of ``encode`` stands for; null where codes is null."""
    parts, _, width = books.entries.shape
    own, scale, last = StructType([coded.schema[c] for c in columns]), books.scale, len(columns)
    sent = coded.sparkSession.sparkContext.broadcast(books.entries)
    schema = StructType([*own.fields, StructField("vector", ArrayType(DoubleType()))])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(last)
            flat = codes.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            x = (sent.value[np.arange(parts)[None, :], flat] + 0.5) / scale
            ends = np.concatenate(([0], np.cumsum(codes.is_valid().to_numpy(zero_copy_only=False)))) * parts * width
            offsets = pa.array(ends.astype(np.int32), mask=np.append(codes.is_null().to_numpy(zero_copy_only=False), False))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(last)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], schema.names)

    return coded.select(*columns, "codes").mapInArrow(restore, schema)


def hex_code(codes: str = "codes"):
    """Two hex digits for each index, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")


def with_group_error(coded: DataFrame, group: str, name: str) -> DataFrame:
    """Adds the error summed over rows of equal ``group`` (nulls together) as ``name``; saturates at the largest long.

    The sums are partially aggregated and joined back; a group with a third of all rows is one row on one side, and
    adaptive execution broadcasts the sums if they are small or else splits the group.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col(group).alias("_group")).agg(total.alias(name))
    return coded.join(sums, coded[group].eqNullSafe(sums["_group"])).drop("_group")
