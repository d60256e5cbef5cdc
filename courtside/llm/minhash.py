"""MinHash near-duplicate groups by tensored banding.

Two small collections of ``half_keys`` half keys are computed, each half key from ``rows`` MinHash values. The
``half_keys ** 2`` table keys are all pairs of one half key of either collection, so 49 tables of 4 rows cost
28 MinHash values in place of 196. A pair of similarity s shares a table with probability
``(1 - (1 - s**rows) ** half_keys) ** 2``: 0.9997 at s = 0.85.

How it stays near linear without losing links:

1. Documents with equal shingle sets form one class, found by a hash of the set's digest; one row of it goes on.
2. Each bucket pairs its members with its least member (a star, not all pairs). Pairs are confirmed on full
   shingle sets, read from the texts, and joined to components.
3. Members of different components around one pivot meet in one task (of many, in tiles) if they share one of the
   rarest shingles by which they differ from it, which any link between them needs (a prefix filter, see ``_around``).
   What two differ by follows exactly from what each differs from the pivot by, so no pair is emitted but links that
   join. Members too unlike the pivot to be compared with it are paired with all others by a prefix filter on their own
   sets. Those pairs pass two cuts: the ratio of the set sizes (exact), and the number of unequal 4-bit MinHash
   remainders (over four standard deviations). They are confirmed on full sets.

Buckets are met by partially aggregated ``groupBy`` and sort-merge joins, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .components import components
from .shared import drop_written, written

U64 = np.uint64
#: of ``half_keys * 2 * rows`` 4-bit remainders, a linked pair (15 % unequal sets) has 14 % unequal on average;
#: more than this share is over four standard deviations away
UNEQUAL_SHARE = 0.5
#: members of a pivot's group in one tile; shingles of the tiles that one task compares
TILE, PART_SHINGLES = 1 << 11, 1_000_000


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(85))
    return rng.integers(1, 2**64, n, dtype=np.uint64) | U64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def _signatures(width: int, rows: int, half_keys: int):
    mul, add = _family(2 * half_keys * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            ids, mark = batch.column("doc_id"), batch.column("mark")
            for i, j in vec.slices(offs):
                own = vec.distinct_shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                n = np.array([len(x) for x in own], np.int64)
                full = np.flatnonzero(n)
                lo, hi = np.zeros(j - i, U64), np.zeros(j - i, U64)
                half = np.zeros((j - i, 2 * half_keys), U64)
                bits = np.zeros((4, j - i), U64)
                if len(full):
                    all_, cut = np.concatenate([own[k] for k in full]), np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    lo[full] = np.add.reduceat(all_, cut)
                    hi[full] = np.add.reduceat(vec.mix(all_ ^ vec.STEP), cut)
                    for h in range(2 * half_keys * rows):
                        low = np.minimum.reduceat((all_ ^ add[h]) * mul[h], cut)
                        half[full, h // rows] = vec.mix(half[full, h // rows] * U64(31) + low)
                        low = vec.mix(low)
                        for k in range(4):
                            bits[k, full] |= ((low >> U64(k)) & U64(1)) << U64(h % 64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), mark.slice(i, j - i), pa.array(n), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))]
                    + [pa.array(b.view(np.int64)) for b in bits]
                    + [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(half[:, c : c + half_keys]).ravel().view(np.int64)), half_keys).cast(pa.list_(pa.int64())) for c in (0, half_keys)],
                    names=["doc_id", "mark", "n_shingles", "sig_lo", "sig_hi", "b0", "b1", "b2", "b3", "left_keys", "right_keys"],
                )

    return run


def _mark() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def signatures(docs: DataFrame, width: int = 5, rows: int = 2, half_keys: int = 7) -> DataFrame:
    """doc_id, hash of id and text, set size, 128-bit digest of the set, 4 planes of MinHash bits and both half-key collections."""
    if 2 * rows * half_keys > 64:
        raise ValueError("at most 64 MinHash values fit the bit planes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signatures(width, rows, half_keys), "doc_id long, mark long, n_shingles long, sig_lo long, sig_hi long, b0 long, b1 long, b2 long, b3 long, left_keys array<long>, right_keys array<long>"
    )


def _shingles(width: int):
    """(rep, text) -> one row for each distinct shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = vec.buffers(batch.column("text"))
            for i, j in vec.slices(offs):
                own = vec.distinct_shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                take = pa.array(np.repeat(np.arange(j - i), [len(x) for x in own]))
                every = np.concatenate([np.asarray(x, U64) for x in own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i).take(take), pa.array(every)], names=["rep", "shingle"])

    return run


def _compare(width: int, percent: int):
    """For rows (u, v, text_u, text_v): whether they are linked, and by which shingles v differs from u."""

    def sets(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
        raw, offs = vec.buffers(batch.column(name))
        out = []
        for i, j in vec.slices(offs):
            out += vec.distinct_shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                linked, differs = [], []
                for a, b in zip(sets(batch, "text_u"), sets(batch, "text_v"), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0
                    linked.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                    differs.append(np.setxor1d(a, b, assume_unique=True).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_()), pa.array(differs, pa.list_(pa.int64()))], names=["u", "v", "linked", "differs"]
                )

    return run


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _joining(x: dict[str, np.ndarray], differs: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Of members of one pivot's group, links that join different components: as many as join all that is linked."""
    d, n, m = np.array([len(s) for s in differs]), x["n"], len(differs)
    own = np.repeat(np.arange(m), d)
    code, often = np.unique(np.concatenate(differs), return_inverse=True, return_counts=True)[1:]
    met = np.zeros(len(often), bool)
    met[code[x["away"][own]]] = True
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(np.where(met, often, 0), kind="stable")] = np.arange(len(often))
    # shingles that no other member has go first, or none in another component than the pivot: they only shorten the prefix
    keep = (often[code] > 1) & met[code]
    own, code = own[keep], rank[code[keep]]
    order = np.lexsort((code, own))
    own, code = own[order], code[order]
    size = np.bincount(own, minlength=m)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    few = np.maximum(1, d - n * (100 - percent) // percent)
    half = (d - (100 - percent) * np.maximum(n - x["nu"], 0) / (100 + percent)) // 2 + 1
    as_w = np.clip(size - few + 1, 0, size)
    as_v = np.clip(size - np.maximum(few, half.astype(np.int64)) + 1, 0, size)
    shown = _gather(start, as_v)
    shown = shown[np.argsort(code[shown], kind="stable")]
    first = np.searchsorted(code[shown], np.arange(len(often) + 1))
    root = np.unique(x["c"], return_inverse=True)[1]
    has = np.zeros(len(often), bool)
    for w in np.flatnonzero(x["away"] & (as_w > 0)):
        k = code[start[w] : start[w] + as_w[w]]
        v = np.unique(own[shown[_gather(first[k], first[k + 1] - first[k])]])
        v = v[(root[v] != root[w]) & ((x["a"][w] == x["b"][w]) | (x["own"][v] != x["own"][w]))]
        v = v[(100 + percent) * np.abs(d[v] - d[w]) <= (100 - percent) * (n[v] + n[w])]
        if not len(v):
            continue
        mine = code[start[w] : start[w] + size[w]]
        has[mine] = True
        every = np.concatenate(([0], np.cumsum(has[code[_gather(start[v], size[v])]])))
        ends = np.cumsum(size[v])
        shared = every[ends] - every[ends - size[v]]
        has[mine] = False
        both = (n[v] + n[w] - (d[v] + d[w] - 2 * shared)) // 2
        for k in v[(both > 0) & (100 * both >= percent * (n[v] + n[w] - both))]:
            if root[k] != root[w]:
                yield x["v"][w], x["v"][k]
                root[root == root[k]] = root[w]


def _around(percent: int):
    """Of tiles of pivots' members, links (u, v) between components.

    D(v) are the shingles by which v differs from its pivot u; v and w differ by D(v) ^ D(w). At a link they differ by
    at most c * (n(v) + n(w)), c being (100 - percent) / (100 + percent), and by at most n * (100 - percent) / percent
    of either; w, not linked with u, differs from u by more than c * (n(u) + n(w)). So D(v) and D(w) share at least
    ``few`` shingles, and ``half`` of D(v), and under any one order of shingles the first size - that + 1 of both meet
    (prefix filter). The order is rarest first among the tile's members.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = {c: table.column(c).to_numpy() for c in ("u", "a", "b", "own", "v", "c", "away", "nu", "n")}
        order = np.lexsort((x["v"], x["b"], x["a"], x["u"]))
        x = {k: v[order] for k, v in x.items()}
        lists = table.column("differs").combine_chunks()
        flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[c][1:] != x[c][:-1] for c in ("u", "a", "b")], axis=0)
        cut = np.append(np.flatnonzero(new), len(order))
        found = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            found += _joining({k: v[i:j] for k, v in x.items()}, [flat[offs[k] : offs[k + 1]] for k in order[i:j]], percent)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return run


def _compared(pairs: DataFrame, named: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes compared on their full shingle sets. ``named``: (doc_id, mark) of classes."""
    name = lambda c: named.select(F.col("doc_id").alias(c), F.col("mark").alias(f"mark_{c}"))
    a, b = (texts.select(F.col("mark").alias(f"mark_{c}"), F.col("text").alias(f"text_{c}")) for c in "uv")
    marked = pairs.join(name("u"), "u").join(name("v"), "v")
    return marked.join(a, "mark_u").join(b, "mark_v").select("u", "v", "text_u", "text_v").mapInArrow(_compare(width, percent), "u long, v long, linked boolean, differs array<long>")


def _plausible(a: str, b: str, percent: int, unequal: int):
    unlike = None
    for k in range(4):
        x = F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))
        unlike = x if unlike is None else unlike.bitwiseOR(x)
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.bit_count(unlike) <= unequal)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, rows: int = 2, half_keys: int = 7) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id linked directly or through others), kept.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct
    ``width``-word shingles (A-Z lower-cased, words split at ASCII white space). Null, empty and wordless texts
    have an empty set and are linked with nothing, each is its own component. Rows that repeat a doc_id: each
    row is returned; rows of one id count as one document if their sets are equal, otherwise the id joins the
    components of all its texts. A null doc_id is returned as its own, kept. Columns besides doc_id and text
    are ignored; an empty table gives no rows.
    """
    sig = written(signatures(docs, width, rows, half_keys), "minhash-signatures").withColumn("cid", F.xxhash64("sig_lo", "sig_hi", "n_shingles"))
    some = sig.filter("n_shingles > 0 and doc_id is not null")
    # a class goes by its least doc_id, so that an original is met before its copies; of classes that share one (an id
    # with several texts) all but one go by a hash. The row of least hash stands for its class
    classes = some.groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark"))
    one = classes.groupBy("least").agg(F.min("cid").alias("first_cid"))
    classes = written(classes.join(one, "least").select("cid", "least", "mark", F.when(F.col("cid") == F.col("first_cid"), F.col("least")).otherwise(F.col("mark")).alias("rep")), "minhash-named")
    reps = some.drop("doc_id", "sig_lo", "sig_hi", "cid").join(classes.select("mark", F.col("rep").alias("doc_id")), "mark").dropDuplicates(["mark"])
    reps = written(reps, "minhash-classes")
    meta = reps.select("doc_id", "n_shingles", "b0", "b1", "b2", "b3")
    table_keys = F.expr(f"flatten(transform(left_keys, (a, i) -> transform(right_keys, (b, j) -> xxhash64(a, b, i * {half_keys} + j))))")
    rows_ = reps.select(F.col("doc_id").alias("rep"), F.explode(table_keys).alias("key"))
    shared = rows_.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most")).filter("pivot <> most").drop("most")
    buckets = written(rows_.join(shared, "key"), "minhash-buckets")

    unequal = int(2 * rows * half_keys * UNEQUAL_SHARE)
    named = reps.select("doc_id", "mark")
    texts = docs.select(_mark().alias("mark"), F.col("text").cast("string").alias("text")).join(reps.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])

    def plausible(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(meta.alias("x"), F.col("u") == F.col("x.doc_id")).join(meta.alias("y"), F.col("v") == F.col("y.doc_id")).filter(_plausible("x", "y", percent, unequal)).select("u", "v")
        )

    stars = written(plausible(buckets.filter("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()), "minhash-stars")
    stars = written(_compared(stars, named, texts, width, percent), "minhash-compared")
    links = stars.filter("linked").select("u", "v")
    comp = components(links)

    # pairs around one pivot that are in different components, where any member is in another than the pivot's
    label = comp.select("node", F.col("component").alias("c"))
    sizes = reps.select("doc_id", "n_shingles")
    around = (
        stars.join(label.withColumnsRenamed({"node": "u", "c": "cu"}), "u", "left")
        .join(label.withColumnsRenamed({"node": "v", "c": "cv"}), "v", "left")
        .select("u", "v", F.coalesce("cv", "v").alias("c"), (F.coalesce("cu", "u") != F.coalesce("cv", "v")).alias("away"), "differs")
    )
    open_ = around.groupBy("u").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.bool_or("away").alias("open")).filter("open").select("u", "tiles")
    around = around.join(open_, "u").join(sizes.withColumnsRenamed({"doc_id": "u", "n_shingles": "nu"}), "u").join(sizes.withColumnsRenamed({"doc_id": "v", "n_shingles": "n"}), "v")
    around = written(around, "minhash-around")
    n_parts = int((around.agg(F.sum(F.col("tiles") * F.size("differs"))).first()[0] or 0) / PART_SHINGLES) + 8
    tiles = around.withColumn("own", F.expr("pmod(xxhash64(v), tiles)")).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    tiles = tiles.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).withColumn("part", F.pmod(F.xxhash64("u", "a", "b"), F.lit(n_parts)))
    links = links.unionByName(written(tiles.select("part", "u", "a", "b", "own", "v", "c", "away", "nu", "n", "differs").groupBy("part").applyInArrow(_around(percent), "u long, v long"), "minhash-links"))

    # Members of a bucket too unlike its pivot to be compared with it, against all others (what is linked with the
    # pivot can be linked with them as well: a text that grows). A link needs percent % of the larger set in common,
    # so under one order of shingles the first size - percent % + 1 of both meet. Shingles seen in one component only
    # go first (they link nothing new), then the rarest: what many share is not met. Two that were compared with the
    # same pivot (there are at most half_keys ** 2 of them) have been paired around it above, so they are left out.
    known = buckets.filter("rep <> pivot").join(stars.select(F.col("u").alias("pivot"), F.col("v").alias("rep"), "linked"), ["pivot", "rep"], "left")
    loose = known.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    far = loose.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.bool_or(F.col("linked").isNull()).alias("far")).filter("c0 <> c1 and far").select("key")
    strange = loose.join(far, "key").groupBy("rep", "c").agg(F.bool_or(F.col("linked").isNull()).alias("far")).join(sizes.withColumnsRenamed({"doc_id": "rep", "n_shingles": "n"}), "rep")
    met_with = stars.groupBy(F.col("v").alias("rep")).agg(F.collect_set("u").alias("pivots"))
    strange = strange.join(met_with, "rep", "left").withColumn("pivots", F.array_append(F.coalesce("pivots", F.array().cast("array<long>")), F.col("rep")))
    strange = written(strange.withColumn("p", F.array_min("pivots")), "minhash-far")
    own = strange.select("rep").join(named, F.col("rep") == F.col("doc_id")).join(texts, "mark").select("rep", "text").mapInArrow(_shingles(width), "rep long, shingle long").join(strange.drop("pivots"), "rep")
    own = own_sh = written(own, "minhash-far-shingles")
    often = own.groupBy("shingle").agg(F.count("*").alias("often"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("p").alias("p0"), F.max("p").alias("p1"), F.bool_or("far").alias("met")).filter("c0 <> c1 and p0 <> p1 and met").select("shingle", "often")
    first = own.join(often, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("often", "shingle")))
    first = first.withColumn("alone", F.col("n") - F.count("*").over(Window.partitionBy("rep")))
    first = written(first.filter(F.expr(f"rank + alone <= n - ({percent} * n + 99) div 100 + 1")).select("rep", "shingle").join(strange, "rep"), "minhash-far-prefixes")
    distant = (
        first.filter("far").alias("x").join(first.alias("y"), "shingle")
        .filter((F.col("x.c") != F.col("y.c")) & ~F.arrays_overlap("x.pivots", "y.pivots") & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
        .select(F.least("x.rep", "y.rep").alias("u"), F.greatest("x.rep", "y.rep").alias("v"))
        .distinct()
    )
    rest = written(plausible(distant).join(stars.select("u", "v"), ["u", "v"], "left_anti"), "minhash-rest")
    links = links.unionByName(written(_compared(rest, named, texts, width, percent).filter("linked").select("u", "v"), "minhash-links"))
    # an id that repeats with different texts ties their classes together
    several = some.groupBy("doc_id").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1")).filter("c0 <> c1").select("doc_id")
    tied = some.join(several, "doc_id").select("doc_id", "cid").distinct().join(classes, "cid").select("doc_id", "rep")
    tied = tied.join(tied.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v").filter("u <> v")
    comp = components(links.unionByName(tied))
    # each class with the least id of its component; written, so that a large class's join can be split
    own = classes.join(comp, F.col("rep") == F.col("node"), "left").select("cid", "least", F.coalesce("component", "rep").alias("c"))
    least = own.groupBy("c").agg(F.min("least").alias("component_id"))
    least = written(own.join(least, "c").select("cid", "component_id"), "minhash-components")
    drop_written(classes, reps, buckets, stars, around, strange, own_sh, first, rest)
    return (
        sig.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("cid")).alias("cid"))
        .join(least, "cid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
