"""Ridge ratings from offence blocks: design, sufficient statistics, grouped cross-validation, priors, value.

The design never leaves Spark. A block touches 10 players; blocks of the same ones are summed first, then the weighted
products of their columns, of the target and of a one for the intercept for each two columns, with all folds as an array.
What folds, penalties and prior means ask for follows from that sparse table of sums by conjugate gradients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import plain_unions
from ..tables import durable, forget

#: fixed values
LAMBDAS = (100.0, 300.0, 1000.0, 2000.0, 3000.0, 5000.0, 8000.0, 15000.0, 30000.0)
REPLACEMENT, POINTS_PER_WIN, FOLDS, MIN_POSSESSIONS = -2.5, 30.0, 5, 1.0
LEADERBOARD = ["player_id", "name", "offense", "defense", "total", "value", "wins_added", "possessions"]
PROJECTIONS = ["player_id", "name", "season", "proj_offense", "proj_defense", "proj_total", "lower_80", "upper_80"]


def design_rows(blocks: DataFrame, min_possessions: float = MIN_POSSESSIONS) -> DataFrame:
    """(game_id, y, w, terms: array<struct<player_id, defense, x>>): +1 for offence, -1 for defence."""
    term = lambda sign, flag: lambda p: F.struct(p.alias("player_id"), F.lit(flag).alias("defense"), F.lit(float(sign)).alias("x"))
    return blocks.filter(F.col("possessions") >= min_possessions).select(
        "game_id", (100 * F.col("points") / F.col("possessions")).alias("y"), F.col("possessions").alias("w"), F.concat(F.transform("offense", term(1, False)), F.transform("defense", term(-1, True))).alias("terms")
    )


def design_coo(design: DataFrame) -> DataFrame:
    """Long form (game_id, y, w, player_id, defense, x)."""
    return design.select("game_id", "y", "w", F.explode("terms").alias("t")).select("game_id", "y", "w", "t.*")


#: hash buckets that games are dealt to folds by; up to so many games each is almost surely its own
BUCKETS = 4096


def game_bucket(game: str = "game_id"):
    """The first three hex digits of the game's MD5; a null game counts as the empty name."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(game).cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")


def balanced_folds(design: DataFrame, k: int = FOLDS) -> list[int]:
    """Buckets of games to folds: largest first, each to the fold with fewest rows so far (ties: lower fold, lower bucket).

    A game's rows share a bucket, so they share a fold. The driver holds ``BUCKETS`` counts, however many games there
    are; buckets without a game have fold -1.
    """
    sizes = sorted(((r["count"], r["bucket"]) for r in design.groupBy(game_bucket().alias("bucket")).count().collect()), key=lambda x: (-x[0], x[1]))
    load, out = [0] * max(min(k, len(sizes)), 1), [-1] * BUCKETS
    for n, bucket in sizes:
        f = min(range(len(load)), key=lambda i: (load[i], i))
        load[f] += n
        out[bucket] = f
    return out


#: codes of the two columns that every row of the design also has: its target, and a one for the intercept
TARGET, ONE = -2, -1


def same_lineups(design: DataFrame, folds: list[int] | None) -> DataFrame:
    """(fold, terms, w, wy, wyy): a row for each fold and set of terms, with what its rows add up to.

    Equal terms have equal products, so these are formed once a lineup instead of once a block.
    """
    d = with_folds(design, folds) if folds else design.withColumn("fold", F.lit(0))
    wy = F.col("w") * F.col("y")
    return d.groupBy("fold", "terms").agg(F.sum("w").alias("w"), F.sum(wy).alias("wy"), F.sum(wy * F.col("y")).alias("wyy"))


def _pairs(rows: DataFrame, extended: bool) -> DataFrame:
    """A row of the design as the weighted products of its columns, (fold, i, j, v) with i <= j; i and j are 2 * player + defence.

    ``extended``: rows of ``same_lineups``, whose target and one are columns too.
    """
    code = lambda t: t["player_id"] * 2 + t["defense"].cast("long")
    terms = F.transform("terms", lambda t: F.struct(code(t).alias("i"), t["x"].alias("x")))
    entry = lambda i, j, v: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), v.cast("double").alias("v"))
    product = lambda a: lambda b: entry(a["i"], b["i"], F.col("w") * a["x"] * b["x"])
    partners = lambda a: F.transform(F.filter("c", lambda b: b["i"] >= a["i"]), product(a))
    every = F.flatten(F.transform("c", partners))
    if extended:
        one_with = lambda c, v: F.transform("c", lambda b: entry(F.lit(c), b["i"], F.col(v) * b["x"]))
        alone = F.array(*(entry(F.lit(a), F.lit(b), F.col(v)) for a, b, v in ((TARGET, TARGET, "wyy"), (TARGET, ONE, "wy"), (ONE, ONE, "w"))))
        every = F.concat(alone, one_with(TARGET, "wy"), one_with(ONE, "w"), every)
    return rows.withColumn("c", terms).select("fold", F.explode(every).alias("p")).select("fold", "p.*")


def pair_sums(design: DataFrame) -> DataFrame:
    """(fold, i, j, g): upper triangle of the Gram matrix, i and j being 2 * player + defence."""
    lineups = design.groupBy("fold", "terms").agg(F.sum("w").alias("w"))
    return _pairs(lineups, False).groupBy("fold", "i", "j").agg(F.sum("v").alias("g"))


def with_folds(design: DataFrame, folds: list[int]) -> DataFrame:
    table = design.sparkSession.createDataFrame(list(enumerate(folds)), "bucket int, fold int")
    return design.withColumn("bucket", game_bucket()).join(F.broadcast(table), "bucket").drop("bucket")  # BUCKETS rows


@dataclass
class Moments:
    """Weighted sums of products of the design's columns, for each fold.

    ``gram``: (i, j, g: array of a sum for each fold), i <= j, with the columns TARGET and ONE among them, so it holds
    the linear sums too. It is a written table of one row for each two columns that ever meet; only the sums of the
    target and the one with each other, three numbers a fold, are here on the driver. ``lineups`` is the written table
    of ``same_lineups`` that the sums are made from.
    """

    lineups: DataFrame
    gram: DataFrame
    rows: int  # of gram
    w: np.ndarray
    wy: np.ndarray
    wyy: np.ndarray

    @property
    def folds(self) -> int:
        return len(self.w)

    def train(self, sums: np.ndarray, fold: int) -> np.ndarray:
        """Sums over all folds but ``fold`` (-1: over all); the last axis is the fold's."""
        return sums.sum(-1) if fold < 0 else np.delete(sums, fold, -1).sum(-1)


def moments(design: DataFrame, folds: list[int] | None = None) -> Moments:
    """All sums of a design in one partially aggregated pass of its rows and one of its lineups. Without ``folds`` all rows are one fold."""
    k = max(folds) + 1 if folds else 1
    lineups = durable(same_lineups(design, folds), "lineups")
    sums = [F.sum(F.when(F.col("fold") == f, F.col("v")).otherwise(0.0)) for f in range(k)]
    gram = durable(_pairs(lineups, True).groupBy("i", "j").agg(F.array(*sums).alias("g")), "gram")
    at = {(r.i, r.j): np.array(r.g) for r in gram.filter("j < 0").collect()}  # three rows
    if (ONE, ONE) not in at:
        forget(lineups, gram)
        raise ValueError("no block is left to fit")
    return Moments(lineups, gram, gram.count(), at[ONE, ONE], at[TARGET, ONE], at[TARGET, TARGET])


@dataclass
class Fit:
    """Solutions of several systems (excluded fold or -1, penalty): ``beta`` (i, beta: array of one for each) and intercepts."""

    systems: list[tuple[int, float]]
    beta: DataFrame | None  # None where only errors were asked for
    intercepts: np.ndarray
    errors: np.ndarray  # of the excluded fold; nan where none is
    steps: int


def conjugate_gradients(spark: SparkSession, m: Moments, systems: list[tuple[int, float]], prior: DataFrame | None = None, local_rows: int = 2_000_000, errors_only: bool = False) -> Fit:
    """Weighted ridge with a free intercept for all ``systems`` at once; with ``prior`` (i, mu) shrinkage is towards it.

    Conjugate gradients with the diagonal as preconditioner. A step needs the Gram matrix only as what it is multiplied
    with, and one multiplication serves all systems. Up to ``local_rows`` rows of ``m.gram`` (60 bytes each at five
    folds) the rows are multiplied on the driver, where a step costs no job; beyond, vectors and matrix stay
    tables and a step is a join and a sum. Both stop at the same relative residual. ``errors_only``: the solutions on
    the driver are not made a table.
    """
    return _solve_local(spark, m, systems, prior, errors_only) if m.rows <= local_rows else _solve_tables(spark, m, systems, prior)


TOLERANCE, MAX_STEPS = 1e-13, 5_000


def _solve_local(spark: SparkSession, m: Moments, systems: list[tuple[int, float]], prior: DataFrame | None, errors_only: bool = False) -> Fit:
    table = m.gram.toArrow()  # conjugate_gradients has checked its rows
    i, j = (table[c].to_numpy() for c in ("i", "j"))
    g = table["g"].combine_chunks().flatten().to_numpy().reshape(-1, m.folds)
    own = np.unique(j[j >= 0])
    n = len(own)
    b, s = np.zeros((n, m.folds)), np.zeros((n, m.folds))
    for code, to in ((TARGET, b), (ONE, s)):
        at = (i == code) & (j >= 0)
        to[np.searchsorted(own, j[at])] = g[at]
    at = i >= 0
    a, c, g = np.searchsorted(own, i[at]), np.searchsorted(own, j[at]), g[at]
    off = a != c
    diagonal = np.zeros((n, m.folds))
    diagonal[a[~off]] = g[~off]
    row, col, val = np.concatenate((a, c[off])), np.concatenate((c, a[off])), np.concatenate((g, g[off]))
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    start = np.searchsorted(row, np.arange(n))

    def times(values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A Gram matrix (its ``values`` in row order) times the columns of x, a few at a time."""
        out = np.empty_like(x)
        step = max(1, 20_000_000 // max(len(values), 1))
        for k in range(0, x.shape[1], step):
            out[:, k : k + step] = np.add.reduceat(values[:, None] * x[col, k : k + step], start, axis=0)
        return out

    train = {f: m.train(val, f) for f in {f for f, _ in systems}}
    mu = np.zeros(n)
    if prior is not None:
        given = prior.toArrow()  # a row for each column of the design
        known = {int(k): x for k, x in zip(given["i"].to_pylist(), given["mu"].to_pylist(), strict=True)}
        mu = np.array([known.get(int(k), 0.0) for k in own])
    beta, intercepts, errors, steps = None if errors_only else np.zeros((n, len(systems))), np.zeros(len(systems)), np.full(len(systems), np.nan), 0
    for f in train:
        ks = [k for k, x in enumerate(systems) if x[0] == f]
        w, wy = float(m.train(m.w, f)), float(m.train(m.wy, f))
        sf, bf, lam = m.train(s, f), m.train(b, f), np.array([systems[k][1] for k in ks])
        if prior is not None:
            bf, wy = bf - times(train[f], mu[:, None])[:, 0], wy - sf @ mu
        d = (m.train(diagonal, f) - sf * sf / w)[:, None] + lam
        x = np.zeros((n, len(ks)))
        r = np.repeat((bf - sf * wy / w)[:, None], len(ks), 1)
        z = r / d
        p, rz = z.copy(), (r * z).sum(0)
        stop, live = TOLERANCE**2 * rz, np.flatnonzero(rz > 0)
        count = 0
        while len(live):
            if (count := count + 1) > MAX_STEPS:
                raise RuntimeError("conjugate gradients did not converge")
            q = times(train[f], p[:, live]) - np.outer(sf / w, sf @ p[:, live]) + lam[live] * p[:, live]
            step = rz[live] / (p[:, live] * q).sum(0)
            x[:, live] += step * p[:, live]
            r[:, live] -= step * q
            z[:, live] = r[:, live] / d[:, live]
            new = (r[:, live] * z[:, live]).sum(0)
            p[:, live] = z[:, live] + new / rz[live] * p[:, live]
            rz[live] = new
            live = live[new > stop[live]]
        steps = max(steps, count)
        intercepts[ks] = (wy - sf @ x) / w
        y = x + mu[:, None]
        if beta is not None:
            beta[:, ks] = y
        if f >= 0:
            c = intercepts[ks]
            sse = m.wyy[f] + (y * times(np.ascontiguousarray(val[:, f]), y)).sum(0) + c * c * m.w[f] - 2 * (b[:, f] @ y) - 2 * c * m.wy[f] + 2 * c * (s[:, f] @ y)
            errors[ks] = sse / m.w[f]
    if beta is None:
        return Fit(systems, None, intercepts, errors, steps)
    out = pa.table({"i": own, "beta": pa.FixedSizeListArray.from_arrays(pa.array(beta.ravel()), len(systems)).cast(pa.list_(pa.float64()))})
    return Fit(systems, spark.createDataFrame(out), intercepts, errors, steps)


def _solve_tables(spark: SparkSession, m: Moments, systems: list[tuple[int, float]], prior: DataFrame | None) -> Fit:
    """As ``_solve_local``, with vectors as tables (i, an array of one number for each system).

    A step is written once, with the product of the preconditioned residual z; the two numbers a system that it needs
    are summed from that table. Directions follow by recurrence from the products of z, so no second product is needed.
    """
    n, each = len(systems), range(len(systems))
    lam, w, wy = (np.array(x, dtype=float) for x in ([x for _, x in systems], [m.train(m.w, f) for f, _ in systems], [m.train(m.wy, f) for f, _ in systems]))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    kept = [total if f < 0 else total - F.element_at("g", f + 1) for f, _ in systems]
    numbers = lambda x: F.array(*(F.lit(float(v)) for v in x))
    over = lambda f, a, b: F.zip_with(a, b, f)
    plus, minus, by, per = (lambda a, b: over(lambda x, y: x + y, a, b)), (lambda a, b: over(lambda x, y: x - y, a, b)), (lambda a, b: over(lambda x, y: x * y, a, b)), (lambda a, b: over(lambda x, y: x / y, a, b))
    # both triangles, by the column that is multiplied; partitions are kept, so a step doesn't shuffle the matrix
    half = m.gram.filter("i >= 0").select("i", "j", F.array(total, *(total - F.element_at("g", f + 1) for f in range(m.folds))).alias("g"), F.col("g").alias("own"))
    full = plain_unions(half).unionByName(half.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "g", "own"))
    full = full.repartition(spark.sparkContext.defaultParallelism if m.rows < 10_000_000 else max(200, m.rows // 2_000_000), "j").persist()

    def times(v: DataFrame, column: str, matrix: str = "g") -> DataFrame:
        entry = (lambda k: F.element_at("g", systems[k][0] + 2)) if matrix == "g" else (lambda k: F.element_at("own", systems[k][0] + 1) if systems[k][0] >= 0 else F.lit(0.0))
        x = v.select(F.col("i").alias("j"), F.col(column).alias("x"))
        return full.join(x, "j").groupBy("i").agg(F.array(*(F.sum(entry(k) * F.element_at("x", k + 1)) for k in each)).alias("product"))

    def sums(v: DataFrame, *products: tuple[str, str]) -> list[np.ndarray]:
        row = v.agg(F.array(*(F.sum(F.element_at(a, k + 1) * F.element_at(b, k + 1)) for a, b in products for k in each)).alias("x")).first()
        return list(np.array(row.x).reshape(len(products), n))

    linear = m.gram.filter(f"j >= 0 and (i in ({TARGET}, {ONE}) or i = j)").select("j", "i", F.array(*kept).alias("g"), "g")
    linear = linear.toDF("j", "i", "g", "own")
    pick = lambda cond, c, name: F.max(F.when(cond, F.col(c))).alias(name)
    v = linear.groupBy(F.col("j").alias("i")).agg(
        pick(F.col("i") == TARGET, "g", "b"), pick(F.col("i") == ONE, "g", "s"), pick(F.col("i") == F.col("j"), "g", "d"), pick(F.col("i") == TARGET, "own", "b_own"), pick(F.col("i") == ONE, "own", "s_own")
    )
    v = v.withColumn("mu", F.array(*(F.lit(0.0) for _ in each)))
    if prior is not None:
        known = prior.select("i", F.array_repeat(F.col("mu").cast("double"), n).alias("given"))
        v = durable(v.join(known, "i", "left").withColumn("mu", F.coalesce("given", "mu")).drop("given"), "prior")
        (shift,) = sums(v, ("s", "mu"))
        wy = wy - shift
        v = v.join(times(v, "mu"), "i").withColumn("b", minus("b", "product")).drop("product")
    v = v.withColumn("d", plus(minus("d", per(by("s", "s"), numbers(w))), numbers(lam))).withColumn("r", minus("b", by("s", numbers(wy / w))))
    zero = F.array(*(F.lit(0.0) for _ in each))
    last = v = durable(v.withColumn("z", per("r", "d")).withColumns({"x": zero, "p": zero, "q": zero}), "cg")
    rz, sz = sums(v, ("r", "z"), ("s", "z"))
    stop, before, step, steps = TOLERANCE**2 * rz, np.ones(n), np.ones(n), 0
    while (rz > stop).any():
        if (steps := steps + 1) > MAX_STEPS:
            raise RuntimeError("conjugate gradients did not converge")
        az = plus(minus("product", by("s", numbers(sz / w))), by("z", numbers(lam)))
        now = durable(v.join(times(v, "z"), "i").withColumn("az", az).drop("product"), "cg")
        forget(last)
        last = now
        (zaz,) = sums(now, ("z", "az"))
        live = rz > stop
        turn = np.where(live & (steps > 1), rz / np.where(before > 0, before, 1), 0.0)
        size = np.where(live, zaz - (turn * rz / step if steps > 1 else 0), 1.0)  # p . Ap
        step = np.where(live & (size != 0), rz / size, 0.0)
        v = now.withColumns({"p": plus("z", by("p", numbers(turn))), "q": plus("az", by("q", numbers(turn)))})
        v = v.withColumns({"x": plus("x", by("p", numbers(step))), "r": minus("r", by("q", numbers(step)))}).withColumn("z", per("r", "d")).drop("az")
        before = rz
        rz, sz = sums(v, ("r", "z"), ("s", "z"))
        step = np.where(step != 0, step, 1.0)
    (sx,) = sums(v, ("s", "x"))
    intercepts, errors = (wy - sx) / w, np.full(n, np.nan)
    v = v.withColumn("beta", plus("x", "mu"))
    if any(f >= 0 for f, _ in systems):
        own = lambda c: F.array(*(F.element_at(c, f + 1) if f >= 0 else F.lit(0.0) for f, _ in systems))
        v = v.withColumns({"b_own": own("b_own"), "s_own": own("s_own")})
        square, by_b, by_s = sums(v.join(times(v, "beta", "own"), "i"), ("beta", "product"), ("b_own", "beta"), ("s_own", "beta"))
        for k, (f, _) in enumerate(systems):
            if f >= 0:
                c = intercepts[k]
                errors[k] = (m.wyy[f] + square[k] + c * c * m.w[f] - 2 * by_b[k] - 2 * c * m.wy[f] + 2 * c * by_s[k]) / m.w[f]
    full.unpersist()
    return Fit(systems, v.select("i", "beta"), intercepts, errors, steps)


def choose_lambda(spark: SparkSession, m: Moments, grid: tuple[float, ...] = LAMBDAS) -> tuple[float, list[float]]:
    """Least mean error over folds, the first on ties. Fewer than two folds: the grid's middle, scores unknown."""
    if m.folds < 2:
        return grid[len(grid) // 2], [float("nan")] * len(grid)
    fit = conjugate_gradients(spark, m, [(f, lam) for lam in grid for f in range(m.folds)], errors_only=True)
    scores = fit.errors.reshape(len(grid), m.folds).mean(1)
    return grid[int(np.argmin(scores))], scores.tolist()


def player_possessions(design: DataFrame) -> DataFrame:
    return design.select("w", F.explode(F.array_distinct(F.transform("terms", lambda t: t["player_id"]))).alias("player_id")).groupBy("player_id").agg(F.sum("w").alias("possessions"))


def with_value(ratings: DataFrame, replacement: float = REPLACEMENT) -> DataFrame:
    """Adds value (points over replacement) and wins_added."""
    v = (F.col("total") - replacement) * F.col("possessions") / 100
    return ratings.withColumn("value", v).withColumn("wins_added", v / POINTS_PER_WIN)


def ratings_of(fit: Fit, system: int = 0) -> DataFrame:
    """(player_id, offense, defense, total) of one of the fit's systems."""
    side = lambda d: F.coalesce(F.max(F.when(F.pmod("i", F.lit(2)) == d, F.element_at("beta", system + 1))), F.lit(0.0))
    r = fit.beta.groupBy(F.floor(F.col("i") / 2).alias("player_id")).agg(side(0).alias("offense"), side(1).alias("defense"))
    return r.withColumn("total", F.col("offense") + F.col("defense"))


def fit_moments(spark: SparkSession, m: Moments, grid: tuple[float, ...] = LAMBDAS, fixed: float | None = None, prior: DataFrame | dict | None = None, replacement: float = REPLACEMENT) -> tuple[DataFrame, dict]:
    """As ``fit_ratings``, from sums that may serve several fits."""
    lam, scores = (fixed, []) if fixed is not None else choose_lambda(spark, m, grid)
    if isinstance(prior, dict):
        prior = spark.createDataFrame([(int(p), float(a), float(b)) for p, (a, b) in prior.items()], "player_id long, mu_off double, mu_def double")
    mu = None
    if prior is not None:
        sides = F.array(*(F.struct((F.col("player_id") * 2 + d).alias("i"), F.coalesce(c, F.lit(0.0)).alias("mu")) for d, c in ((0, "mu_off"), (1, "mu_def"))))
        mu = prior.select(F.explode(sides).alias("t")).select("t.*")
    fit = conjugate_gradients(spark, m, [(-1, lam)], mu)
    r = ratings_of(fit).join(player_possessions(m.lineups), "player_id")
    return with_value(r, replacement), {"lambda": lam, "scores": scores, "intercept": float(fit.intercepts[0]), "n_folds": m.folds, "steps": fit.steps}


def fit_ratings(spark: SparkSession, blocks: DataFrame, grid: tuple[float, ...] = LAMBDAS, fixed: float | None = None, prior: DataFrame | dict | None = None, replacement: float = REPLACEMENT) -> tuple[DataFrame, dict]:
    """Ratings (player_id, offense, defense, total, possessions, value, wins_added) and fit facts.

    ``prior``: (player_id, mu_off, mu_def), or a small dict of pairs, the means to shrink to; players without one
    shrink to 0. With a ``fixed`` penalty there are no folds. Rows without possessions are left out; none left raises.
    """
    design = design_rows(blocks)
    m = moments(design, None if fixed is not None else balanced_folds(design))
    return fit_moments(spark, m, grid, fixed, prior, replacement)


def ranked(df: DataFrame, value: str, *ties: str, buckets: int = 64) -> DataFrame:
    """Adds ``rank``, 1 for the largest value, then by ``ties``, without sorting all rows in one task.

    Values are dealt to ranges by approximate quantiles, ranks are counted inside each range, and the rows of the
    ranges above are added. The bounds are fixed numbers in the plan, so every evaluation deals alike. Nulls are last.
    """
    bounds = sorted({x for x in df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.005) if x is not None})
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col(value))) if bounds else F.lit(0)
    dealt = df.withColumn("_range", F.when(F.col(value).isNull(), len(bounds) + 1).otherwise(above))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc_nulls_last(value), *ties))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("rank", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


FEATURES = ("pts_100", "ast_100", "tov_100", "ts_pct", "stl_100", "blk_100", "dreb_rate", "position_big")


def feature_stats(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: rows (n), mean target (y), mean and population deviation of each feature (m_, s_)."""
    return rows.agg(F.count("*").alias("n"), F.avg(target).alias("y"), *(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features))


def standardized_ridge(rows: DataFrame, features: list[str], target: str, ridge: float = 1.0) -> dict:
    """Ridge on features standardised with population deviations (0 counts as 1), intercept = mean target.

    All sums are one aggregate; too few rows (fewer than features + 2) give a zero model.
    """
    p = len(features)
    stat = feature_stats(rows, features, target).first()
    if stat.n < p + 2:
        return {"features": features, "mean": [0.0] * p, "sd": [1.0] * p, "beta": [0.0] * p, "intercept": 0.0, "note": f"only {stat.n} rows"}
    mean, sd = [stat[f"m_{f}"] for f in features], [stat[f"s_{f}"] or 1.0 for f in features]
    z = [((F.col(f) - a) / b) for f, a, b in zip(features, mean, sd, strict=True)]
    sums = rows.agg(*(F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(z[i] * (F.col(target) - stat.y)).alias(f"b_{i}") for i in range(p))).first()
    g = np.array([[sums[f"g_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    beta = np.linalg.solve(g + ridge * np.eye(p), np.array([sums[f"b_{i}"] for i in range(p)]))
    return {"features": features, "mean": mean, "sd": sd, "beta": beta.tolist(), "intercept": float(stat.y), "note": ""}


def predict(model: dict):
    """The model as a column expression."""
    out = F.lit(model["intercept"])
    for f, a, b, w in zip(model["features"], model["mean"], model["sd"], model["beta"], strict=True):
        out = out + (F.col(f) - a) / b * w
    return out


def box_score_prior(plain: DataFrame, box_rows: DataFrame, off_features: list[str], def_features: list[str], reliable: float = 1000.0) -> DataFrame:
    """(player_id, mu_off, mu_def): predictions of models trained on players of enough possessions; 0 without a row."""
    plain = durable(plain.select("player_id", "offense", "defense"), "plain")  # five jobs read it
    j = plain.join(box_rows, "player_id")
    off = standardized_ridge(j.filter(F.col("off_possessions") >= reliable), off_features, "offense")
    de = standardized_ridge(j.filter(F.col("def_possessions") >= reliable), def_features, "defense")
    mu = box_rows.select("player_id", predict(off).alias("mu_off"), predict(de).alias("mu_def"))
    return plain.select("player_id").join(mu, "player_id", "left").select("player_id", F.coalesce("mu_off", F.lit(0.0)).alias("mu_off"), F.coalesce("mu_def", F.lit(0.0)).alias("mu_def"))
