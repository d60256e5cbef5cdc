"""Conjugate gradients, on the driver and on tables, against dense solutions; the prior's mean; more columns than a dense matrix could hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import _league

from courtside.operators import ratings

BLOCK = "game_id string, offense array<long>, defense array<long>, points double, possessions double"


@pytest.fixture(scope="module")
def league(spark):
    rows, *_ = _league(n_players=14, games=25)
    design = ratings.design_rows(spark.createDataFrame(rows, BLOCK)).cache()
    folds = ratings.balanced_folds(design, 3)
    of = {r.game_id: r.fold for r in ratings.with_folds(design, folds).select("game_id", "fold").distinct().collect()}
    x, y, w = np.zeros((len(rows), 28)), np.zeros(len(rows)), np.zeros(len(rows))
    for i, (_, o, d, points, possessions) in enumerate(rows):
        x[i, [2 * p for p in o]], x[i, [2 * p + 1 for p in d]], y[i], w[i] = 1, -1, 100 * points / possessions, possessions
    return design, ratings.moments(design, folds), x, y, w, np.array([of[r[0]] for r in rows])


def dense(x, y, w, fold, mu, system):
    f, lam = system
    on = fold != f
    xx, yy, ww = x[on], y[on] - x[on] @ mu, w[on]
    xm, ym = ww @ xx / ww.sum(), ww @ yy / ww.sum()
    gamma = np.linalg.solve((xx - xm).T @ (ww[:, None] * (xx - xm)) + lam * np.eye(len(mu)), (xx - xm).T @ (ww * (yy - ym)))
    c, beta = ym - xm @ gamma, gamma + mu
    return beta, c, (w[~on] * (y[~on] - c - x[~on] @ beta) ** 2).sum() / w[~on].sum() if f >= 0 else np.nan


@pytest.mark.parametrize("way", [ratings._solve_local, ratings._solve_tables])
@pytest.mark.parametrize("with_prior", [False, True])
def test_equals_the_dense_solution(spark, league, way, with_prior):
    _, m, x, y, w, fold = league
    systems = [(-1, 3000.0), (0, 3000.0), (2, 30000.0)]
    mu = np.zeros(28)
    prior = None
    if with_prior:  # two columns have no mean
        mu[:26] = np.linspace(-4, 6, 26)
        prior = spark.createDataFrame([(i, float(mu[i])) for i in range(26)] + [(999, 5.0)], "i long, mu double")
    fit = way(spark, m, systems, prior)
    got = {r.i: r.beta for r in fit.beta.collect()}
    assert set(got) == set(range(28))
    for k, system in enumerate(systems):
        beta, c, error = dense(x, y, w, fold, mu, system)
        assert max(abs(beta[i] - got[i][k]) for i in range(28)) < 1e-8 and abs(c - fit.intercepts[k]) < 1e-8
        assert np.isnan(fit.errors[k]) if system[0] < 0 else abs(error / fit.errors[k] - 1) < 1e-9


def test_cross_validation_by_dense_solutions(spark, league):
    _, m, x, y, w, fold = league
    lam, scores = ratings.choose_lambda(spark, m, (100.0, 2000.0, 30000.0))
    want = [np.mean([dense(x, y, w, fold, np.zeros(28), (f, s))[2] for f in range(3)]) for s in (100.0, 2000.0, 30000.0)]
    assert np.allclose(scores, want, rtol=1e-10) and lam == (100.0, 2000.0, 30000.0)[int(np.argmin(want))]


def test_prior_mean_pulls_players_without_possessions(spark):
    rows, *_ = _league(n_players=14, games=10)
    blocks = spark.createDataFrame(rows, BLOCK)
    prior = spark.createDataFrame([(p, 3.0, -1.0) for p in range(13)], "player_id long, mu_off double, mu_def double")
    far, _ = ratings.fit_ratings(spark, blocks, fixed=1e9, prior=prior)
    got = {r.player_id: (r.offense, r.defense) for r in far.collect()}
    assert all(abs(got[p][0] - 3) < 0.01 and abs(got[p][1] + 1) < 0.01 for p in range(13)) and abs(got[13][0]) < 0.01
    same, _ = ratings.fit_ratings(spark, blocks, fixed=1e9, prior={p: (3.0, -1.0) for p in range(13)})
    assert max(abs(r.offense - got[r.player_id][0]) for r in same.collect()) < 1e-9


def test_more_players_than_a_dense_matrix_holds(spark):
    """60,000 players in pairs: a dense matrix would take 115 GB; each pair's rating has a closed form."""
    ids = spark.range(30_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    side = lambda a, b, y: ids.select(F.col("a").cast("string").alias("game_id"), F.array(a).alias("offense"), F.array(b).alias("defense"), F.lit(y).alias("points"), F.lit(10.0).alias("possessions"))
    blocks = side("a", "b", 12.0).unionByName(side("b", "a", 8.0))
    r, facts = ratings.fit_ratings(spark, blocks, fixed=100.0)
    low = r.agg(F.count("*").alias("n"), F.min("offense").alias("lo"), F.max("offense").alias("hi")).first()
    t = 10 * 20 / (2 * 10 + 100)  # w (y - mean) / (2 w + penalty)
    assert low.n == 60_000 and abs(low.hi - t) < 1e-9 and abs(low.lo + t) < 1e-9 and abs(facts["intercept"] - 100) < 1e-9


def test_products_are_formed_once_a_lineup(spark):
    """Blocks that repeat a lineup add to its row; only these rows are expanded to products of columns."""
    rows, *_ = _league(n_players=14, games=12)
    once = spark.createDataFrame(rows, BLOCK)
    many = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("points", F.col("points") + F.col("k") - 4).drop("k")
    m = ratings.moments(ratings.design_rows(many), [0] * 2048 + [1] * 2048)
    lineups = {(r[1], tuple(o), tuple(d)) for r, (_, o, d, *_) in zip(ratings.with_folds(once, [0] * 2048 + [1] * 2048).select("game_id", "fold").collect(), rows, strict=True)}
    assert m.lineups.count() == len(lineups)
    x, y, w = np.zeros((7 * len(rows), 28)), np.zeros(7 * len(rows)), np.zeros(7 * len(rows))
    for i, r in enumerate(many.collect()):
        x[i, [2 * p for p in r.offense]], x[i, [2 * p + 1 for p in r.defense]], y[i], w[i] = 1, -1, 100 * r.points / r.possessions, r.possessions
    full = np.column_stack((y, np.ones(len(y)), x))
    want = full.T @ (w[:, None] * full)
    for r in m.gram.collect():
        assert abs(sum(r.g) - want[r.i + 2, r.j + 2]) <= 1e-9 * abs(want[r.i + 2, r.j + 2]) + 1e-6
    assert m.gram.count() == np.count_nonzero(np.triu(full.T.astype(bool).astype(int) @ full.astype(bool).astype(int)))
