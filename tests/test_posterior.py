"""Curves, R-hat and predictive coverage of posterior draws against numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.functions.noise import normal, uniform
from courtside.operators import aging, posterior

DRAWS = "chain int, draw int, site string, player_id long, position string, age int, value double"


def test_noise_is_a_function_of_its_key(spark):
    df = spark.range(4000).withColumn("k", F.col("id") % 7)
    draw = df.select("id", uniform(3, "id").alias("u"), normal(3, "id", "k").alias("z"))
    a = {r.id: (r.u, r.z) for r in draw.collect()}
    assert a == {r.id: (r.u, r.z) for r in draw.repartition(7).collect()}
    h = hashlib.md5(b"3|5|5").hexdigest()
    u1, u2 = ((int(h[i : i + 13], 16) + 0.5) / 2**52 for i in (0, 13))
    assert math.isclose(a[5][1], math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2), rel_tol=1e-12)
    u, z = np.array([x[0] for x in a.values()]), np.array([x[1] for x in a.values()])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.04 and abs(np.mean(z**4) - 3) < 0.5
    assert spark.range(1).select(normal(1, F.lit(None).cast("string")).alias("z")).first().z is not None


def test_position_and_relative_curves(spark):
    rng = np.random.default_rng(4)
    deltas = rng.normal(size=(2, 15, 3, 9))  # chain, draw, position, age
    rows = [(c, d, "position", None, f"p{p}", 20 + k, float(deltas[c, d, p, k])) for c in range(2) for d in range(15) for p in range(3) for k in range(9)]
    got = {(r.chain, r.draw, r.position, r.age): r.value for r in posterior.position_curves(spark.createDataFrame(rows, DRAWS).repartition(5), 24).collect()}
    level = np.concatenate([np.zeros((2, 15, 3, 1)), np.cumsum(deltas, axis=3)], axis=3)
    want = level - level[..., [4]]
    assert len(got) == want.size and all(abs(got[c, d, f"p{p}", 20 + k] - want[c, d, p, k]) < 1e-12 for c in range(2) for d in range(15) for p in range(3) for k in range(10))
    own = [(0, d, "player", p, "G", a, float(10 * p + d + a * a)) for d in range(4) for p in range(3) for a in range(20, 26) if (p, a) != (2, 24)]
    s = spark.createDataFrame(own, DRAWS)
    shape = {(r.draw, r.player_id, r.age): r.value for r in posterior.player_curves(s, 24, level=False).collect()}
    assert shape == {(d, p, a): float(a * a - 576) for d in range(4) for p in range(2) for a in range(20, 26)}
    assert posterior.player_curves(s, 24).count() == len(own)


def test_curves_end_at_gaps(spark):
    rows = [(0, 0, "league", None, None, a, 1.0) for a in (20, 22, 23, 24, 26)] + [(0, 1, "league", None, None, a, 1.0) for a in (20, 25)] + [(0, 2, "league", None, None, 23, 2.0), (0, 2, "league", None, None, 24, None)]
    got = sorted((r.draw, r.age, r.value) for r in posterior.league_curves(spark.createDataFrame(rows, DRAWS), 24).collect())
    assert got == [(0, 22, -2.0), (0, 23, -1.0), (0, 24, 0.0), (0, 25, 1.0), (2, 23, -2.0), (2, 24, 0.0)]
    assert posterior.league_curves(spark.createDataFrame([], DRAWS), 24).count() == 0


def calibrated(spark, n=400, draws=200, truth_sd=1.0, claimed_sd=1.0, seed=2):
    """Players whose posterior is right (or too sure of itself), one observation each."""
    rng = np.random.default_rng(seed)
    w = rng.uniform(200, 3000, n)
    mean = rng.normal(0, 3, n)  # posterior means; the truth is a draw from the posterior
    truth = mean + truth_sd * rng.normal(size=n)
    y = truth + 2.0 / np.sqrt(w / 1000) * rng.normal(size=n)
    rows = [(d % 2, d // 2, "player", i, "G", 25, float(mean[i] + claimed_sd * rng.normal())) for i in range(n) for d in range(draws)] + [(d % 2, d // 2, "sigma_obs", None, None, None, 2.0) for d in range(draws)]
    return spark.createDataFrame(rows, DRAWS), spark.createDataFrame([(i, i, 25, float(y[i]), float(w[i])) for i in range(n)], "observation long, player_id long, age int, y double, w double")


@pytest.mark.parametrize("prob", [0.5, 0.9])
def test_a_calibrated_panel_is_covered(spark, prob):
    samples, seen = calibrated(spark, n=1200, draws=120)
    got = posterior.predictive_coverage(samples, seen, prob, seed=1).first()
    assert got.n == 1200 and abs(got.coverage - prob) < 0.03
    assert posterior.predictive_coverage(samples.repartition(3), seen, prob, seed=1).first() == got


def test_an_overconfident_panel_is_not(spark):
    samples, seen = calibrated(spark, truth_sd=4.0, claimed_sd=0.2)
    assert posterior.predictive_coverage(samples, seen, 0.9).first().coverage < 0.75


def test_observations_that_meet_no_draw(spark):
    samples, seen = calibrated(spark, n=5, draws=20)
    more = seen.unionByName(spark.createDataFrame([(90, 77, 25, 1.0, 100.0), (91, 1, 26, 1.0, 100.0), (92, 1, 25, None, 100.0), (93, 1, 25, 1.0, None), (94, 2, 25, 5e9, 0.0)], seen.schema))
    got = posterior.predictive_coverage(samples, more).first()
    assert got.n == 7 and posterior.predictive_coverage(samples, seen.limit(0)).first().coverage is None


def test_r_hat_of_a_site_is_its_worst(spark):
    rng = np.random.default_rng(0)
    rows = [(c, d, "league", None, None, a, float(rng.normal() + (3 * c if a == 22 else 0))) for c in range(2) for d in range(100) for a in range(20, 24)] + [(c, d, "sigma_obs", None, None, None, float(rng.normal())) for c in range(2) for d in range(100)] + [(c, d, "fixed", None, None, None, 1.0) for c in range(2) for d in range(100)]
    got = {r.site: (r.r_hat, r.n) for r in posterior.max_r_hat(spark.createDataFrame(rows, DRAWS)).collect()}
    assert got["league"][0] > 1.5 and got["league"][1] == 4 and got["sigma_obs"][0] < 1.1 and got["sigma_obs"][1] == 1 and got["fixed"][0] is None


def test_accessors_of_a_fitted_hierarchy(spark):
    rng = np.random.default_rng(1)
    rows = [(p, str(a), "GF"[p % 2], a, float(2 + (0.8 if p % 2 else -0.3) * (a - 24) + rng.normal(0, 0.5)), 2000.0) for p in range(16) for a in range(22, 28)]
    s = spark.createDataFrame(rows, "player_id long, season string, position_group string, age int, r double, w double")
    m = aging.fit_hierarchy(s, "r", "w", anchor=24, warmup=120, samples=120).cache()
    c = {(r.position, r.age): r.mean for r in posterior.curve_summary(posterior.position_curves(m, 24), "position").collect()}
    assert c["F", 24] == 0 and abs(c["F", 27] - 2.4) < 0.8 and abs(c["G", 27] + 0.9) < 0.8
    seen = s.select((F.col("player_id") * 100 + F.col("age")).alias("observation"), "player_id", "age", F.col("r").alias("y"), "w")
    assert 0.8 < posterior.predictive_coverage(m, seen, 0.9).first().coverage <= 1
    assert posterior.player_curves(m, 24, level=False).filter("age = 24").agg(F.max(F.abs("value"))).first()[0] == 0
