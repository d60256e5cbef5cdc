"""Aging curves by the delta method, a partially pooled hierarchy, and projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import plain_unions
from .ratings import predict, standardized_ridge


def player_deltas(seasons: DataFrame, rating: str, weight: str) -> DataFrame:
    """Change of rating between consecutive ages of a player; weight is the lesser of both; gaps are skipped."""
    w = Window.partitionBy("player_id").orderBy("age", "season")
    j = seasons.select("player_id", "season", "age", F.col(rating).alias("r"), F.col(weight).alias("w")).withColumn("age2", F.lead("age").over(w)).withColumn("r2", F.lead("r").over(w)).withColumn("w2", F.lead("w").over(w))
    return j.filter("age2 = age + 1").select("player_id", "age", (F.col("r2") - F.col("r")).alias("delta"), F.least("w", "w2").alias("weight")).filter("weight > 0")


def league_delta_curve(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("age").agg((F.sum(F.col("weight") * F.col("delta")) / F.sum("weight")).alias("delta"), F.sum("weight").alias("weight"), F.count("*").alias("n"))


def cumulative_curve(curve: DataFrame, anchor: int) -> DataFrame:
    """Curve relative to the anchor age (0 there), outward both ways until an age is missing.

    ``curve`` has one row per age, so its single window is as small as the range of ages.
    """
    up = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    after = curve.filter(F.col("age") >= anchor).withColumn("run", F.row_number().over(Window.orderBy("age"))).filter(F.col("age") - F.col("run") == anchor - 1).select((F.col("age") + 1).alias("age"), F.sum("delta").over(up).alias("value"))
    down = Window.orderBy(F.desc("age"))
    before = curve.filter(F.col("age") < anchor).withColumn("run", F.row_number().over(down)).filter(F.col("age") + F.col("run") == anchor).select("age", (-F.sum("delta").over(down.rowsBetween(Window.unboundedPreceding, 0))).alias("value"))
    return plain_unions(before).unionByName(after).unionByName(curve.agg(F.lit(anchor).alias("age"), F.lit(0.0).alias("value")))


SAMPLES = "chain int, draw int, site string, player_id long, position string, age int, value double"


def _chain(pdf: pd.DataFrame, chain: int, seed: int, warmup: int, samples: int, anchor: int, base_sd: float) -> Iterator[tuple]:
    """Gibbs and Metropolis for one chain.

    y = b_i + sum of the player's yearly deltas from the anchor + noise of sd s_obs / sqrt(w / 1000);
    delta_ik ~ N(pos_gk, s_player), pos_gk ~ N(league_k, s_pos), league_k ~ N(0, 5), b_i ~ N(m_i, base_sd).
    Given the three sds everything is Gaussian. Players' deltas and bases are integrated out for the position
    level; each player then adds a K x K precision to its position.
    """
    rng = np.random.default_rng(seed + 1000 * chain)
    ages = np.arange(int(pdf["age"].min()), int(pdf["age"].max()) + 1)
    k = len(ages) - 1
    groups = sorted(pdf["position"].unique())
    data = []
    for pid, g in pdf.groupby("player_id", sort=True):
        x = np.zeros((len(g), k))
        for r, a in enumerate(g["age"]):
            lo, hi = sorted((a - ages[0], anchor - ages[0]))
            x[r, lo:hi] = 1.0 if a >= anchor else -1.0
        data.append((pid, groups.index(g["position"].iloc[0]), x, g["y"].to_numpy(float), 1000.0 / np.maximum(g["w"].to_numpy(float), 1e-6), float(g["m"].iloc[0])))
    eye = np.eye(k)

    def collect(ls):
        sp, si, so = np.exp(ls)
        prec, lin, const = np.zeros((len(groups), k, k)), np.zeros((len(groups), k)), 0.0
        for _, gi, x, y, v, m in data:
            c = so**2 * np.diag(v) + base_sd**2 + si**2 * (x @ x.T)
            ci = np.linalg.inv(c)
            e = y - m
            prec[gi] += x.T @ ci @ x
            lin[gi] += x.T @ ci @ e
            const += -0.5 * (np.linalg.slogdet(c)[1] + e @ ci @ e)
        lp, ll = eye / 25.0, np.zeros(k)
        post = []
        for gi in range(len(groups)):
            a = prec[gi] + eye / sp**2
            ai = np.linalg.inv(a)
            const += 0.5 * (lin[gi] @ ai @ lin[gi] - np.linalg.slogdet(a)[1]) - k * np.log(sp)
            # what is left for the league after the position is integrated out
            lp = lp + eye / sp**2 - ai / sp**4
            ll = ll + ai @ lin[gi] / sp**2
            post.append((a, ai))
        li = np.linalg.inv(lp)
        const += 0.5 * (ll @ li @ ll - np.linalg.slogdet(lp)[1])
        prior = -0.5 * (sp / 2) ** 2 - 0.5 * (si / 2) ** 2 - 0.5 * (so / 5) ** 2 + np.sum(ls)
        return const + prior, (li, ll, post, lin)

    ls = np.log([0.5, 0.5, 2.0]) + 0.1 * rng.normal(size=3)
    now, parts = collect(ls)
    step = np.full(3, 0.25)
    for it in range(warmup + samples):
        for j in range(3):
            prop = ls.copy()
            prop[j] += step[j] * rng.normal()
            new, np_ = collect(prop)
            ok = np.log(rng.random()) < new - now
            if ok:
                ls, now, parts = prop, new, np_
            if it < warmup:
                step[j] *= np.exp((0.44 if ok else -0.44 * 0.8) * min(0.3, 3 / np.sqrt(it + 1)))
        if it < warmup:
            continue
        d = it - warmup
        sp, si, so = np.exp(ls)
        li, ll, post, lin = parts
        league = rng.multivariate_normal(li @ ll, li)
        pos = [rng.multivariate_normal(ai @ (lin[gi] + league / sp**2), ai) for gi, (_, ai) in enumerate(post)]
        for name, value in zip(("sigma_position", "sigma_player", "sigma_obs"), (sp, si, so), strict=True):
            yield chain, d, name, None, None, None, float(value)
        for q in range(k):
            yield chain, d, "league", None, None, int(ages[q]), float(league[q])
            for gi, g in enumerate(groups):
                yield chain, d, "position", None, g, int(ages[q]), float(pos[gi][q])
        for pid, gi, x, y, v, m in data:
            h = np.hstack([np.ones((len(y), 1)), x])
            wi = 1 / (so**2 * v)
            prec = h.T @ (wi[:, None] * h)
            prec[0, 0] += 1 / base_sd**2
            prec[np.arange(1, k + 1), np.arange(1, k + 1)] += 1 / si**2
            cov = np.linalg.inv(prec)
            mean = cov @ (h.T @ (wi * y) + np.concatenate(([m / base_sd**2], pos[gi] / si**2)))
            s = rng.multivariate_normal(mean, cov)
            curve = np.concatenate(([0.0], np.cumsum(s[1:])))
            curve += s[0] - curve[anchor - ages[0]]
            for q, a in enumerate(ages):
                yield chain, d, "player", int(pid), groups[gi], int(a), float(curve[q])


def fit_hierarchy(seasons: DataFrame, rating: str, weight: str, baseline: str | None = None, anchor: int = 27, base_sd: float = 20.0, warmup: int = 150, samples: int = 150, chains: int = 2, seed: int = 0) -> DataFrame:
    """Posterior draws in long form (chain, draw, site, player_id, position, age, value), one task per chain.

    A chain sees all players of the panel; a panel is thousands of rows, as the model is one joint posterior.
    """
    cols = ["player_id", F.col("position_group").alias("position"), F.col("age").cast("int").alias("age"), F.col(rating).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), (F.col(baseline) if baseline else F.lit(0.0)).cast("double").alias("m")]
    panel = seasons.select(*cols).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(_chain(pdf.sort_values(["player_id", "age"]), int(key[0]), seed, warmup, samples, anchor, base_sd))
        return pd.DataFrame(out, columns=["chain", "draw", "site", "player_id", "position", "age", "value"]).astype({"player_id": "Int64", "age": "Int32"})

    return panel.groupBy("chain").applyInPandas(run, SAMPLES)


def split_r_hat(samples: DataFrame, *keys: str) -> DataFrame:
    """Split R-hat per site: halves of each chain as chains of their own; null where no draw differs from another."""
    half = samples.groupBy("chain").agg(((F.max("draw") + 1) / 2).alias("mid"))
    s = samples.join(F.broadcast(half), "chain").withColumn("part", (F.col("draw") >= F.col("mid")).cast("int"))
    per = s.groupBy(*keys, "chain", "part").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n")).select(*keys, F.sqrt(F.try_divide((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b"), "w")).alias("r_hat"))


def posterior_summary(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.percentile("value", 0.1).alias("lower_80"), F.percentile("value", 0.9).alias("upper_80"))


def coverage(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true (player_id, age, value) inside the 80 % interval."""
    s = posterior_summary(samples.filter("site = 'player'"), "player_id", "age")
    return truth.join(s, ["player_id", "age"]).agg(F.avg(F.col("value").between(F.col("lower_80"), F.col("upper_80")).cast("double")).alias("coverage"), F.count("*").alias("n"))


def project_players(offense: DataFrame, defense: DataFrame, current: DataFrame, years: int = 4) -> DataFrame:
    """Offence, defence and total for the coming ages, draws joined by index; beyond the fitted ages nothing."""
    ahead = current.select("player_id", F.col("age").alias("age0")).withColumn("age", F.explode(F.expr(f"sequence(age0 + 1, age0 + {years})"))).drop("age0")
    pick = lambda d, name: d.filter("site = 'player'").select("player_id", "age", "chain", "draw", F.col("value").alias(name))
    j = pick(offense, "off").join(pick(defense, "def"), ["player_id", "age", "chain", "draw"]).join(ahead, ["player_id", "age"])
    total = F.col("off") + F.col("def")
    return j.groupBy("player_id", "age").agg(F.avg("off").alias("proj_offense"), F.avg("def").alias("proj_defense"), F.avg(total).alias("proj_total"), F.percentile(total, 0.1).alias("lower_80"), F.percentile(total, 0.9).alias("upper_80"))


def season_counts(seasons: DataFrame) -> DataFrame:
    return seasons.groupBy("player_id").agg(F.count("*").alias("n_seasons"))


def baseline_means(samples: DataFrame, anchor: int) -> DataFrame:
    """(player_id, baseline): each player's mean level at the anchor age."""
    return samples.filter((F.col("site") == "player") & (F.col("age") == anchor)).groupBy("player_id").agg(F.avg("value").alias("baseline"))


#: fixed values: seasons that make a player's level a training label; deviations of the levels in either fit
RELIABLE_SEASONS, PRELIMINARY_SD, INFORMED_SD = 4, 20.0, 6.0


def fit_box_score_projection(seasons: DataFrame, box_rows: DataFrame, rating: str, weight: str, features: list[str], anchor: int = 27, reliable: int = RELIABLE_SEASONS, **draws) -> tuple[DataFrame, DataFrame, dict, int]:
    """(draws of the informed fit, of the preliminary fit, the box-score model, players it was trained on).

    The hierarchy is fitted with wide levels first; its levels of players with enough seasons train a ridge on their
    box scores; that model's predictions (0 without a box score) are the levels that the second fit is held to.
    Too few players to train on give a zero model, which its note says.
    """
    first = fit_hierarchy(seasons, rating, weight, anchor=anchor, base_sd=PRELIMINARY_SD, **draws)
    sure = season_counts(seasons).filter(F.col("n_seasons") >= reliable)
    train = baseline_means(first, anchor).join(sure, "player_id", "left_semi").join(box_rows.select("player_id", *features), "player_id")
    model = standardized_ridge(train, features, "baseline")
    level = box_rows.select("player_id", predict(model).alias("_level"))
    informed = seasons.join(level, "player_id", "left").withColumn("_level", F.coalesce("_level", F.lit(0.0)))
    return fit_hierarchy(informed, rating, weight, baseline="_level", anchor=anchor, base_sd=INFORMED_SD, **draws), first, model, train.count()
