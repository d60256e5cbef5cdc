"""What is read off posterior draws: curves of players and positions, the worst R-hat of a site, predictive coverage.

Draws are in long form (chain, draw, site, player_id, position, age, value), as ``aging.fit_hierarchy`` gives them:
``league`` and ``position`` hold yearly deltas, value being the change from ``age`` to ``age + 1``; ``player`` holds
ratings at each age; ``sigma_obs`` the noise of a season of 1,000 possessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import normal
from .aging import split_r_hat

DRAW = ("chain", "draw")


def curves_of_deltas(deltas: DataFrame, *keys: str, anchor: int) -> DataFrame:
    """(keys, age, value): yearly deltas of each key summed outward from the anchor age, where the curve is 0.

    Value at an age above the anchor is the sum of the deltas between, below it minus that sum. A curve goes on, either
    way, until a delta is missing or null; a key without the delta on either side of the anchor has no curve, one with
    only one of them has a one-sided one. One delta per key and age.

    A single window: the run of ages without a gap has a constant age - row number, and the sum up to the anchor is
    taken off the running sum. Partitions are the few ages of one key.
    """
    by = Window.partitionBy(*keys)
    along = by.orderBy("age")
    d = deltas.filter(F.col("value").isNotNull() & F.col("age").isNotNull()).select(*keys, "age", "value")
    d = d.withColumn("_run", F.col("age") - F.row_number().over(along))
    home = F.max(F.when(F.col("age").isin(anchor - 1, anchor), F.col("_run"))).over(by)
    # deltas on both sides of the anchor that a gap separates can't be: they are neighbours
    d = d.withColumn("_home", home).filter("_run = _home").drop("_run", "_home")
    base = F.coalesce(F.sum(F.when(F.col("age") < anchor, F.col("value"))).over(by), F.lit(0.0))
    up = F.sum("value").over(along.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_base", base).withColumn("_up", up).withColumn("_first", F.row_number().over(along) == 1)
    here = F.struct((F.col("age") + 1).alias("age"), (F.col("_up") - F.col("_base")).alias("value"))
    start = F.struct(F.col("age").alias("age"), (-F.col("_base")).alias("value"))
    out = d.select(*keys, F.explode(F.when(F.col("_first"), F.array(start, here)).otherwise(F.array(here))).alias("c"))
    # the anchor itself is 0 exactly, not the difference of two sums
    return out.select(*keys, F.col("c.age").alias("age"), F.when(F.col("c.age") == anchor, 0.0).otherwise(F.col("c.value")).alias("value"))


def position_curves(samples: DataFrame, anchor: int) -> DataFrame:
    """(chain, draw, position, age, value): each position's curve relative to the anchor, a draw at a time."""
    return curves_of_deltas(samples.filter("site = 'position'"), *DRAW, "position", anchor=anchor)


def league_curves(samples: DataFrame, anchor: int) -> DataFrame:
    """(chain, draw, age, value)."""
    return curves_of_deltas(samples.filter("site = 'league'"), *DRAW, anchor=anchor)


def relative_curves(curves: DataFrame, *keys: str, anchor: int) -> DataFrame:
    """``curves`` (keys, age, value) less each key's value at the anchor; keys without one have no relative curve."""
    at = F.max(F.when(F.col("age") == anchor, F.col("value"))).over(Window.partitionBy(*keys))
    return curves.select(*keys, "age", "value").withColumn("_at", at).filter("_at is not null").select(*keys, "age", (F.col("value") - F.col("_at")).alias("value"))


def player_curves(samples: DataFrame, anchor: int, level: bool = True) -> DataFrame:
    """(chain, draw, player_id, age, value): ratings, or without their ``level`` the bare shape, 0 at the anchor."""
    own = samples.filter("site = 'player'").select(*DRAW, "player_id", "age", "value")
    return own if level else relative_curves(own, *DRAW, "player_id", anchor=anchor)


def curve_summary(curves: DataFrame, *keys: str, prob: float = 0.8) -> DataFrame:
    """(keys, age, n, mean, sd, lower, upper) over draws, with the central ``prob`` interval."""
    tail = (1 - prob) / 2
    return curves.groupBy(*keys, "age").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.percentile("value", tail).alias("lower"), F.percentile("value", 1 - tail).alias("upper"))


def max_r_hat(samples: DataFrame, *keys: str, site: str = "site") -> DataFrame:
    """(site, r_hat, n): the largest split R-hat among a site's values and their number. ``keys`` tell its values apart;
    null keys count as a value. A value that never moves has none and is left out of the maximum."""
    tell = keys or ("player_id", "position", "age")
    r = split_r_hat(samples, site, *tell)
    return r.groupBy(site).agg(F.max(F.when(~F.isnan("r_hat"), F.col("r_hat"))).alias("r_hat"), F.count("*").alias("n"))


def predictive_draws(samples: DataFrame, observations: DataFrame, seed: int = 0, key: str = "observation") -> DataFrame:
    """(key, player_id, age, y, chain, draw, value): what each observation could have been, once for every draw.

    ``observations``: (key, player_id, age, y, w), w in possessions; ``key`` tells them apart. The value is the player's
    rating of that draw at that age plus noise of sigma_obs / sqrt(w / 1000), drawn from the stream named by (seed,
    key, chain, draw), so it doesn't depend on the order or number of partitions. Draws meet observations by player and
    age, and sigmas by draw; observations of a player or age that wasn't fitted meet none.
    """
    rating = samples.filter("site = 'player'").select(*DRAW, "player_id", "age", F.col("value").alias("_mean"))
    sigma = samples.filter("site = 'sigma_obs'").select(*DRAW, F.col("value").alias("_sigma"))
    spread = F.col("_sigma") / F.sqrt(F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(1e-6)) / 1000)
    # the noise's size is a property of a draw: it joins the narrow draws, before they meet the observations
    met = observations.select(key, "player_id", "age", "y", "w").join(rating.join(sigma, list(DRAW)), ["player_id", "age"])
    return met.select(key, "player_id", "age", "y", *DRAW, (F.col("_mean") + spread * normal(seed, key, *DRAW)).alias("value"))


def predictive_intervals(draws: DataFrame, prob: float = 0.9, key: str = "observation") -> DataFrame:
    """(key, y, lower, upper, inside) for each observation; ends count as inside. A group is the draws of one observation."""
    tail = (1 - prob) / 2
    own = draws.groupBy(key).agg(F.first("y").alias("y"), F.percentile("value", tail).alias("lower"), F.percentile("value", 1 - tail).alias("upper"))
    return own.withColumn("inside", F.col("y").between(F.col("lower"), F.col("upper")))


def predictive_coverage(samples: DataFrame, observations: DataFrame, prob: float = 0.9, seed: int = 0, key: str = "observation") -> DataFrame:
    """One row: coverage, the share of observations inside their central ``prob`` interval, and n, those that met draws.

    Near ``prob`` if the model is well specified; well below it the posterior is too sure of itself. Observations of a
    null rating don't count; without any, coverage is null.
    """
    i = predictive_intervals(predictive_draws(samples, observations.filter("y is not null"), seed, key), prob, key)
    return i.agg(F.avg(F.col("inside").cast("double")).alias("coverage"), F.count("*").alias("n"))


#: numbers a sketch keeps on its lowest level
SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """Bound on the rank error of a quantile, as a share of all values, that holds with 99 % certainty."""
    return 2.296 / k**0.9723


def sketches(samples: DataFrame, *keys: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, mean, sketch): a KLL sketch of each group's values, a few kilobytes however many draws there are.

    Sketches of chains, batches or seasons can be stored and merged later; up to ``k`` values they are exact.
    """
    return samples.filter("value is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_sketches(parts: DataFrame, *keys: str, k: int = SKETCH_K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; the values are not read again."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_summary(parts: DataFrame, *keys: str, prob: float = 0.8) -> DataFrame:
    """(keys, n, mean, lower, upper): the central interval, its ends off by ``rank_error`` in rank at most."""
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return parts.select(*keys, "n", "mean", q((1 - prob) / 2).alias("lower"), q((1 + prob) / 2).alias("upper"))


def sketch_rank(sketch: str, value):
    """Share of the sketched values up to ``value``."""
    return F.kll_sketch_get_rank_double(sketch, value)
