"""Stints to offence blocks and on/off splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import elapsed
from ..session import plain_unions


def _has(c: str, word: str) -> Column:
    return F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False))


def is_attempt() -> Column:
    return _has("event_type", "shot")


def is_turnover() -> Column:
    return _has("event_type", "turnover")


def is_offensive_rebound() -> Column:
    return _has("event_type", "rebound") & _has("event_action_type", "offensive")


def is_free_throw() -> Column:
    return _has("event_type", "free throw")


def points() -> Column:
    """A free throw counts only if the type also says it was made."""
    made = _has("event_type", "made")
    return F.when(is_free_throw() & made, 1).when(is_attempt() & made, F.when(_has("description", "3pt") | _has("description", "three"), 3).otherwise(2)).otherwise(0)


def possessions(fga, oreb, tov, fta) -> Column:
    return fga - oreb + tov + F.lit(0.44) * fta


def in_stint(events: DataFrame, stints: DataFrame) -> DataFrame:
    """``events`` (game_id, period, t, ...) with the stint_no that has ``start <= t < end`` in their period; others are left out.

    Stints of a period don't overlap, so no join is needed: events and starts are united, sorted once by period and
    time, starts before events of the same time, and the last start is carried forward. Rows in are rows out.
    """
    rest = [c for c in events.columns if c not in ("game_id", "period", "t")]
    starts = plain_unions(stints).select("game_id", "period", F.col("start_s").alias("t"), F.struct("stint_no", "end_s").alias("_stint"))
    both = events.select("game_id", "period", "t", F.struct(*rest).alias("_event")).unionByName(starts, allowMissingColumns=True)
    so_far = Window.partitionBy("game_id", "period").orderBy("t", F.col("_event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_stint", F.last("_stint", ignorenulls=True).over(so_far))
    return met.filter("_event is not null and t < _stint.end_s").select("game_id", "period", "t", "_stint.stint_no", "_event.*")


def tally_by_stint(events: DataFrame, stints: DataFrame) -> DataFrame:
    """Counts per stint and team of the events with a team that fall into a stint."""
    e = events.filter("team_id is not null").select("game_id", "period", "team_id", elapsed("period", "clock_seconds_left").alias("t"), is_attempt().alias("fga"), is_offensive_rebound().alias("oreb"), is_turnover().alias("tov"), is_free_throw().alias("fta"), points().alias("pts"))
    j = in_stint(e.filter("t is not null"), stints)
    return j.groupBy("game_id", "period", "stint_no", "team_id").agg(*(F.count_if(c).alias(c) for c in ("fga", "oreb", "tov", "fta")), F.sum("pts").alias("pts"))


def split_lineups(stints: DataFrame, box: DataFrame) -> DataFrame:
    """Stints whose ten players are five and five of two known teams, as a row per side."""
    team = box.select("game_id", F.col("nba_player_id").alias("player_id"), F.col("nba_team_id").alias("team_id"))
    j = stints.select("game_id", "period", "stint_no", F.size("lineup").alias("n"), F.explode("lineup").alias("player_id")).join(team, ["game_id", "player_id"], "left")
    sides = j.groupBy("game_id", "period", "stint_no", "n", "team_id").agg(F.array_sort(F.collect_set("player_id")).alias("five"))
    good = sides.filter("n = 10 and team_id is not null and size(five) = 5")
    both = good.groupBy("game_id", "period", "stint_no").agg(F.count("*").alias("k")).filter("k = 2").drop("k")
    return good.join(both, ["game_id", "period", "stint_no"]).drop("n")


def offense_blocks(events: DataFrame, stints: DataFrame, box: DataFrame) -> DataFrame:
    """One row per stint and side with possessions: offence, defence, points, possessions."""
    sides = split_lineups(stints, box)
    pair = sides.alias("o").join(sides.alias("d"), ["game_id", "period", "stint_no"]).filter("o.team_id <> d.team_id").select("game_id", "period", "stint_no", F.col("o.team_id").alias("team_id"), F.col("o.five").alias("offense"), F.col("d.five").alias("defense"))
    t = tally_by_stint(events, stints).withColumn("possessions", possessions(F.col("fga"), F.col("oreb"), F.col("tov"), F.col("fta")))
    return pair.join(t, ["game_id", "period", "stint_no", "team_id"]).filter("possessions > 0").select("game_id", "period", "stint_no", "team_id", "offense", "defense", F.col("pts").cast("double").alias("points"), "possessions")


def warehouse_blocks(events: DataFrame, box: DataFrame, games: DataFrame, stints: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of games that pass, games left out with the reason: missing or the gate's category)."""
    has = games.select("game_id").join(events.select("game_id").distinct().withColumn("e", F.lit(True)), "game_id", "left").join(box.select("game_id").distinct().withColumn("b", F.lit(True)), "game_id", "left")
    state = has.join(gate.select("game_id", "passed", "category"), "game_id", "left").withColumn("reason", F.when(F.col("e").isNull() | F.col("b").isNull(), "missing").when(~F.col("passed"), F.col("category")))
    good = state.filter("reason is null").select("game_id")
    return offense_blocks(events.join(good, "game_id", "left_semi"), stints.join(good, "game_id", "left_semi"), box), state.filter("reason is not null").select("game_id", "reason")


def on_off_defense(blocks: DataFrame) -> DataFrame:
    """Points allowed per 100 with a player on defence, and without them in the block at all.

    "Off" is all blocks less those the player took part in, so no player meets every block.
    """
    roles = blocks.select("points", "possessions", F.explode(F.concat(F.transform("defense", lambda p: F.struct(p.alias("player_id"), F.lit(True).alias("d"))), F.transform("offense", lambda p: F.struct(p.alias("player_id"), F.lit(False).alias("d"))))).alias("r")).select("points", "possessions", "r.*")
    own = roles.groupBy("player_id").agg(F.sum(F.when(F.col("d"), F.col("points")).otherwise(0.0)).alias("on_pts"), F.sum(F.when(F.col("d"), F.col("possessions")).otherwise(0.0)).alias("on_poss"), F.sum("points").alias("any_pts"), F.sum("possessions").alias("any_poss"))
    total = blocks.agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("pts"), F.coalesce(F.sum("possessions"), F.lit(0.0)).alias("poss"))
    j = own.crossJoin(F.broadcast(total))  # one row
    per = lambda p, n: F.when(n > 1e-9, 100 * p / n).otherwise(0.0)
    on, off = per(F.col("on_pts"), F.col("on_poss")), per(F.col("pts") - F.col("any_pts"), F.col("poss") - F.col("any_poss"))
    return j.select("player_id", on.alias("on_per_100"), off.alias("off_per_100"), (on - off).alias("difference"), "on_poss", (F.col("poss") - F.col("any_poss")).alias("off_poss"))
