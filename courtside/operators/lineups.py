"""Lineups from substitutions, as windows and joins over all games at once.

Input events: game_id, event_num, period, clock_seconds_left, event_type, event_action_type, team_id,
player1_id (out on a substitution), player2_id (in), player3_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import last_name
from ..functions.parsing import elapsed, is_substitution, period_seconds
from ..session import plain_unions

SLOTS = ("player1_id", "player2_id", "player3_id")
TOLERANCE = 90.0


def _slots(events: DataFrame, *columns: str) -> DataFrame:
    return events.select(*columns, F.explode(F.array(*(F.struct(F.lit(i + 1).alias("slot"), F.col(c).alias("player_id")) for i, c in enumerate(SLOTS)))).alias("s")).select(*columns, "s.slot", "s.player_id").filter("player_id is not null")


def phantom_audit(events: DataFrame, players: DataFrame) -> DataFrame:
    """Ids in any player slot that aren't players, counted by event type."""
    known = players.select(F.col("nba_player_id").alias("player_id"))
    return _slots(events, "event_type").join(known, "player_id", "left_anti").groupBy("event_type", "player_id").agg(F.count("*").alias("n")).orderBy("event_type", F.desc("n"), "player_id")


def apply_allowlist(events: DataFrame, players: DataFrame | None) -> DataFrame:
    """Events with unknown ids nulled in all slots; without players, as they are."""
    if players is None:
        return events
    known = players.select(F.col("nba_player_id").alias("player_id")).filter("player_id is not null").distinct()
    bad = _slots(events, "game_id", "event_num").join(known, "player_id", "left_anti").groupBy("game_id", "event_num").agg(F.collect_set("player_id").alias("_bad"))
    bad = bad.select(F.col("game_id").alias("_game"), F.col("event_num").alias("_num"), "_bad")
    # null-safe: an event without a number has its ids looked up as well
    out = events.join(bad, events.game_id.eqNullSafe(bad["_game"]) & events.event_num.eqNullSafe(bad["_num"]), "left")
    keep = {c: F.when(~F.coalesce(F.array_contains("_bad", F.col(c)), F.lit(False)), F.col(c)) for c in SLOTS}
    return out.withColumns(keep).select(events.columns)


def ordered_events(events: DataFrame) -> DataFrame:
    """Adds ``pos`` in game time (clock falling, unknown first, then number) and seconds elapsed."""
    w = Window.partitionBy("game_id", "period").orderBy(F.desc_nulls_first("clock_seconds_left"), "event_num")
    return events.withColumn("pos", F.row_number().over(w)).withColumn("t", elapsed("period", "clock_seconds_left"))


def openers(ordered: DataFrame) -> DataFrame:
    """Players on the floor when a period begins: seen before they were first sent in, or never sent in."""
    sub = is_substitution("event_type")
    technical = F.coalesce(F.col("event_action_type") == "Technical", F.lit(False))
    seen = _slots(ordered.withColumn("sub", sub).withColumn("tech", technical), "game_id", "period", "pos", "sub", "tech")
    enters = F.col("sub") & (F.col("slot") == 2)
    first = seen.groupBy("game_id", "period", "player_id").agg(F.min(F.when(~enters & ~F.col("tech"), F.col("pos"))).alias("seen"), F.min(F.when(enters, F.col("pos"))).alias("entered"))
    return first.filter("seen is not null and (entered is null or seen < entered)").select("game_id", "period", "player_id")


def reconstruct_stints(events: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Stints (game_id, period, stint_no, start_s, end_s, lineup): who is on the floor between substitutions.

    Each player's openers, exits and entries in order give intervals of being on; a stint's lineup is who is on at
    its end. Stints of no length are left out. A period with events but nobody seen has one empty stint.
    """
    ev = plain_unions(ordered_events(apply_allowlist(events, players)))
    subs = ev.filter(is_substitution("event_type"))
    toggles = (
        openers(ev).select("game_id", "period", "player_id", F.lit(0).cast("long").alias("k"), F.lit(1).alias("on"))
        .unionByName(subs.filter("player1_id is not null").select("game_id", "period", F.col("player1_id").alias("player_id"), (2 * F.col("pos")).cast("long").alias("k"), F.lit(0).alias("on")))
        .unionByName(subs.filter("player2_id is not null").select("game_id", "period", F.col("player2_id").alias("player_id"), (2 * F.col("pos") + 1).cast("long").alias("k"), F.lit(1).alias("on")))
    )
    own = Window.partitionBy("game_id", "period", "player_id").orderBy("k")
    on = toggles.withColumn("k2", F.lead("k").over(own)).filter("on = 1").select("game_id", "period", "player_id", "k", "k2")
    whole = ev.select("game_id", "period").distinct().select("game_id", "period", F.lit(None).cast("long").alias("kend"), period_seconds("period").alias("end_s"))
    ends = subs.select("game_id", "period", (2 * F.col("pos")).cast("long").alias("kend"), F.col("t").alias("end_s")).unionByName(whole)
    order = Window.partitionBy("game_id", "period").orderBy(F.asc_nulls_last("kend"))
    ends = ends.withColumn("start_s", F.coalesce(F.lag("end_s").over(order), F.lit(0.0)))
    # a start is the last emitted end: stints of no or negative length don't move it
    ends = ends.withColumn("reach", F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("start_s", F.greatest(F.coalesce("reach", F.lit(0.0)), F.lit(0.0))).filter("end_s > start_s").drop("reach")
    hit = (F.col("k") < F.coalesce("kend", F.lit(1 << 40))) & (F.col("k2").isNull() | (F.coalesce("kend", F.lit(1 << 40)) <= F.col("k2")))
    stints = ends.join(on, ["game_id", "period"], "left").groupBy("game_id", "period", "kend", "start_s", "end_s").agg(F.array_sort(F.collect_set(F.when(hit, F.col("player_id")))).alias("lineup"))
    return stints.withColumn("stint_no", F.row_number().over(order)).drop("kend")


def exits_while_off(events: DataFrame) -> DataFrame:
    """Substitutions that send off a player who isn't on the floor."""
    ev = plain_unions(ordered_events(events))
    subs = ev.filter(is_substitution("event_type"))
    start = openers(ev).select("game_id", "period", "player_id", F.lit(0).alias("k"), F.lit(1).alias("on"), F.lit(None).cast("int").alias("event_num"))
    t = start.unionByName(subs.filter("player1_id is not null").select("game_id", "period", F.col("player1_id").alias("player_id"), (2 * F.col("pos")).alias("k"), F.lit(0).alias("on"), "event_num")).unionByName(
        subs.filter("player2_id is not null").select("game_id", "period", F.col("player2_id").alias("player_id"), (2 * F.col("pos") + 1).alias("k"), F.lit(1).alias("on"), "event_num")
    )
    before = F.lag("on").over(Window.partitionBy("game_id", "period", "player_id").orderBy("k"))
    return t.withColumn("before", before).filter("on = 0 and coalesce(before, 0) = 0").select("game_id", "period", "event_num", "player_id")


def player_seconds(stints: DataFrame) -> DataFrame:
    return stints.select("game_id", F.explode("lineup").alias("player_id"), (F.col("end_s") - F.col("start_s")).alias("s")).groupBy("game_id", "player_id").agg(F.sum("s").alias("seconds"))


def minutes_gate(seconds: DataFrame, box: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Full outer comparison of reconstructed and official seconds, one row per game and player."""
    b = box.select("game_id", F.col("nba_player_id").alias("player_id"), F.col("seconds_played").cast("double").alias("box_s"))
    j = seconds.join(b, ["game_id", "player_id"], "full_outer").select("game_id", "player_id", F.coalesce("seconds", F.lit(0.0)).alias("recon_s"), F.coalesce("box_s", F.lit(0.0)).alias("box_s"))
    return j.withColumn("error", F.abs(F.col("recon_s") - F.col("box_s"))).withColumn("offends", F.col("error") > tolerance)


def gate_results(gate: DataFrame, box: DataFrame, names: DataFrame) -> DataFrame:
    """Per game: passed, largest error, offenders, and why it failed.

    surname-collision: an offender shares a last name with a team mate; data-gap: no offender was seen at all;
    isolated: the rest.
    """
    roster = box.select("game_id", F.col("nba_player_id").alias("player_id"), F.col("nba_team_id").alias("team_id")).join(names.filter(F.coalesce("full_name", F.lit("")) != "").select(F.col("nba_player_id").alias("player_id"), last_name("full_name").alias("last")), "player_id")
    shared = roster.groupBy("game_id", "team_id", "last").agg(F.count_distinct("player_id").alias("n")).filter("n > 1")
    twins = roster.join(shared, ["game_id", "team_id", "last"]).select("game_id", "player_id", F.lit(True).alias("twin")).distinct()
    off = F.col("offends")
    return gate.join(twins, ["game_id", "player_id"], "left").groupBy("game_id").agg(
        (~F.bool_or("offends")).alias("passed"), F.max("error").alias("max_error"), F.count_if(off).alias("n_offenders"), F.bool_or(off & F.coalesce("twin", F.lit(False))).alias("twin"), F.bool_and(~off | (F.col("recon_s") == 0)).alias("unseen"),
        F.max_by("player_id", F.struct("error", "player_id")).alias("worst_player"),
    ).select("game_id", "passed", "max_error", "n_offenders", "worst_player", F.when(F.col("passed"), None).when(F.col("twin"), "surname-collision").when(F.col("unseen"), "data-gap").otherwise("isolated").alias("category"))


def gate_offenders(gate: DataFrame) -> DataFrame:
    """Players over the tolerance, the largest error of each game first."""
    place = F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("error"), "player_id"))
    return gate.filter("offends").withColumn("place", place).select("game_id", "place", "player_id", "recon_s", "box_s", "error")


def gate_accounting(results: DataFrame, games: DataFrame) -> DataFrame:
    """Counts by season and pooled (null season): all, passed, failed by category, without data."""
    j = games.select("game_id", "season").join(results, "game_id", "left")
    c = F.col("category")
    return j.rollup("season").agg(
        F.count("*").alias("n_games"), F.count_if(F.col("passed")).alias("n_included"), F.count_if(F.col("passed").isNull()).alias("n_missing"), F.count_if(c == "surname-collision").alias("n_surname"), F.count_if(c == "data-gap").alias("n_gap"), F.count_if(c == "isolated").alias("n_isolated")
    )
