"""Who is who: names to ids inside a game, and players to slugs across sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import names_consistent, normalize_name
from ..functions.parsing import is_substitution, sub_names
from ..session import plain_unions

#: fixed values: least score of a match, and of a candidate
ACCEPT, CANDIDATE = 0.93, 0.80


def name_registry(actions: DataFrame) -> DataFrame:
    """(game_id, team_id, name) -> player_id and order of first mention.

    A reliable action sets its name, the last one winning; the outgoing name in a substitution's text is an alias
    that holds only where no reliable action set one. Both are one aggregate: the last reliable id, else the first
    alias; order is the first mention of either.
    """
    _, out_name = sub_names("description")
    reliable = actions.filter("reliable").select("game_id", "team_id", normalize_name("player_name").alias("name"), "person_id", "pos", F.lit(0).alias("alias"))
    alias = actions.filter(is_substitution("event_type")).select("game_id", "team_id", normalize_name(out_name).alias("name"), "person_id", "pos", F.lit(1).alias("alias")).filter("name is not null and person_id is not null")
    last = F.max_by("person_id", F.when(F.col("alias") == 0, F.col("pos")))
    first = F.min_by("person_id", F.when(F.col("alias") == 1, F.col("pos")))
    return plain_unions(reliable).unionByName(alias).groupBy("game_id", "team_id", "name").agg(F.coalesce(last, first).alias("player_id"), F.min(2 * F.col("pos") + F.col("alias")).alias("mention"))


def resolve_incoming(actions: DataFrame) -> DataFrame:
    """Incoming player of each substitution: exact name, else the first mentioned name that holds all its words."""
    reg = name_registry(actions)
    in_name, _ = sub_names("description")
    subs = actions.filter(is_substitution("event_type")).select("game_id", "event_num", "team_id", normalize_name(in_name).alias("want"))
    exact = reg.select("game_id", "team_id", F.col("name").alias("want"), F.col("player_id").alias("exact_id"))
    subs = subs.join(exact, ["game_id", "team_id", "want"], "left")
    loose = (
        subs.filter("exact_id is null and want is not null").join(reg, ["game_id", "team_id"]).filter(F.size(F.array_except(F.split("name", " "), F.split("want", " "))) == 0)
        .groupBy("game_id", "event_num").agg(F.min_by("player_id", "mention").alias("loose_id"))
    )
    return subs.join(loose, ["game_id", "event_num"], "left").select("game_id", "event_num", F.coalesce("exact_id", "loose_id").alias("player2_id"))


def sub_audit(actions: DataFrame) -> DataFrame:
    """Per game: substitutions, incoming names nobody answers to, and outgoing names at odds with the player's own."""
    subs = actions.filter(is_substitution("event_type"))
    _, out_name = sub_names("description")
    odd = subs.select("game_id", F.coalesce(out_name.isNotNull() & ~names_consistent(out_name, F.col("player_name")), F.lit(False)).alias("odd"), "event_num")
    known = resolve_incoming(actions)
    return odd.join(known, ["game_id", "event_num"], "left").groupBy("game_id").agg(F.count("*").alias("n_subs"), F.count_if(F.col("player2_id").isNull()).alias("n_unresolved"), F.count_if("odd").alias("n_inconsistent"))


def pbp_events(actions: DataFrame) -> DataFrame:
    """``stg.pbp_event`` rows: player 1 goes out and player 2 comes in on a substitution; unresolved ids stay null."""
    who = F.when(F.col("reliable"), F.col("person_id"))
    sub = is_substitution("event_type")
    return actions.join(resolve_incoming(actions), ["game_id", "event_num"], "left").select(
        "game_id", "event_num", "period", "clock_seconds_left", "event_type", "event_action_type", "description", "team_id", F.when(sub, F.nullif(F.col("person_id"), F.lit(0).cast("long"))).otherwise(who).alias("player1_id"), "player2_id",
        F.lit(None).cast("long").alias("player3_id"), "home_score", "away_score",
    )


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from difflib import SequenceMatcher

    for pdf in batches:
        m, scores, last = SequenceMatcher(autojunk=True), [], None
        for a, b in zip(pdf["name"], pdf["candidate"], strict=True):
            if b != last:
                m.set_seq2(b)
                last = b
            m.set_seq1(a)
            scores.append(m.ratio() if m.real_quick_ratio() >= CANDIDATE and m.quick_ratio() >= CANDIDATE else 0.0)
        yield pdf.assign(score=scores)


#: names of so few letters may share no letter pair with what they match
SHORT = 3


def _pairs_of(names: DataFrame, key: str) -> DataFrame:
    """(key, n, pair): the letter pairs of each name, a repeated pair numbered."""
    at = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(F.col(key), i, F.lit(2)))
    numbered = F.expr("transform(grams, (g, i) -> concat(g, size(filter(slice(grams, 1, i + 1), x -> x = g))))")
    return names.filter(F.length(key) > SHORT).withColumn("grams", at).select(key, F.length(key).alias("n"), F.explode(numbered).alias("pair"))


def _shown(pairs: DataFrame, often: DataFrame, key: str) -> DataFrame:
    """The rarest pairs of each name: all but those that any match must share, and one."""
    letters = F.col("n") + F.ceil(F.col("n") * (CANDIDATE / (2 - CANDIDATE)))  # of both names, at least
    need = F.greatest(F.lit(1), F.ceil(letters * (1.5 * CANDIDATE - 1) - 1 - 1e-9))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("often", "pair"))
    return pairs.join(often, "pair").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - 1 - need + 1).select(key, "n", "pair")


def match_names(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """targets (id, full_name) against candidates (full_name, slug): slug, score, best candidate.

    Equal normal forms match by an equi-join. The rest meet by a prefix filter that loses no match: in names of T
    letters together, M of them matched on either side, there are at most ``T - 2M + 1`` matching blocks, so at least
    ``M - (T - 2M + 1)`` letter pairs are shared, and M is half the ratio times T. Of a name's pairs, the rarest that
    leave out one fewer than that are joined. Names of ``SHORT`` letters or fewer meet by length. Lengths bound the
    ratio as well; the worker bounds it by letters before matching.
    """
    t = targets.select("id", normalize_name("full_name").alias("name"))
    c = candidates.select(normalize_name("full_name").alias("candidate"), "slug").groupBy("candidate").agg(F.min("slug").alias("slug"))
    exact = t.join(c, t.name == c.candidate).select("id", "slug", F.lit(1.0).alias("score"))
    rest = t.join(exact, "id", "left_anti").filter("name <> ''")
    names = rest.select("name").distinct()
    a, b = _pairs_of(names, "name"), _pairs_of(c.select("candidate"), "candidate")
    often = b.groupBy("pair").agg(F.count("*").alias("often"))
    near = _shown(a, often, "name").alias("a").join(_shown(b, often, "candidate").alias("b"), "pair").filter((2 * F.least("a.n", "b.n") >= CANDIDATE * (F.col("a.n") + F.col("b.n")))).select("name", "candidate").distinct()
    least = CANDIDATE / (2 - CANDIDATE)
    reach = lambda d, key: d.select(key).withColumn("n", F.length(key))
    short = reach(names, "name").withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * least).cast("int"), F.floor(F.col("n") / least).cast("int")))).drop("n")
    short = short.join(reach(c, "candidate").withColumnRenamed("n", "m"), "m").filter((F.length("name") <= SHORT) | (F.col("m") <= SHORT)).select("name", "candidate")
    near = near.unionByName(short).distinct().join(c, "candidate").join(rest, "name")
    near = near.select("id", "name", "candidate", "slug").mapInPandas(_ratios, "id long, name string, candidate string, slug string, score double")
    best = near.filter(F.col("score") >= CANDIDATE).groupBy("id").agg(F.max_by("slug", F.struct("score", "candidate")).alias("slug"), F.max("score").alias("score"))
    return plain_unions(exact).unionByName(best)


def build_crosswalk(players: DataFrame, bbref: DataFrame, spotrac: DataFrame | None, overrides: DataFrame | None) -> DataFrame:
    """Slugs of each player: overrides first (manual, 1.0), else the best match of each source.

    The score is the lesser of the sources'; below the accepted score a slug is left null.
    """
    own = players.select(F.col("nba_player_id").alias("id"), "full_name")
    a = match_names(own, bbref).select("id", F.col("slug").alias("b"), F.col("score").alias("bs"))
    j = own.join(a, "id", "left")
    if spotrac is None:
        j = j.withColumn("s", F.lit(None).cast("string")).withColumn("ss", F.lit(0.0))
    else:
        j = j.join(match_names(own, spotrac).select("id", F.col("slug").alias("s"), F.col("score").alias("ss")), "id", "left")
    if overrides is None:
        j = j.withColumns({"ob": F.lit(None).cast("string"), "os": F.lit(None).cast("string"), "forced": F.lit(False)})
    else:
        j = j.join(overrides.select(F.col("nba_player_id").alias("id"), F.col("bbref_slug").alias("ob"), F.col("spotrac_slug").alias("os"), F.lit(True).alias("forced")), "id", "left")
    bs, ss, forced = F.coalesce("bs", F.lit(0.0)), F.coalesce("ss", F.lit(0.0)), F.coalesce("forced", F.lit(False))
    return j.select(
        F.col("id").alias("nba_player_id"), F.when(forced, F.col("ob")).when(bs >= ACCEPT, F.col("b")).alias("bbref_slug"), F.when(forced, F.col("os")).when(ss >= ACCEPT, F.col("s")).alias("spotrac_slug"),
        F.when(forced, "manual").when(F.greatest(bs, ss) == 1.0, "exact").otherwise("fuzzy").alias("match_method"), F.when(forced, 1.0).otherwise(F.least(bs, ss)).alias("match_score"),
    )


def unresolved(players: DataFrame, crosswalk: DataFrame) -> DataFrame:
    return players.join(crosswalk, "nba_player_id", "left").filter("bbref_slug is null or spotrac_slug is null").orderBy(F.desc_nulls_last("to_year"), "full_name", "nba_player_id")
