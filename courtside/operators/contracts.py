"""Contract rows to contract-years, payroll and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import short_hash


def guarantee_cliff(years: list[Column], guaranteed: Column, tolerance: int = 1) -> tuple[Column, Column]:
    """(number of leading years that add up to ``guaranteed``, whether there is one).

    Sums stop at the first missing year, as null spreads. Nothing guaranteed is 0 years and clean.
    """
    sums = list(reduce(lambda acc, y: [*acc, acc[-1] + y] if acc else [y], years, []))
    n = F.coalesce(*(F.when(F.abs(s - guaranteed) <= tolerance, F.lit(i + 1)) for i, s in enumerate(sums)))
    return F.when(guaranteed.isNull(), 0).otherwise(F.coalesce(n, F.lit(0))), guaranteed.isNull() | n.isNotNull()


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key (nulls equal) by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def multi_group(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in more than one group."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("n_groups")).filter("n_groups > 1")


def to_contract_years(contracts: DataFrame, seasons: tuple[str, ...]) -> DataFrame:
    """Rows (rk, player, team_abbrev, y1.., guaranteed, bbref_slug) to one row per paid season."""
    names = [f"y{i + 1}" for i in range(len(seasons))]
    ids = ["player", "team_abbrev", *names, "guaranteed", "bbref_slug"]
    rows = dedupe_first(contracts, ids, ["rk"])
    n, clean = guarantee_cliff([F.col(c) for c in names], F.col("guaranteed"))
    # a slug in two teams: counted by a window over the slug, which holds a handful of rows
    teams = F.size(F.collect_set("team_abbrev").over(Window.partitionBy("bbref_slug")))
    rows = rows.withColumn("n_gtd", n).withColumn("clean", clean).withColumn("multi", teams > 1)
    years = rows.select("*", F.posexplode(F.array(*(F.struct(F.lit(s).alias("season"), F.col(c).alias("cap_hit")) for s, c in zip(seasons, names, strict=True)))).alias("i", "y")).filter("y.cap_hit is not null")
    paid = F.col("i") < F.col("n_gtd")
    return years.select(
        short_hash("bbref_slug", "team_abbrev").alias("contract_id"), "y.season", "bbref_slug", "player", "team_abbrev", (F.col("i") + 1).cast("short").alias("season_index"), F.col("y.cap_hit").alias("cap_hit"),
        F.when(paid, F.col("y.cap_hit")).otherwise(F.lit(0).cast("long")).alias("guaranteed"), paid.alias("is_guaranteed"), F.lit(None).cast("string").alias("option_type"), (~F.col("clean") | F.col("multi")).alias("needs_review"),
        F.when(F.col("multi"), "multi_team_dead_money").when(~F.col("clean"), "partial_guarantee").alias("review_reason"),
    )


def group_payroll(rows: DataFrame, group: str, amount: str, flag: str) -> DataFrame:
    """Sum, count, flagged count and flagged sum of each group."""
    return rows.groupBy(group).agg(
        F.sum(amount).alias("payroll"), F.count("*").alias("n_players"), F.count_if(F.col(flag)).alias("n_review"), F.coalesce(F.sum(F.when(F.col(flag), F.col(amount))), F.lit(0).cast("long")).alias("review_amount")
    )


def team_payroll(years: DataFrame, season: str) -> DataFrame:
    return group_payroll(years.filter(F.col("season") == season), "team_abbrev", "cap_hit", "needs_review").orderBy(F.desc("payroll"), "team_abbrev")


def crosswalk_seed(contracts: DataFrame) -> DataFrame:
    return contracts.select("player", "bbref_slug").distinct()


def group_bounds(rows: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """Groups with fewer than ``low`` or more than ``high`` rows."""
    return rows.groupBy(group).agg(F.count("*").alias("n_rows")).filter((F.col("n_rows") < low) | (F.col("n_rows") > high)).withColumn("bound", F.when(F.col("n_rows") < low, "under").otherwise("over"))


def quality_report(contracts: DataFrame, known_teams: DataFrame, seasons: tuple[str, ...]) -> DataFrame:
    """One row of counts about a contract export."""
    names = [f"y{i + 1}" for i in range(len(seasons))]
    ids = ["player", "team_abbrev", *names, "guaranteed", "bbref_slug"]
    unique = dedupe_first(contracts, ids, ["rk"])
    _, clean = guarantee_cliff([F.col(c) for c in names], F.col("guaranteed"))
    sums = unique.agg(F.count("*").alias("n_unique"), F.count_if(~clean).alias("n_partial"), F.count_if(F.col("guaranteed").isNull()).alias("n_blank"))
    unknown = unknown_teams(unique, known_teams).agg(F.count("*").alias("n_unknown_teams"))
    several = multi_group(unique, "bbref_slug", "team_abbrev").agg(F.count("*").alias("n_multi_team"))
    # four tables of one row each
    return contracts.agg(F.count("*").alias("n_rows")).crossJoin(sums).crossJoin(unknown).crossJoin(several).withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique"))


def unknown_teams(contracts: DataFrame, known_teams: DataFrame) -> DataFrame:
    """Team codes that no known team has."""
    return contracts.select("team_abbrev").distinct().join(known_teams.select("team_abbrev").distinct(), "team_abbrev", "left_anti")


def blocking_issues(report: DataFrame) -> list[str]:
    """What keeps a legal apron payroll from being computed, of one report row."""
    r = report.first()
    said = (("n_multi_team", "players count on more than one team (dead money)"), ("n_partial", "guarantees match no number of whole years"), ("n_unknown_teams", "team codes are unknown"))
    return [f"{r[c]} {text}" for c, text in said if r[c]]
