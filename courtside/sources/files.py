"""Readers and writers."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import strip_dollars
from ..functions.parsing import clock_seconds, has_reliable_player, minutes_to_seconds, safe_int, snake_case
from ..schemas import CONTRACT_YEAR, TABLES
from ..session import plain_unions

#: fixed values: three codes that the contract export spells its own way
TEAM_CODES = {"BRK": "BKN", "CHO": "CHA", "PHO": "PHX"}
SEASONS = ("2026-27", "2027-28", "2028-29", "2029-30", "2030-31", "2031-32")


def read_contract_csv(spark: SparkSession, path: str) -> DataFrame:
    """Contract export: everything is text; header lines (two) are those whose rank isn't a number."""
    raw = spark.read.csv(path, header=False, encoding="UTF-8", schema=", ".join(f"_c{i} string" for i in range(11)))
    codes = F.create_map(*(F.lit(x) for kv in TEAM_CODES.items() for x in kv))
    return raw.filter(F.col("_c0").try_cast("int").isNotNull()).select(
        F.col("_c0").cast("int").alias("rk"), F.col("_c1").alias("player"), F.coalesce(codes[F.col("_c2")], F.col("_c2")).alias("team_abbrev"),
        *(strip_dollars(f"_c{3 + i}").alias(f"y{i + 1}") for i in range(6)), strip_dollars("_c9").alias("guaranteed"), F.col("_c10").alias("bbref_slug"),
    )


def result_rows(payloads: DataFrame, payload: str, name: str | None = None) -> DataFrame:
    """Tabular ``resultSets`` JSON to one row (headers in snake case, values) for each of its rows.

    Without a name the first set is read; a name that a payload lacks is an error.
    """
    one = "struct<name:string,headers:array<string>,rowSet:array<array<string>>>"
    p = F.from_json(payload, f"struct<resultSets:array<{one}>,resultSet:{one}>")
    sets = F.coalesce(p["resultSets"], F.array(p["resultSet"]))
    chosen = F.element_at(sets, 1) if name is None else F.coalesce(F.get(F.filter(sets, lambda s: s["name"] == name), F.lit(0)), F.raise_error(F.lit(f"no result set {name}")).cast(one))
    keep = [c for c in payloads.columns if c != payload]
    return payloads.select(*keep, chosen.alias("s")).select(*keep, F.transform("s.headers", snake_case).alias("headers"), F.posexplode("s.rowSet").alias("row_no", "row")).select(*keep, "row_no", F.map_from_arrays("headers", "row").alias("fields"))


def games_from_team_rows(rows: DataFrame) -> DataFrame:
    """Home and away rows of a game side by side; '@' in the matchup marks the visitor. One-sided games go.

    A conditional aggregate, so the team rows are shuffled once and not joined with themselves.
    """
    away = F.col("matchup").contains("@")
    side = lambda c, flag: F.max(F.when(away if flag else ~away, F.col(c)))
    return rows.groupBy("game_id").agg(
        F.max("season").alias("season"), F.max("game_date").alias("game_date"), side("team_id", False).alias("home_team_id"), side("team_id", True).alias("away_team_id"), side("pts", False).alias("home_pts"), side("pts", True).alias("away_pts")
    ).filter("home_team_id is not null and away_team_id is not null")


ACTIONS = "struct<game:struct<gameId:string,actions:array<struct<actionNumber:int,clock:string,period:int,teamId:long,teamTricode:string,personId:long,playerName:string,playerNameI:string,description:string,actionType:string,subType:string,scoreHome:string,scoreAway:string>>>>"
_PLAYER = "struct<personId:long,firstName:string,familyName:string,position:string,comment:string,statistics:struct<minutes:string,points:int,reboundsTotal:int,assists:int>>"
BOX = f"struct<boxScoreTraditional:struct<gameId:string,homeTeam:struct<teamId:long,players:array<{_PLAYER}>>,awayTeam:struct<teamId:long,players:array<{_PLAYER}>>>>"


def pbp_actions(payloads: DataFrame, payload: str, game_id: str = "game_id") -> DataFrame:
    """Play-by-play JSON to actions in order, keyed by game and number, the first of a repeated number kept."""
    a = payloads.select(F.col(game_id).alias("game_id"), F.posexplode(F.from_json(payload, ACTIONS)["game"]["actions"]).alias("pos", "a")).filter("a.actionNumber is not null")
    w = Window.partitionBy("game_id", "event_num").orderBy("pos")
    out = a.select(
        "game_id", F.col("a.actionNumber").alias("event_num"), "pos", F.col("a.period").cast("short").alias("period"), clock_seconds(F.col("a.clock")).alias("clock_seconds_left"), F.col("a.actionType").alias("event_type"), F.col("a.subType").alias("event_action_type"),
        F.col("a.description").alias("description"), F.nullif(F.col("a.teamId"), F.lit(0)).alias("team_id"), F.col("a.personId").alias("person_id"), F.col("a.playerName").alias("player_name"),
        has_reliable_player(F.col("a.playerName"), F.col("a.teamId"), F.col("a.actionType"), F.col("a.personId")).alias("reliable"), safe_int(F.col("a.scoreHome")).cast("short").alias("home_score"), safe_int(F.col("a.scoreAway")).cast("short").alias("away_score"),
    )
    return out.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def box_players(payloads: DataFrame, payload: str, game_id: str = "game_id") -> DataFrame:
    """Box-score JSON to a row for each player; a starter has a position."""
    b = F.from_json(payload, BOX)["boxScoreTraditional"]
    t = payloads.select(F.col(game_id).alias("game_id"), F.explode(F.array(b["homeTeam"], b["awayTeam"])).alias("t")).select("game_id", F.col("t.teamId").alias("team"), F.explode("t.players").alias("p"))
    return t.select(
        "game_id", F.col("p.personId").alias("nba_player_id"), F.col("team").alias("nba_team_id"), minutes_to_seconds(F.col("p.statistics.minutes")).alias("seconds_played"), F.col("p.statistics.points").cast("short").alias("pts"),
        F.col("p.statistics.reboundsTotal").cast("short").alias("reb"), F.col("p.statistics.assists").cast("short").alias("ast"), (F.trim(F.coalesce("p.position", F.lit(""))) != "").alias("started"),
    ).filter("nba_player_id is not null").dropDuplicates(["game_id", "nba_player_id"])


def players_from_rows(rows: DataFrame) -> DataFrame:
    """Player index rows to players: bad numbers as null, first and last token of the display name."""
    name = F.split(F.trim("display_first_last"), r"\s+")
    return rows.select(
        F.col("person_id").try_cast("long").alias("nba_player_id"), F.col("display_first_last").alias("full_name"), F.element_at(name, 1).alias("first_name"), F.element_at(name, -1).alias("last_name"),
        F.col("from_year").try_cast("short").alias("from_year"), F.col("to_year").try_cast("short").alias("to_year"), (F.col("rosterstatus").try_cast("int") == 1).alias("is_active"),
    ).dropDuplicates(["nba_player_id"])


def teams_from_list(spark: SparkSession, teams: list[dict]) -> DataFrame:
    """A static team list (id, abbreviation, nickname, city, full_name) as ``stg.team`` rows."""
    rows = [(int(t["id"]), *(t.get(c) for c in ("abbreviation", "nickname", "city", "full_name"))) for t in teams]
    return spark.createDataFrame(rows, TABLES["stg.team"][1]).dropDuplicates(["nba_team_id"])


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """A YAML map of player id to slugs as (nba_player_id, bbref_slug, spotrac_slug, note); no file, no rows."""
    doc = {}
    if os.path.exists(path):
        with open(path) as f:
            doc = yaml.safe_load(f) or {}
    rows = [(int(k), *((v or {}).get(c) for c in ("bbref_slug", "spotrac_slug", "note"))) for k, v in doc.items()]
    return spark.createDataFrame(rows, "nba_player_id long, bbref_slug string, spotrac_slug string, note string")


def rows_where(rows: DataFrame, order_by: list | None = None, limit: int = 0, **equals) -> DataFrame:
    """Rows whose columns have the given values, in order; ``limit`` 0 is all of them."""
    for column, value in equals.items():
        rows = rows.filter(F.col(column) == value)
    rows = rows.orderBy(*order_by) if order_by else rows
    return rows.limit(limit) if limit else rows


def rows_of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in the table ``wanted``: one semi-join for any number of keys."""
    return rows.join(wanted.select(key), key, "left_semi")


def upsert(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``target`` with the rows of equal keys replaced by ``rows``."""
    return plain_unions(target).join(rows.select(*keys).distinct(), list(keys), "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def write_one_csv(df: DataFrame, path: str, order_by: list | None = None) -> None:
    """A small export as one CSV file with a header, also without rows."""
    (df.orderBy(*order_by) if order_by else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def leaderboard_rows(ratings: DataFrame, players: DataFrame) -> DataFrame:
    """Ranked export: unnamed ids go, order by rating, then id."""
    named = players.filter(F.coalesce(F.trim("full_name"), F.lit("")) != "").select(F.col("nba_player_id").alias("player_id"), F.col("full_name").alias("name"))
    return ratings.join(named, "player_id").orderBy(F.desc("total"), "player_id")


def build_meta(seasons: list[str], n_games: int, n_stints: int, penalty: float, replacement: float, points_per_win: float, fit_type: str) -> dict:
    """What an export was made from. Keys are fixed values; ``fit_type`` comes from whoever ran the fit."""
    return {
        "seasons_used": seasons, "n_games": n_games, "n_stints": n_stints, "lambda": penalty, "replacement_level": replacement, "points_per_win": points_per_win,
        "generated_at": datetime.now(UTC).isoformat(), "fit_type": fit_type, "projections_status": "not_built",
    }


def write_meta(path: str, meta: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(meta, f, indent=2)
        f.write("\n")
