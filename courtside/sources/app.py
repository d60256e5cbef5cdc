"""Readers of what the exports wrote, for an interactive front end: small files, read once for each modification time."""

from __future__ import annotations

import functools
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import to_contract_years
from ..operators.ratings import LEADERBOARD, PROJECTIONS
from .files import SEASONS, read_contract_csv

_NUMBERS = {"player_id": "long", "name": "string", "season": "string"}


def _schema(columns: list[str]) -> str:
    return ", ".join(f"{c} {_NUMBERS.get(c, 'double')}" for c in columns)


def _modified(path: str) -> float | None:
    """Of a file, or of the newest file in a folder; None if there is none."""
    if os.path.isdir(path):
        return max((os.stat(os.path.join(path, f)).st_mtime for f in os.listdir(path)), default=None)
    return os.stat(path).st_mtime if os.path.exists(path) else None


@functools.lru_cache(maxsize=16)
def _held(kind: str, spark: SparkSession, path: str, modified: float):
    if kind == "contracts":
        return to_contract_years(read_contract_csv(spark, path), SEASONS).cache()
    if kind == "meta":
        with open(path) as f:
            return json.load(f)
    return spark.read.csv(path, header=True, schema=_schema(LEADERBOARD if kind == "leaderboard" else PROJECTIONS)).cache()


def load_contract_years(spark: SparkSession, path: str) -> DataFrame:
    modified = _modified(path)
    if modified is None:
        raise FileNotFoundError(path)
    return _held("contracts", spark, path, modified)


def load_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Without a file, no rows."""
    modified = _modified(path)
    return spark.createDataFrame([], _schema(LEADERBOARD)) if modified is None else _held("leaderboard", spark, path, modified)


def load_projections(spark: SparkSession, path: str) -> DataFrame:
    """Without a file, no rows."""
    modified = _modified(path)
    return spark.createDataFrame([], _schema(PROJECTIONS)) if modified is None else _held("projections", spark, path, modified)


def load_meta(spark: SparkSession, path: str) -> dict:
    """Without a file, nothing."""
    modified = _modified(path)
    return {} if modified is None else _held("meta", spark, path, modified)


def teams_in(years: DataFrame, season: str) -> DataFrame:
    """The season's teams in order, each once."""
    return years.filter(F.col("season") == season).select("team_abbrev").distinct().orderBy("team_abbrev")


def search_names(rows: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Rows whose name holds the pattern, in either case; an empty pattern finds all."""
    return rows.filter(F.col(column).rlike("(?i)" + pattern)) if pattern else rows


def with_ratings(rows: DataFrame, leaderboard: DataFrame, column: str = "player") -> DataFrame:
    """Rows with the ratings of exactly that name, null where the leaderboard has none. Names are never guessed: of a
    name that two players share, the one further down the ranking stands."""
    values = [c for c in leaderboard.columns if c != "name"]
    last = F.max_by(F.struct(*values), F.struct(-F.col("total"), "player_id"))
    return rows.join(leaderboard.groupBy(F.col("name").alias(column)).agg(last.alias("_r")), column, "left").select(*rows.columns, "_r.*")
