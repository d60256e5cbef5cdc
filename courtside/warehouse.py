"""The warehouse as snapshot tables under one folder, which the cluster shares, and the chain from events to ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import lineups, possessions, ratings
from .schemas import TABLES
from .snapshots import SnapshotTable


class Warehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def table(self, name: str) -> SnapshotTable:
        """Dealt to buckets by the first key column, so that a game's rows are one bucket's."""
        return SnapshotTable(self.spark, self.path(name), TABLES[name][0][:1])

    def exists(self, name: str) -> bool:
        return self.table(name).exists()

    def read(self, name: str) -> DataFrame:
        """A table that was never written has no rows."""
        t = self.table(name)
        return t.read() if t.exists() else self.spark.createDataFrame([], TABLES[name][1])

    def shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns and types; columns that they lack are null."""
        columns = [c.split()[:2] for c in TABLES[name][1].split(", ")]
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.table(name).upsert(self.shaped(name, rows), *TABLES[name][0])

    def replace(self, name: str, rows: DataFrame) -> None:
        self.table(name).replace(self.shaped(name, rows))

    def counts(self) -> DataFrame:
        """(table_name, n_rows) of every table."""
        out = None
        for name in TABLES:
            one = self.read(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return out


def season_games(w: Warehouse, seasons: list[str], limit: int = 0) -> DataFrame:
    """Games of the seasons, the first ``limit`` of each by date (0: all)."""
    games = w.read("stg.game").filter(F.col("season").isin(seasons))
    place = F.row_number().over(Window.partitionBy("season").orderBy("game_date", "game_id"))
    return games.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n") if limit else games


class Gated:
    """Stints, gate and blocks of some games; each a plan, none run before it is used."""

    def __init__(self, w: Warehouse, games: DataFrame) -> None:
        self.games = games.select("game_id", "season")
        players = w.read("stg.player")
        self.names = players.select("nba_player_id", "full_name")
        self.events = w.read("stg.pbp_event").join(self.games, "game_id", "left_semi")
        self.box = w.read("stg.box_player").join(self.games, "game_id", "left_semi")
        self.stints = lineups.reconstruct_stints(self.events, players)
        both = self.events.select("game_id").distinct().intersect(self.box.select("game_id"))
        self.gate = lineups.minutes_gate(lineups.player_seconds(self.stints), self.box).join(both, "game_id", "left_semi")
        self.results = lineups.gate_results(self.gate, self.box, self.names)
        self.accounting = lineups.gate_accounting(self.results, self.games)
        self.blocks, self.left_out = possessions.warehouse_blocks(self.events, self.box, self.games, self.stints, self.results)

    def fit(self, min_possessions: float = ratings.MIN_POSSESSIONS, replacement: float = ratings.REPLACEMENT) -> tuple[DataFrame, dict]:
        blocks = self.blocks.filter(F.col("possessions") >= min_possessions)
        return ratings.fit_ratings(self.blocks.sparkSession, blocks, replacement=replacement)
