"""``python -m courtside COMMAND``: the commands over a warehouse folder and a cache of responses.

Responses come from the cache; ``--source MODULE`` names a module whose functions (``player_index``, ``game_index``,
``play_by_play``, ``box_score``) fetch what is not cached.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contracts, identity, lineups, overlay, ratings, trade
from .session import get_session
from .sources import client, files
from .warehouse import Gated, Warehouse, season_games

SEASON = "2026-27"
KINDS = ("Regular Season", "Playoffs")


def _show(title: str, rows: DataFrame, limit: int = 100) -> None:
    """Prints a small report."""
    print(f"\n{title}")
    print("  " + " | ".join(rows.columns))
    for r in rows.limit(limit).collect():
        print("  " + " | ".join(f"{x:,.2f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x) for x in r))


class App:
    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args, self.warehouse = spark, args, Warehouse(spark, args.warehouse)
        self.client = client.Client(client.ResponseCache(args.cache))

    def endpoint(self, name: str) -> Callable[..., dict]:
        if self.args.source:
            return getattr(importlib.import_module(self.args.source), name)

        def missing(**params) -> dict:
            raise LookupError(f"{name} {params} is not cached and no --source is given")

        missing.__name__ = name
        return missing

    def fetched(self, name: str, params: dict, allow_empty: bool = False) -> DataFrame:
        payload = self.client.fetch(self.endpoint(name), params, allow_empty=allow_empty)["payload"]
        return self.spark.createDataFrame([(json.dumps(payload),)], "payload string")

    def tabular(self, name: str, params: dict, columns: list[str], allow_empty: bool = False) -> DataFrame:
        rows = files.result_rows(self.fetched(name, params, allow_empty), "payload")
        return rows.select(*(F.col("fields")[c].alias(c) for c in columns))

    # ingest

    def status(self) -> None:
        _show(f"warehouse {self.warehouse.root}", self.warehouse.counts())
        print(f"cached responses: {len(self.client.cache):,}")

    def ingest_teams(self) -> None:
        with open(self.args.teams) as f:
            rows = files.teams_from_list(self.spark, json.load(f))
        self.warehouse.upsert("stg.team", rows)
        print(f"teams: {rows.count():,}")

    def ingest_players(self) -> None:
        rows = files.players_from_rows(self.tabular("player_index", {}, ["person_id", "display_first_last", "from_year", "to_year", "rosterstatus"]))
        self.warehouse.upsert("stg.player", rows)
        print(f"players: {self.warehouse.read('stg.player').count():,}")

    def ingest_games(self) -> None:
        for kind in KINDS if self.args.playoffs else KINDS[:1]:
            rows = self.tabular("game_index", {"season": self.args.season, "season_type": kind}, ["game_id", "game_date", "matchup", "team_id", "pts"], kind != KINDS[0])
            rows = rows.select("game_id", F.lit(self.args.season).alias("season"), F.to_date("game_date").alias("game_date"), "matchup", F.col("team_id").cast("long").alias("team_id"), F.col("pts").cast("short").alias("pts"))
            self.warehouse.upsert("stg.game", files.games_from_team_rows(rows).withColumn("season_type", F.lit(kind)))
        print(f"games of {self.args.season}: {season_games(self.warehouse, [self.args.season]).count():,}")

    def _backfill(self, table: str, endpoint: str, parse: Callable[[DataFrame], DataFrame]) -> None:
        games = [r.game_id for r in files.rows_where(self.warehouse.read("stg.game"), ["game_date", "game_id"], self.args.limit, season=self.args.season).select("game_id").collect()]
        shaped = lambda payloads: self.warehouse.shaped(table, parse(payloads))
        keys = {"stg.pbp_event": ("game_id",), "stg.box_player": ("game_id",)}[table]
        n, failed = client.backfill(self.spark, self.client, self.endpoint(endpoint), games, shaped, self.warehouse.table(table), keys, progress=lambda done, bad: print(f"{done:,} of {len(games):,} games, {bad:,} failed", file=sys.stderr))
        print(f"{table}: {n:,} games stored, {len(failed):,} left out")
        for game, error in failed:
            print(f"  {game}: {error}")

    def ingest_pbp(self) -> None:
        self._backfill("stg.pbp_event", "play_by_play", lambda p: identity.pbp_events(files.pbp_actions(p, "payload")))

    def ingest_box(self) -> None:
        self._backfill("stg.box_player", "box_score", lambda p: files.box_players(p, "payload"))

    # contracts

    def _years(self) -> DataFrame:
        return contracts.to_contract_years(files.read_contract_csv(self.spark, self.args.contracts), files.SEASONS)

    def ingest_contracts(self) -> None:
        raw, years = files.read_contract_csv(self.spark, self.args.contracts), self._years()
        teams = self.warehouse.read("stg.team").select(F.col("abbreviation").alias("team_abbrev"))
        report = contracts.quality_report(raw, raw.select("team_abbrev") if teams.isEmpty() else teams, files.SEASONS)
        _show("contract data", report)
        for issue in contracts.blocking_issues(report):
            print(f"! {issue}")
        pay = contracts.team_payroll(years, self.args.season)
        _show(f"payroll {self.args.season}", pay)
        print(f"{years.count():,} contract-years, {years.filter('needs_review').count():,} to review, on {pay.filter('n_review > 0').count():,} teams")

    def build_xwalk(self) -> None:
        seed = contracts.crosswalk_seed(files.read_contract_csv(self.spark, self.args.contracts)).select(F.col("player").alias("full_name"), F.col("bbref_slug").alias("slug")) if self.args.contracts else self.spark.createDataFrame([], "full_name string, slug string")
        players = self.warehouse.read("stg.player")
        forced = files.read_overrides(self.spark, self.args.overrides) if self.args.overrides else None
        self.warehouse.replace("stg.player_xwalk", identity.build_crosswalk(players, seed, None, forced).withColumn("resolved_at", F.to_utc_timestamp(F.current_timestamp(), "UTC").cast("timestamp_ntz")))
        built = self.warehouse.read("stg.player_xwalk")
        print(f"crosswalk rows: {built.count():,}")
        print(f"unresolved: {identity.unresolved(players, built).count():,}")

    def check_trade(self) -> None:
        year = trade.LEAGUE_YEARS[self.args.season]
        years = self._years().filter(F.col("season") == self.args.season)
        slugs = [self.args.send, self.args.receive]
        held = {r.bbref_slug: r for r in years.filter(F.col("bbref_slug").isin(slugs)).collect()}
        if lost := [s for s in slugs if s not in held]:
            raise SystemExit(f"{', '.join(lost)}: not found for {self.args.season}")
        a, b = (held[s] for s in slugs)
        pieces = self.spark.createDataFrame([("trade", x.team_abbrev, y.team_abbrev, x.cap_hit, 0) for x, y in ((a, b), (b, a))], "trade_id string, from_team string, to_team string, cap_hit long, incentives_likely long")
        verdicts = trade.trade_verdicts(pieces, trade.cap_sheets(years, self.args.season), year)
        print(f"{a.player} ({a.team_abbrev}, ${a.cap_hit:,}) <--> {b.player} ({b.team_abbrev}, ${b.cap_hit:,})")
        print(f"OVERALL: {trade.trade_rollup(verdicts).first().severity}")
        for v in verdicts.orderBy("team").collect():
            print(f"{v.team}: {v.severity} [{v.band}]\n  {v.reason}\n  rule: {v.rule}" + (f"\n  caveat: {v.caveat}" if v.caveat else ""))

    def _apply(self, steps: DataFrame, teams: list[str] | None) -> None:
        year = trade.LEAGUE_YEARS[self.args.season]
        after, warnings = overlay.apply_transactions(self._years(), steps, self.args.season)
        after = after.cache()
        print(f"applied {steps.select('seq').distinct().count():,} transactions")
        for r in warnings.collect():
            print(f"! {r.warning}")
        sheets = trade.roster_report(trade.cap_sheets(after, self.args.season), year)
        _show("teams", (sheets.filter(F.col("team").isin(teams)) if teams else sheets.filter(F.col("apron_payroll") > year["first_apron"])).orderBy("team"))
        for team in teams or []:
            _show(team, after.filter(F.col("team_abbrev") == team).orderBy(F.desc("cap_hit"), "player").select("player", "cap_hit", "guaranteed", "needs_review"))

    def _step(self, **values) -> DataFrame:
        names = [c.split()[0] for c in overlay.STEP.split(", ")]
        base = {"seq": 0, "leg": 0, "note": self.args.note}
        return self.spark.createDataFrame([tuple((base | values).get(c) for c in names)], overlay.STEP)

    def sign(self) -> None:
        a = self.args
        sure = a.cap_hit if a.guaranteed is None else a.guaranteed
        self._apply(self._step(kind="sign", bbref_slug=a.slug or overlay.new_slug(a.player), player=a.player, team=a.team, cap_hit=a.cap_hit, guaranteed=sure), [a.team])

    def waive(self) -> None:
        self._apply(self._step(kind="waive", bbref_slug=self.args.slug, team=self.args.team, dead_money=self.args.stretch), [self.args.team])

    def apply_overrides(self) -> None:
        self._apply(overlay.load_transactions(self.spark, self.args.overlay), [self.args.team] if self.args.team else None)

    # ratings

    def _seasons(self) -> list[str]:
        return [s.strip() for s in self.args.seasons.split(",")] if getattr(self.args, "seasons", None) else [self.args.season]

    def _gated(self) -> Gated:
        g = Gated(self.warehouse, season_games(self.warehouse, self._seasons(), getattr(self.args, "limit", 0)))
        _show("minutes gate (the last row: pooled)", g.accounting.orderBy(F.asc_nulls_last("season")))
        return g

    def _named(self, r: DataFrame) -> DataFrame:
        names = self.warehouse.read("stg.player").select(F.col("nba_player_id").alias("player_id"), F.col("full_name").alias("name"))
        return r.join(names, "player_id", "left").withColumn("name", F.coalesce("name", F.col("player_id").cast("string")))

    def fit_rapm(self) -> None:
        g = self._gated()
        r, facts = g.fit(self.args.min_possessions, self.args.replacement_level)
        r = self._named(r).cache()
        print(f"lambda {facts['lambda']}, intercept {facts['intercept']:.1f}")
        for column in ("total", "value", "offense", "defense"):
            _show(f"top {self.args.top} by {column}", r.orderBy(F.desc(column), "player_id").select("name", "total", "offense", "defense", "value", "wins_added", "possessions"), self.args.top)

    def export_app_data(self) -> None:
        g = self._gated()
        r, facts = g.fit(replacement=self.args.replacement_level)
        players = self.warehouse.read("stg.player")
        files.write_one_csv(files.leaderboard_rows(r, players).select(*ratings.LEADERBOARD), f"{self.args.out_dir}/rapm_leaderboard.csv", [F.desc("total"), "player_id"])
        files.write_one_csv(self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ratings.PROJECTIONS)), f"{self.args.out_dir}/projections.csv")
        good = g.results.filter("passed").select("game_id")
        meta = files.build_meta(self._seasons(), good.count(), g.stints.join(good, "game_id", "left_semi").count(), facts["lambda"], self.args.replacement_level, ratings.POINTS_PER_WIN, "pooled ridge")
        files.write_meta(f"{self.args.out_dir}/meta.json", meta)
        print(json.dumps(meta, indent=2))

    def audit_phantom_ids(self) -> None:
        games = season_games(self.warehouse, self._seasons(), self.args.limit)
        found = lineups.phantom_audit(files.rows_of(self.warehouse.read("stg.pbp_event"), "game_id", games), self.warehouse.read("stg.player"))
        _show("ids in player slots that are no players", found)

    def check_minutes(self) -> None:
        g = Gated(self.warehouse, season_games(self.warehouse, self._seasons(), self.args.limit))
        _show("games", g.results.orderBy("passed", F.desc("max_error")))
        names = g.names.withColumnRenamed("nba_player_id", "player_id")
        _show("offenders", lineups.gate_offenders(g.gate).join(names, "player_id", "left").orderBy("game_id", "place"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="courtside", description=__doc__)
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--cache", default="cache")
    p.add_argument("--source")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flags, kwargs in options:
            c.add_argument(*flags.split(), **kwargs)

    season, contracts_file = ("--season", {"default": SEASON}), ("contracts", {})
    limit = ("--limit", {"type": int, "default": 0})
    level = ("--replacement-level", {"type": float, "default": ratings.REPLACEMENT})
    seasons, note = ("--seasons", {}), ("--note", {"default": ""})
    command("status")
    command("ingest-teams", ("teams", {}))
    command("ingest-players")
    command("ingest-games", season, ("--playoffs", {"action": argparse.BooleanOptionalAction, "default": True}))
    command("ingest-pbp", season, limit)
    command("ingest-box", season, limit)
    command("ingest-contracts", contracts_file, season)
    command("build-xwalk", ("--contracts", {}), ("--overrides", {}))
    command("check-trade", contracts_file, ("--send", {"required": True}), ("--receive", {"required": True}), season)
    command("sign", contracts_file, ("--player", {"required": True}), ("--team", {"required": True}), ("--cap-hit", {"type": int, "required": True}), ("--slug", {}), ("--guaranteed", {"type": int}), season, note)
    command("waive", contracts_file, ("--slug", {"required": True}), ("--team", {"required": True}), ("--stretch", {"action": "store_true"}), season, note)
    command("apply-overrides", contracts_file, ("overlay", {}), season, ("--team", {}))
    command("fit-rapm", season, seasons, limit, ("--min-possessions", {"type": float, "default": ratings.MIN_POSSESSIONS}), ("--top", {"type": int, "default": 25}), level)
    command("export-app-data", season, seasons, level, ("--out-dir", {"default": "app/data"}))
    command("audit-phantom-ids", season, limit)
    command("check-minutes", season, limit)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    app = App(spark or get_session(), args)
    getattr(app, args.command.replace("-", "_"))()


if __name__ == "__main__":
    main()
