"""The client, backfill, warehouse, command line, streaming and projections, on a made-up league."""

import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.__main__ import main
from courtside.operators import aging, contracts, identity, lineups, possessions, ratings
from courtside.sources import app, client, files, synthetic
from courtside.streaming import ingest
from courtside.warehouse import Gated, Warehouse, season_games


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def a_client(folder, **k):
    c = Clock()
    return client.Client(client.ResponseCache(folder), client.RateLimiter(0.75, c, c.sleep), **k), c


def test_client(tmp_path):
    asked = []

    def scores(**params):
        asked.append(params)
        if len(asked) < 3:
            raise OSError("down")
        return {"resultSets": [{"rowSet": [[1]]}]}

    c, clock = a_client(tmp_path)
    first = c.fetch(scores, {"a": 1, "b": 2})
    assert len(asked) == 3 and clock.slept == [2, 4] and first["payload"]["resultSets"][0]["rowSet"] == [[1]]
    assert c.fetch(scores, {"b": 2, "a": 1}) == first and len(asked) == 3 and len(c.cache) == 1
    c.fetch(scores, {"a": 1, "b": 2}, force=True)
    c.fetch(scores, {"a": 2})
    assert len(asked) == 5 and clock.slept[2:] == [0.75, 0.75] and len(c.cache) == 2  # requests in a row are spaced
    path = next(tmp_path.glob("*/*.json"))
    path.write_text("{half")
    assert c.cache.get(path.stem) is None and not path.exists() and not list(tmp_path.glob("*/*.part"))

    def nothing(**params):
        return {"resultSet": {"rowSet": []}}

    with pytest.raises(RuntimeError) as e:
        c.fetch(nothing, {})
    assert isinstance(e.value.__cause__, client.EmptyResponse) and clock.slept[-5:] == [2, 4, 8, 16, 32]
    assert c.fetch(nothing, {}, allow_empty=True)["payload"] == {"resultSet": {"rowSet": []}}


@pytest.mark.parametrize(("payload", "empty"), [({}, True), ({"game": {}}, True), ({"game": {"x": 0}}, False), ({"resultSets": []}, True), ({"resultSets": [{"rowSet": []}, {"rowSet": [[0]]}]}, False), ({"resultSet": {"rowSet": None}}, True)])
def test_is_empty(payload, empty):
    assert client.is_empty(payload) == empty


@pytest.fixture(scope="module")
def league():
    return synthetic.League(n_games=12, seed=4)


@pytest.fixture(scope="module")
def source(league):
    m = types.ModuleType("a_league")
    for name in ("player_index", "game_index", "box_score"):
        setattr(m, name, lambda _n=name, **params: getattr(league, _n)(**params))
        getattr(m, name).__name__ = name

    def play_by_play(game_id):
        if game_id.endswith("7"):
            raise OSError("gone")
        return league.play_by_play(game_id)

    m.play_by_play = play_by_play
    sys.modules["a_league"] = m
    yield "a_league"
    del sys.modules["a_league"]


@pytest.fixture(scope="module")
def house(spark, league, source, tmp_path_factory):
    """A warehouse filled by the command line, from a source that lacks a few games."""
    root = tmp_path_factory.mktemp("house")
    base = ["--warehouse", str(root / "w"), "--cache", str(root / "c"), "--source", source]
    quick = client.RateLimiter(0, Clock(), lambda s: None)
    teams = root / "teams.json"
    teams.write_text(json.dumps([{"id": t, "abbreviation": f"T{t}", "nickname": "n", "city": "c", "full_name": f"Team {t}"} for t in league.teams]))
    from courtside import __main__ as m

    init = m.App.__init__

    def fast(self, spark_, args):
        init(self, spark_, args)
        self.client.limiter = quick

    m.App.__init__ = fast
    try:
        for command in (["ingest-teams", str(teams)], ["ingest-players"], ["ingest-games", "--season", league.season], ["ingest-pbp", "--season", league.season], ["ingest-box", "--season", league.season, "--limit", "10"]):
            main([*base, *command], spark)
    finally:
        m.App.__init__ = init
    return base, Warehouse(spark, str(root / "w"))


def test_backfill_and_gate(spark, league, house):
    _, w = house
    assert w.read("stg.team").count() == 4 and w.read("stg.player").count() == 32 and w.read("stg.game").count() == 12
    stored = {r.game_id for r in w.read("stg.pbp_event").select("game_id").distinct().collect()}
    lost = {g for g in league.games if g.endswith("7")}
    assert stored == set(league.games) - lost and lost
    g = Gated(w, season_games(w, [league.season]))
    assert g.gate.agg(F.max("error")).first()[0] == 0
    acc = {r.season: r for r in g.accounting.collect()}
    n_missing = len(lost | set(sorted(league.games, key=lambda x: (int(x) % 100000 % 28, x))[10:]))
    assert (acc[None].n_games, acc[None].n_missing, acc[None].n_included) == (12, n_missing, 12 - n_missing)
    assert {r.reason for r in g.left_out.collect()} == {"missing"}
    b = g.blocks.select(F.size("offense"), F.size("defense")).distinct().collect()
    assert [tuple(x) for x in b] == [(5, 5)]
    assert season_games(w, [league.season], 5).count() == 5


def test_ratings_recover_what_was_planted(spark):
    big = synthetic.League(n_games=36, seed=9)
    pbp = spark.createDataFrame([(g, json.dumps(big.play_by_play(g))) for g in big.games], "game_id string, payload string")
    box = files.box_players(spark.createDataFrame([(g, json.dumps(big.box_score(g))) for g in big.games], "game_id string, payload string"), "payload").cache()
    events = identity.pbp_events(files.pbp_actions(pbp, "payload")).cache()
    stints = lineups.reconstruct_stints(events).cache()
    blocks = possessions.offense_blocks(events, stints, box)
    assert stints.count() == 36 * 16 and blocks.count() == 36 * 32
    r, _ = ratings.fit_ratings(spark, blocks, fixed=500.0)
    got = {x.player_id: x for x in r.collect()}
    ids = sorted(got)
    assert np.corrcoef([got[i].offense for i in ids], [big.offense[i] for i in ids])[0, 1] > 0.6
    assert np.corrcoef([got[i].defense for i in ids], [big.defense[i] for i in ids])[0, 1] > 0.6


def test_bad_box_scores_are_gated(spark):
    off = synthetic.League(n_games=6, noise=400, seed=1)
    events = identity.pbp_events(files.pbp_actions(spark.createDataFrame([(g, json.dumps(off.play_by_play(g))) for g in off.games], "game_id string, payload string"), "payload"))
    box = files.box_players(spark.createDataFrame([(g, json.dumps(off.box_score(g))) for g in off.games], "game_id string, payload string"), "payload")
    gate = lineups.minutes_gate(lineups.player_seconds(lineups.reconstruct_stints(events)), box)
    names = spark.createDataFrame([(p, off.name(p)) for t in off.teams.values() for p in t], "nba_player_id long, full_name string")
    r = {x.game_id: x for x in lineups.gate_results(gate, box, names).collect()}
    assert {g for g, x in r.items() if not x.passed} == {g for g in off.games if int(g) % 2}
    assert {x.category for x in r.values() if not x.passed} == {"isolated"}
    worst = lineups.gate_offenders(gate).collect()
    assert len(worst) == 3 and all(x.place == 1 and x.error == 400 and x.player_id == r[x.game_id].worst_player for x in worst)


def test_commands(spark, league, house, tmp_path, capsys):
    base, w = house
    main([*base, "status"], spark)
    main([*base, "fit-rapm", "--season", league.season, "--limit", "2", "--top", "3"], spark)
    main([*base, "audit-phantom-ids", "--season", league.season, "--limit", "2"], spark)
    main([*base, "check-minutes", "--season", league.season, "--limit", "2"], spark)
    main([*base, "export-app-data", "--season", league.season, "--out-dir", str(tmp_path / "out")], spark)
    said = capsys.readouterr().out
    assert "cached responses" in said and "top 3 by total" in said and "pooled ridge" in said
    board = app.load_leaderboard(spark, str(tmp_path / "out/rapm_leaderboard.csv"))
    assert board.columns == ratings.LEADERBOARD and 0 < board.count() <= 32
    assert app.load_projections(spark, str(tmp_path / "out/projections.csv")).count() == 0
    assert app.load_meta(spark, str(tmp_path / "out/meta.json"))["seasons_used"] == [league.season]
    assert app.load_meta(spark, str(tmp_path / "none")) == {} and app.load_leaderboard(spark, str(tmp_path / "none")).count() == 0
    found = app.search_names(board, "^GIVEN10")
    assert found.count() == board.filter(F.col("name").startswith("Given10")).count() > 0
    first = board.first()
    j = app.with_ratings(spark.createDataFrame([(first["name"],), ("Nobody",)], "player string"), board).collect()
    assert {r.player: r.total for r in j} == {first["name"]: first.total, "Nobody": None}


CSV = """,,,Salary,Salary,Salary,Salary,Salary,Salary,,
Rk,Player,Tm,2026-27,2027-28,2028-29,2029-30,2030-31,2031-32,Guaranteed,-9999
1,Ann Able,BRK,"$30,000,000","$31,000,000",,,,,"$61,000,000",ableann01
2,Bob Best,PHO,"$20,000,000",,,,,,"$20,000,000",bestbob01
3,Cy Cole,PHO,"$9,000,000","$9,500,000",,,,,"$12,000,000",colecy01
4,Di Dunn,CHO,"$5,000,000",,,,,,,dunndi01
4,Di Dunn,CHO,"$5,000,000",,,,,,,dunndi01
5,Ed Eads,CHO,"$2,000,000",,,,,,"$2,000,000",eadsed01
6,Ed Eads,UTA,"$1,000,000",,,,,,"$1,000,000",eadsed01
"""


@pytest.fixture
def sheet(tmp_path):
    p = tmp_path / "contracts.csv"
    p.write_text(CSV)
    return str(p)


def test_contracts_of_a_small_export(spark, sheet):
    raw = files.read_contract_csv(spark, sheet)
    assert raw.count() == 7 and {r.team_abbrev for r in raw.collect()} == {"BKN", "PHX", "CHA", "UTA"}
    years = app.load_contract_years(spark, sheet)
    got = {(r.bbref_slug, r.team_abbrev, r.season): r for r in years.collect()}
    assert len(got) == years.count() == 8
    assert got["ableann01", "BKN", "2027-28"].guaranteed == 31_000_000 and not got["ableann01", "BKN", "2026-27"].needs_review
    assert got["colecy01", "PHX", "2026-27"].review_reason == "partial_guarantee" and got["dunndi01", "CHA", "2026-27"].guaranteed == 0
    assert {r.review_reason for k, r in got.items() if k[0] == "eadsed01"} == {"multi_team_dead_money"}
    known = spark.createDataFrame([("BKN",), ("PHX",), ("CHA",)], "team_abbrev string")
    report = contracts.quality_report(raw, known, files.SEASONS)
    assert report.first().asDict() == {"n_rows": 7, "n_unique": 6, "n_partial": 1, "n_blank": 1, "n_unknown_teams": 1, "n_multi_team": 1, "n_duplicates": 1}
    assert [r.team_abbrev for r in contracts.unknown_teams(raw, known).collect()] == ["UTA"] and len(contracts.blocking_issues(report)) == 3
    assert [r.team_abbrev for r in app.teams_in(years, "2026-27").collect()] == ["BKN", "CHA", "PHX", "UTA"]
    with pytest.raises(FileNotFoundError):
        app.load_contract_years(spark, sheet + ".none")


def test_contract_commands(spark, house, sheet, tmp_path, capsys):
    base, _ = house
    main([*base, "ingest-contracts", sheet], spark)
    main([*base, "check-trade", sheet, "--send", "ableann01", "--receive", "bestbob01"], spark)
    main([*base, "sign", sheet, "--player", "New Guy", "--team", "PHX", "--cap-hit", "4000000"], spark)
    main([*base, "waive", sheet, "--slug", "bestbob01", "--team", "PHX", "--stretch"], spark)
    said = capsys.readouterr().out
    assert "OVERALL: INDETERMINATE" in said and "New Guy" in said and "4,000,000" in said
    steps = tmp_path / "steps.yaml"
    steps.write_text("- trade: {legs: [{slug: ableann01, to_team: PHX}]}\n- waive: {slug: nobody, team: PHX}\n")
    main([*base, "apply-overrides", sheet, str(steps), "--team", "PHX"], spark)
    said = capsys.readouterr().out
    assert "applied 2 transactions" in said and "nobody" in said and "Ann Able" in said
    with pytest.raises(SystemExit):
        main([*base, "check-trade", sheet, "--send", "x", "--receive", "bestbob01"], spark)


def test_crosswalk_command(spark, house, tmp_path, capsys):
    base, w = house
    p = tmp_path / "c.csv"
    p.write_text(CSV.replace("Ann Able", "Given1001 Family1001").replace("Bob Best", "Given1002 Famly1002"))
    o = tmp_path / "o.yaml"
    o.write_text("1003:\n  bbref_slug: forced01\n  spotrac_slug: forced-one\n")
    main([*base, "build-xwalk", "--contracts", str(p), "--overrides", str(o)], spark)
    got = {r.nba_player_id: r for r in w.read("stg.player_xwalk").collect()}
    assert len(got) == 32 and got[1001].bbref_slug == "ableann01" and got[1001].match_method == "exact"
    assert got[1002].bbref_slug == "bestbob01" and got[1003].match_method == "manual" and got[1003].spotrac_slug == "forced-one"
    assert "unresolved: 31" in capsys.readouterr().out
    assert files.read_overrides(spark, str(tmp_path / "none")).count() == 0


def test_replace_and_upsert(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "nba_team_id long, abbreviation string")
    w.upsert("stg.team", rows)
    w.upsert("stg.team", rows.filter("nba_team_id = 2").withColumn("abbreviation", F.lit("c")))
    assert {(r.nba_team_id, r.abbreviation) for r in w.read("stg.team").collect()} == {(1, "a"), (2, "c")}
    w.replace("stg.team", rows.limit(0))
    assert w.read("stg.team").count() == 0 and {r.n_rows for r in w.counts().collect()} == {0}


def test_streaming(spark, league, tmp_path):
    c, _ = a_client(tmp_path / "cache")
    w = Warehouse(spark, str(tmp_path / "w"))
    games = list(league.games)[:3]
    parse = lambda batch: files.box_players(batch, "payload")

    def box_score(game_id):
        return league.box_score(game_id)

    def run():
        ingest.upsert_stream(ingest.response_stream(spark, str(tmp_path / "cache"), "box_score"), w, "stg.box_player", parse, str(tmp_path / "cp")).awaitTermination(120)

    for g in games[:2]:
        c.fetch(box_score, {"game_id": g})
    run()
    assert w.read("stg.box_player").select("game_id").distinct().count() == 2
    c.fetch(box_score, {"game_id": games[2]})
    run()
    run()
    assert {r.game_id for r in w.read("stg.box_player").select("game_id").distinct().collect()} == set(games)
    assert client.cached_payloads(spark, c.cache, "box_score").count() == 3


def test_box_score_projection(spark):
    seasons, truth, box = synthetic.aging_panel(spark, {"F": 0.6, "G": -0.4}, n_players=30, level_of_box=3.0, drop=0.2, seed=2)
    final, first, model, n = aging.fit_box_score_projection(seasons, box, "rating", "weight", ["score"], anchor=25, warmup=60, samples=60)
    assert n == 30 and abs(model["beta"][0] / model["sd"][0] - 3.0) < 0.4
    cov = aging.coverage(final.join(seasons.select("player_id", "age"), ["player_id", "age"], "left_semi"), truth.join(seasons.select("player_id", "age"), ["player_id", "age"], "left_semi")).first()
    assert cov.n == seasons.count() and cov.coverage > 0.6
    few = seasons.filter("player_id < 2")
    *_, model, n = aging.fit_box_score_projection(few, box, "rating", "weight", ["score"], anchor=25, warmup=5, samples=5)
    assert n == 2 and model["beta"] == [0.0] and model["note"]


def test_folds_and_ranks(spark):
    d = spark.createDataFrame([(f"g{i}", 1.0, 1.0) for i in range(200) for _ in range(i % 7 + 1)], "game_id string, y double, w double")
    folds = ratings.balanced_folds(d)
    got = ratings.with_folds(d, folds).groupBy("game_id").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("f"), F.count("*").alias("rows")).collect()
    assert len(got) == 200 and all(r.n == 1 for r in got)
    load = [sum(r.rows for r in got if r.f == f) for f in range(5)]
    assert max(load) - min(load) <= 14 and len(folds) == ratings.BUCKETS
    rng = np.random.default_rng(0)
    v = [(i, float(x)) for i, x in enumerate(rng.integers(0, 50, 3000))] + [(9999, None)]
    df = spark.createDataFrame(v, "id long, v double")
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(v, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])))}
    assert {r.id: r["rank"] for r in ratings.ranked(df, "v", "id").collect()} == want
    assert ratings.ranked(df.limit(0), "v", "id").count() == 0


def test_names_by_letter_pairs(spark):
    """The prefix filter loses no match: against all pairs."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcde "), rng.integers(2, 15))).strip() or "a" for _ in range(120)]

    def edit(s):
        s = list(s)
        for _ in range(rng.integers(0, 3)):
            k = int(rng.integers(0, len(s) + 1))
            s[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abcde"), rng.integers(0, 2)))
        return "".join(s).strip() or "b"

    norm = lambda s: " ".join(s.split())
    targets = [(i, edit(s)) for i, s in enumerate(base)]
    others = sorted({norm(s): f"s{i}" for i, s in enumerate(base)}.items())
    got = {r.id: r.score for r in identity.match_names(spark.createDataFrame(targets, "id long, full_name string"), spark.createDataFrame(others, "full_name string, slug string")).collect()}
    for i, s in targets:
        best = max(1.0 if norm(s) == o else SequenceMatcher(None, norm(s), o).ratio() for o, _ in others)
        assert abs(got.get(i, 0) - (best if best >= identity.CANDIDATE else 0)) < 1e-9, (s, best, got.get(i))
