"""Contracts, overlay, lineups, ratings and the catalogue against SQL."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import aging, identity, lineups, overlay, possessions, ratings
from courtside.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _base(spark):
    rows = [("1", "s", "aaa", "A", "LAL", 1, 30_000_000, 30_000_000, True, None, False, None), ("2", "s", "bbb", "B", "MEM", 1, 5_000_000, 0, False, None, False, None), ("3", "s", "ccc", "C", "MEM", 1, 8_000_000, 8_000_000, True, None, False, None)]
    return spark.createDataFrame(rows, overlay.CONTRACT_YEAR)


def test_overlay(spark, tmp_path):
    p = tmp_path / "t.yaml"
    p.write_text("- sign: {player: New Guy, team: LAL, cap_hit: 5, guaranteed: 1}\n- waive: {slug: ccc, team: BOS, stretch_dead_money: true}\n- trade: {legs: [{slug: aaa, to_team: MEM}, {slug: zzz, to_team: LAL}]}\n- amend: {slug: bbb, field: cap_hit, value: 7}\n")
    frame, warn = overlay.apply_transactions(_base(spark), overlay.load_transactions(spark, str(p)), "s")
    got = {r.bbref_slug: r for r in frame.collect()}
    assert got["__new__new_guy"].cap_hit == 5 and not got["__new__new_guy"].is_guaranteed and got["__new__new_guy"].contract_id == "override:New Guy"
    assert got["ccc"].review_reason == "waived_dead_money" and got["ccc"].contract_id == "dead:ccc"
    assert got["aaa"].team_abbrev == "MEM" and got["bbb"].cap_hit == 7
    assert [r.warning for r in warn.collect()] == ["ccc is waived by BOS but held by MEM, whose row goes", "no row of zzz to trade"]
    p.write_text("- nonsense: {}\n")
    with pytest.raises(ValueError):
        overlay.load_transactions(spark, str(p))


def _events(spark, rows):
    return spark.createDataFrame(rows, "game_id string, event_num int, period short, clock_seconds_left double, event_type string, event_action_type string, description string, team_id long, player1_id long, player2_id long, player3_id long")


def test_stint_golden(spark):
    rows = [("g", 1, 1, 715.0, "Shot", None, "", 1, 1, None, None), ("g", 2, 1, 714.0, "Shot", None, "", 1, 2, None, None), ("g", 4, 1, 650.0, "Substitution", None, "", 1, 2, 4, None), ("g", 3, 1, 600.0, "Substitution", None, "", 1, 1, 3, None)]
    s = {r.player_id: r.seconds for r in lineups.player_seconds(lineups.reconstruct_stints(_events(spark, rows))).collect()}
    assert s == {1: 120.0, 2: 70.0, 4: 650.0, 3: 600.0}


def test_possessions(spark):
    n = spark.createDataFrame([(80, 9, 13, 20), (0, 0, 0, 3), (1, 1, 0, 0)], "fga long, oreb long, tov long, fta long")
    got = [r.p for r in n.select(possessions.possessions(*map(F.col, n.columns)).alias("p")).collect()]
    assert all(map(math.isclose, got, [92.8, 1.32, 0.0]))


def test_sub_resolution(spark):
    rows = [("g", 1, 0, "Shot", None, 7, 11, "Jokić", True), ("g", 2, 1, "Substitution", "SUB: C. Braun FOR Jokic", 7, 11, "Jokić", True), ("g", 3, 2, "Shot", None, 7, 12, "Braun", True)]
    a = spark.createDataFrame(rows, "game_id string, event_num int, pos int, event_type string, description string, team_id long, person_id long, player_name string, reliable boolean")
    assert identity.resolve_incoming(a).first().player2_id == 12


def _league(n_players=24, games=60, seed=3):
    rng = np.random.default_rng(seed)
    off, de = rng.normal(0, 3, n_players), rng.normal(0, 3, n_players)
    rows = []
    for g in range(games):
        for _ in range(20):
            p = rng.permutation(n_players)[:10]
            w = float(rng.integers(5, 15))
            y = 110 + off[p[:5]].sum() - de[p[5:]].sum() + rng.normal(0, 8)
            rows.append((f"g{g}", [int(x) for x in p[:5]], [int(x) for x in p[5:]], float(y * w / 100), w))
    return rows, off, de


def test_ridge_matches_closed_form_and_recovers(spark):
    rows, off, de = _league()
    blocks = spark.createDataFrame(rows, "game_id string, offense array<long>, defense array<long>, points double, possessions double")
    r, facts = ratings.fit_ratings(spark, blocks, fixed=100.0)
    got = {x.player_id: x for x in r.collect()}
    n = len(off)
    x, y, w = np.zeros((len(rows), 2 * n)), np.zeros(len(rows)), np.zeros(len(rows))
    for i, (_, o, d, pts, poss) in enumerate(rows):
        x[i, [2 * p for p in o]], x[i, [2 * p + 1 for p in d]], y[i], w[i] = 1, -1, 100 * pts / poss, poss
    xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
    beta = np.linalg.solve(xc.T @ (w[:, None] * xc) + 100 * np.eye(2 * n), xc.T @ (w * yc))
    assert max(abs(got[p].offense - beta[2 * p]) for p in range(n)) < 1e-8
    assert np.corrcoef([got[p].offense for p in range(n)], off)[0, 1] > 0.95
    zero, _ = ratings.fit_ratings(spark, blocks, fixed=100.0, prior={})
    assert max(abs(a.total - got[a.player_id].total) for a in zero.collect()) < 1e-8
    _, cv = ratings.fit_ratings(spark, blocks)
    assert cv["lambda"] in ratings.LAMBDAS and cv["n_folds"] == 5


def test_delta_curve(spark):
    rows = [(p, str(a), a, p + 0.5 * a - 0.01 * a * a, 100.0) for p in range(5) for a in range(20, 30) if (p, a) != (0, 25)]
    s = spark.createDataFrame(rows, "player_id long, season string, age int, r double, w double")
    d = aging.player_deltas(s, "r", "w")
    assert d.filter("player_id = 0").count() == 7
    c = {r.age: r.value for r in aging.cumulative_curve(aging.league_delta_curve(d), 24).collect()}
    f = lambda a: 0.5 * a - 0.01 * a * a
    assert set(c) == set(range(20, 30)) and all(abs(c[a] - (f(a) - f(24))) < 1e-9 for a in c)


def test_hierarchy_converges(spark):
    rng = np.random.default_rng(1)
    rows = [(p, str(a), "GF"[p % 2], a, float(2 + (0.8 if p % 2 else -0.3) * (a - 24) + rng.normal(0, 0.5)), 2000.0) for p in range(20) for a in range(22, 28)]
    s = spark.createDataFrame(rows, "player_id long, season string, position_group string, age int, r double, w double")
    m = aging.fit_hierarchy(s, "r", "w", anchor=24, warmup=150, samples=150).cache()
    pos = {(r.position, r.age): r.mean for r in aging.posterior_summary(m.filter("site = 'position'"), "position", "age").collect()}
    assert abs(np.mean([pos[("F", a)] for a in range(22, 27)]) - 0.8) < 0.3 and abs(np.mean([pos[("G", a)] for a in range(22, 27)]) + 0.3) < 0.3
    assert aging.split_r_hat(m.filter("site = 'league'"), "age").agg(F.max("r_hat")).first()[0] < 1.2
    proj = aging.project_players(m, m, s.select("player_id").distinct().withColumn("age", F.lit(25)))
    assert {r.age for r in proj.select("age").distinct().collect()} == {26, 27}


def test_empty_blocks(spark):
    with pytest.raises(ValueError):
        ratings.fit_ratings(spark, spark.createDataFrame([], "game_id string, offense array<long>, defense array<long>, points double, possessions double"))


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_catalogue(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert possessions and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_crosswalk_query_meets_all_customers(spark):
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    got = {r.nba_player_id: (r.bbref_slug, r.match_method) for r in QUERIES["q38_crosswalk"](spark, SF).collect()}
    assert got and all(got[i] == (str(i), "exact") for i in got if i <= n)


def test_crosswalk_fuzzy_path(spark):
    players = spark.createDataFrame([(1, "Jonathan Williamsonn"), (2, "Peter Pan"), (3, "Zed Quux")], "nba_player_id long, full_name string")
    other = spark.createDataFrame([("Jonathan Williamson", "a"), ("Jonathan Willis", "b"), ("Peter Pan", "c")], "full_name string, slug string")
    got = {r.nba_player_id: (r.bbref_slug, r.match_method) for r in identity.build_crosswalk(players, other, None, None).collect()}
    assert got == {1: ("a", "fuzzy"), 2: ("c", "exact"), 3: (None, "fuzzy")}


def test_projection_query_draws_in_full(spark, monkeypatch):
    asked = []
    whole = aging.fit_hierarchy
    monkeypatch.setattr(aging, "fit_hierarchy", lambda *a, **k: asked.append(k) or whole(*a, **(k | {"warmup": 5, "samples": 5})))
    assert QUERIES["q34_projection"](spark, SF).count() > 0
    assert len(asked) == 2 and not any({"warmup", "samples"} & set(k) for k in asked)
