"""Renamed slugs, the sweep over stints, overtime, null event numbers, and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import lineups, overlay, possessions, posterior
from courtside.schemas import CONTRACT_YEAR

EVENT = "game_id string, event_num int, period short, clock_seconds_left double, event_type string, event_action_type string, description string, team_id long, player1_id long, player2_id long, player3_id long"


def years(spark, *slugs):
    return spark.createDataFrame([(f"c-{s}", "s", s, s.upper(), "LAL", 1, 100 + k, 50, False, None, False, None) for k, s in enumerate(slugs)], CONTRACT_YEAR)


def steps(spark, *rows):
    names = [c.split()[0] for c in overlay.STEP.split(", ")]
    return spark.createDataFrame([tuple(({"seq": k, "leg": 0} | r).get(c) for c in names) for k, r in enumerate(rows)], overlay.STEP)


def rename(a, b):
    return {"kind": "amend", "bbref_slug": a, "field": "bbref_slug", "value": b}


def test_steps_follow_renames(spark):
    s = steps(spark, rename("a", "b"), {"kind": "trade", "bbref_slug": "b", "team": "BOS"}, {"kind": "trade", "bbref_slug": "a", "team": "NYK"}, rename("b", "c"), {"kind": "amend", "bbref_slug": "c", "field": "cap_hit", "value": "7"}, {"kind": "waive", "bbref_slug": "d", "team": "LAL"})
    frame, warnings = overlay.apply_transactions(years(spark, "a", "d", "e"), s, "s")
    got = {r.bbref_slug: (r.team_abbrev, r.cap_hit, r.contract_id) for r in frame.collect()}
    assert got == {"c": ("BOS", 7, "c-a"), "e": ("LAL", 102, "c-e")}
    assert [(r.warn_seq, r.warning) for r in warnings.collect()] == [(2, "no row of a to trade")]


def test_slugs_that_come_to_be_one(spark):
    s = steps(spark, rename("b", "a"), {"kind": "trade", "bbref_slug": "a", "team": "BOS"}, {"kind": "sign", "bbref_slug": "b", "player": "b", "team": "MIA", "cap_hit": 9, "guaranteed": 9})
    frame, warnings = overlay.apply_transactions(years(spark, "a", "b"), s, "s")
    assert sorted((r.bbref_slug, r.team_abbrev, r.cap_hit) for r in frame.collect()) == [("a", "BOS", 100), ("a", "BOS", 101), ("b", "MIA", 9)] and warnings.count() == 0


def test_long_chains_of_renames(spark):
    order = [f"s{i:03d}" for i in range(60)]
    names = order[:]
    random.Random(3).shuffle(names)
    s = steps(spark, *(rename(names[i], names[i + 1]) for i in range(59)), rename("x", "y"), rename("y", "x"), {"kind": "amend", "bbref_slug": "s000", "field": "cap_hit", "value": None} | {"value": "1"})
    roots = {r.slug: r.root for r in overlay._roots(s).collect()}
    assert roots == {n: "s000" for n in order} | {"x": "x", "y": "x"}
    frame, _ = overlay.apply_transactions(years(spark, names[0], "x"), s, "s")
    assert sorted((r.bbref_slug, r.contract_id) for r in frame.collect()) == sorted([(names[59], f"c-{names[0]}"), ("x", "c-x")])


def test_sweep_equals_the_range_join(spark):
    rng = random.Random(4)
    stints, events = [], []
    for g in range(3):
        for p in range(1, 4):
            cuts = sorted(rng.sample(range(0, 720), 6))
            stints += [(f"g{g}", p, k, float(a), float(b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if k != 2]  # a gap
            events += [(f"g{g}", p, float(rng.choice([*cuts, *range(720)])), i) for i in range(80)]
    events += [("g0", 9, 5.0, -1), ("zz", 1, 5.0, -2), ("g0", 1, 5.0, -3), ("g0", 1, 5.0, -3)]
    st = spark.createDataFrame(stints, "game_id string, period int, stint_no int, start_s double, end_s double")
    ev = spark.createDataFrame(events, "game_id string, period int, t double, id int")
    got = possessions.in_stint(ev, st)
    want = sorted((e[0], e[1], e[2], s[2], e[3]) for e in events for s in stints if e[:2] == s[:2] and s[3] <= e[2] < s[4])
    assert sorted(map(tuple, got.select("game_id", "period", "t", "stint_no", "id").collect())) == want and want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_overtime(spark):
    rows = [("g", 1, 5, 290.0, "Made Shot", None, "", 1, 1, None, None), ("g", 2, 5, 100.0, "Substitution", None, "", 1, 1, 2, None), ("g", 3, 5, 50.0, "Turnover", None, "", 1, 2, None, None)]
    s = lineups.reconstruct_stints(spark.createDataFrame(rows, EVENT))
    assert [(r.start_s, r.end_s, r.lineup) for r in s.orderBy("stint_no").collect()] == [(0.0, 200.0, [1]), (200.0, 300.0, [2])]
    t = {r.stint_no: (r.fga, r.tov) for r in possessions.tally_by_stint(spark.createDataFrame(rows, EVENT), s).collect()}
    assert t == {1: (1, 0), 2: (0, 1)}


def test_unknown_ids_of_events_without_a_number(spark):
    rows = [("g", None, 1, 700.0, "Shot", None, "", 1, 77, 5, None), (None, 3, 1, 700.0, "Shot", None, "", 1, 5, None, 78), ("g", 4, 1, None, "Shot", None, "", 1, 5, None, None)]
    known = spark.createDataFrame([(5,)], "nba_player_id long")
    got = sorted((str(r.event_num), r.player1_id, r.player2_id, r.player3_id) for r in lineups.apply_allowlist(spark.createDataFrame(rows, EVENT), known).collect())
    assert got == [("3", 5, None, None), ("4", 5, None, None), ("None", None, 5, None)]


@pytest.mark.parametrize("k", [64, 800])
def test_merged_sketches_stay_within_their_error(spark, k):
    df = spark.range(60_000).select((F.col("id") % 3).alias("site"), (F.col("id") % 40).alias("chain"), (F.hash("id") % 100_000).cast("double").alias("value"))
    parts = posterior.sketches(df, "site", "chain", k=k)
    got = posterior.sketch_summary(posterior.merged_sketches(parts, "site", k=k), "site").collect()
    assert {r.n for r in got} == {20_000}
    values = {s: sorted(r.value for r in df.filter(f"site = {s}").collect()) for s in range(3)}
    for r in got:
        own = values[r.site]
        for end, p in ((r.lower, 0.1), (r.upper, 0.9)):
            assert abs(sum(v <= end for v in own) / len(own) - p) < 3 * posterior.rank_error(k)
        assert abs(r.mean - sum(own) / len(own)) < 1e-6
