"""Feeds, lineups, blocks, sheets and fits over the driver's tables, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents
from ..functions.names import names_consistent
from ..functions.parsing import looks_empty
from ..operators import aging, contracts, identity, lineups, possessions, posterior, ratings, trade
from ..session import table
from ..snapshots import SnapshotTable
from ..sources import app, files
from ..tables import scratch
from .catalog import _GATE, _K, _LINE, _PBP, _REST, _STINT, YEAR, _box, _gate, _pbp, _value
from .registry import query

_SQL_TYPE = "CASE event_type WHEN 'signup' THEN 'Substitution' WHEN 'error' THEN 'Substitution' WHEN 'purchase' THEN 'Made Shot' WHEN 'click' THEN 'Turnover' ELSE 'Rebound' END"


@query(f"""WITH {_PBP} SELECT game_id, cast(event_id AS INTEGER) AS event_num, cast(period AS SMALLINT) AS period, cast(floor(clk) AS DOUBLE) AS clock, {_SQL_TYPE} AS event_type, CASE WHEN value > 50 THEN '3PT jumper' ELSE 'layup' END AS description,
 CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 + 1 END AS team_id, CASE WHEN k % 7 = 0 THEN 1610612737 + k % 30 ELSE k END AS person_id, k % 5 <> 0 AND k % 11 <> 0 AND k % 7 <> 0 AS reliable FROM ev""")
def q41_pbp_parse(spark: SparkSession, d: str) -> DataFrame:
    """Play-by-play JSON, each action twice: the first counts."""
    k = F.coalesce("player1_id", "player2_id")
    left = F.floor("clock_seconds_left").cast("int")
    a = _pbp(spark, d).select("game_id", F.struct(
        F.col("event_num").alias("actionNumber"), F.format_string("PT%02dM%02d.00S", F.floor(left / 60).cast("int"), left % 60).alias("clock"), F.col("period").cast("int").alias("period"), F.when(k % 11 == 0, F.lit(0).cast("long")).otherwise(F.col("team_id")).alias("teamId"),
        F.when(k % 7 == 0, F.lit(1_610_612_737) + k % 30).otherwise(k).alias("personId"), F.when(k % 5 == 0, " ").otherwise("Name").alias("playerName"), "description", F.col("event_type").alias("actionType"), F.lit("1").alias("scoreHome"),
    ).alias("a"))
    once = a.groupBy("game_id").agg(F.sort_array(F.collect_list("a")).alias("once"))
    twice = F.concat("once", F.transform("once", lambda x: x.withField("description", F.lit("again"))))
    payload = once.select("game_id", F.to_json(F.struct(F.struct(F.col("game_id").alias("gameId"), twice.alias("actions")).alias("game"))).alias("payload"))
    return files.pbp_actions(payload, "payload").select("game_id", "event_num", "period", F.col("clock_seconds_left").alias("clock"), "event_type", "description", "team_id", "person_id", "reliable")


def parse_box(payloads: DataFrame) -> DataFrame:
    """(game_id, payload) rows to ``stg.box_player``."""
    return files.box_players(payloads, "payload")


@query(f"""WITH {_PBP} SELECT game_id, k AS nba_player_id, k % 2 + 1 AS nba_team_id, cast(count(*) * 200 AS INTEGER) AS seconds_played, cast(k AS SMALLINT) AS pts, k % 3 = 0 AS started FROM ev GROUP BY ALL""")
def q42_box_parse(spark: SparkSession, d: str) -> DataFrame:
    """Box-score JSON of two teams, minutes in both spellings."""
    s, k = F.col("seconds_played"), F.col("nba_player_id")
    minutes = F.when(k % 2 == 0, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise(F.format_string("PT%dM%d.00S", F.floor(s / 60), s % 60))
    player = F.struct(k.alias("personId"), F.when(k % 3 == 0, "G").otherwise(" ").alias("position"), F.struct(minutes.alias("minutes"), k.cast("int").alias("points")).alias("statistics"))
    team = lambda t: F.struct(F.lit(t).cast("long").alias("teamId"), F.collect_list(F.when(F.col("nba_team_id") == t, player)).alias("players"))
    payload = _box(spark, d).groupBy("game_id").agg(F.to_json(F.struct(F.struct(team(1).alias("homeTeam"), team(2).alias("awayTeam")).alias("boxScoreTraditional"))).alias("payload"))
    return parse_box(payload).select("game_id", "nba_player_id", "nba_team_id", "seconds_played", "pts", "started")


@query("""SELECT c_custkey AS nba_player_id, replace(c_name, '#', ' ') AS full_name, 'Customer' AS first_name, string_split(c_name, '#')[2] AS last_name, cast(c_nationkey AS SMALLINT) AS from_year,
 CASE WHEN c_nationkey <> 3 THEN cast(c_nationkey AS SMALLINT) END AS to_year, c_mktsegment = 'BUILDING' AS is_active FROM customer""")
def q43_players(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey").cast("string")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.regexp_replace("c_name", "#", " ").alias("display_first_last"), n.alias("from_year"), F.when(F.col("c_nationkey") == 3, "n/a").otherwise(n).alias("to_year"), F.when(F.col("c_mktsegment") == "BUILDING", "1").otherwise("0").alias("rosterstatus"))
    return files.players_from_rows(rows.unionByName(rows))


@query("SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS consistent FROM part")
def q44_names_consistent(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.element_at(F.split("p_name", " "), 1), F.when(F.col("p_size") % 2 == 0, "").otherwise(" Zzz"))
    return table(spark, d, "part").select("p_partkey", names_consistent(F.concat(F.lit("X. "), F.upper("p_name")), F.when(F.col("p_size") % 3 == 0, " ").otherwise(own)).alias("consistent"))


@query("SELECT event_id, event_type IN ('signup', 'view', 'error') AS empty FROM events")
def q45_looks_empty(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    payload = F.when(t == "signup", '{"resultSets":[{"rowSet":[]},{"rowSet":[]}]}').when(t == "view", '{"game":{}}').when(t == "error", "{}").when(t == "click", '{"resultSets":[{"rowSet":[]},{"rowSet":[["1"]]}]}').otherwise('{"game":{"actions":[1]},"meta":null}')
    return table(spark, d, "events").select("event_id", looks_empty(payload).alias("empty"))


@query("SELECT l_suppkey, round(count(*) - count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_linestatus = 'O') + 0.44::DOUBLE * sum(l_linenumber), 4) AS possessions FROM lineitem GROUP BY 1")
def q46_possessions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("fga"), F.count_if(F.col("l_returnflag") == "R").alias("oreb"), F.count_if(F.col("l_linestatus") == "O").alias("tov"), F.sum("l_linenumber").alias("fta"))
    return t.select("l_suppkey", F.round(possessions.possessions(*map(F.col, ("fga", "oreb", "tov", "fta"))), 4).alias("possessions"))


@query(f"SELECT {_SQL_TYPE} AS event_type, count(*) AS n, count(*) FILTER (event_type <> 'signup' AND {_K} < 25) AS n_out, count(*) FILTER (event_type = 'signup' AND {_K} < 25) AS n_in FROM events GROUP BY 1")
def q47_allowlist(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nba_player_id"))
    return lineups.apply_allowlist(_pbp(spark, d), known).groupBy("event_type").agg(F.count("*").alias("n"), F.count("player1_id").alias("n_out"), F.count("player2_id").alias("n_in"))


def _ten(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each supplier is a game of three stints with ten players. In every fourth the teams are six and four; in every
    fifth one player is unknown; every seventh has a lineup of nine. Order lines are the events."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("game_id"), F.col("s_suppkey").alias("g"))
    ids = F.expr("transform(sequence(0L, if(g % 7 = 0, 8L, 9L)), i -> g * 10 + i)")
    stints = s.select("game_id", F.lit(1).cast("short").alias("period"), ids.alias("lineup"), F.explode(F.array(*(F.struct(F.lit(n).alias("stint_no"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for n, a, b in ((1, 0.0, 200.0), (2, 200.0, 500.0), (3, 500.0, 720.0))))).alias("w")).select("game_id", "period", "w.*", "lineup")
    i = F.col("p") % 10
    team = F.when((F.col("g") % 4 == 0) & (i == 1), 1).otherwise(i % 2 + 1).cast("long")
    box = s.select("game_id", "g", F.explode(F.expr("sequence(g * 10, g * 10 + 9)")).alias("p")).filter(~((F.col("g") % 5 == 0) & (i == 3))).select("game_id", F.col("p").alias("nba_player_id"), team.alias("nba_team_id"))
    flag = F.col("l_returnflag")
    ev = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("game_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_num"), F.lit(1).cast("short").alias("period"), (F.lit(720.0) - F.col("l_orderkey") % 720).alias("clock_seconds_left"),
        F.when(F.col("l_linenumber") == 7, "Free Throw Made").when(F.col("l_linenumber") == 6, "Free Throw").when(flag == "A", "Made Shot").when(flag == "N", "Missed Shot").otherwise("Turnover").alias("event_type"), F.lit(None).cast("string").alias("event_action_type"),
        F.when(F.col("l_quantity") > 25, "3PT").otherwise("").alias("description"), (F.col("l_linenumber") % 2 + 1).cast("long").alias("team_id"),
    )
    return ev, stints, box


_TEN = """WITH g AS (SELECT s_suppkey AS g FROM supplier), p AS (SELECT g, unnest(range(0, CASE WHEN g % 7 = 0 THEN 9 ELSE 10 END)) AS i FROM g),
 t AS (SELECT g, g * 10 + i AS p, CASE WHEN g % 4 = 0 AND i = 1 THEN 1 ELSE i % 2 + 1 END AS team FROM p WHERE NOT (g % 5 = 0 AND i = 3)),
 side AS (SELECT g, team, string_agg(cast(p AS VARCHAR), ',' ORDER BY p) AS five FROM t WHERE g % 4 <> 0 AND g % 5 <> 0 AND g % 7 <> 0 GROUP BY ALL),
 e AS (SELECT l_suppkey AS g, l_orderkey % 720 AS tm, l_linenumber % 2 + 1 AS team, l_linenumber AS n, l_returnflag AS f, l_quantity AS q FROM lineitem),
 tally AS (SELECT g, CASE WHEN tm < 200 THEN 1 WHEN tm < 500 THEN 2 ELSE 3 END AS stint_no, team, count(*) FILTER (n < 6 AND f IN ('A', 'N')) AS fga, count(*) FILTER (n < 6 AND f = 'R') AS tov, count(*) FILTER (n >= 6) AS fta,
 coalesce(sum(CASE WHEN n = 7 THEN 1 WHEN n < 6 AND f = 'A' THEN CASE WHEN q > 25 THEN 3 ELSE 2 END ELSE 0 END), 0) AS pts FROM e GROUP BY ALL),
 blocks AS (SELECT cast(t.g AS VARCHAR) AS game_id, t.g, cast(stint_no AS INTEGER) AS stint_no, cast(t.team AS BIGINT) AS team_id, o.five AS offense, d.five AS defense, cast(pts AS DOUBLE) AS points, round(fga + tov + 0.44 * fta, 4)::DOUBLE AS possessions
 FROM tally t JOIN side o ON o.g = t.g AND o.team = t.team JOIN side d ON d.g = t.g AND d.team <> t.team WHERE fga + tov + 0.44 * fta > 0)"""


def _five(c: str) -> F.Column:
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


@query(_TEN + " SELECT cast(side.g AS VARCHAR) AS game_id, cast(s AS INTEGER) AS stint_no, cast(team AS BIGINT) AS team_id, five FROM side, (SELECT unnest([1, 2, 3]) AS s)")
def q48_split_lineups(spark: SparkSession, d: str) -> DataFrame:
    _, stints, box = _ten(spark, d)
    return possessions.split_lineups(stints, box).select("game_id", "stint_no", "team_id", _five("five").alias("five"))


@query(_TEN + " SELECT game_id, stint_no, team_id, offense, defense, points, possessions FROM blocks")
def q23_offense_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = possessions.offense_blocks(*_ten(spark, d))
    return b.select("game_id", "stint_no", "team_id", _five("offense").alias("offense"), _five("defense").alias("defense"), "points", F.round("possessions", 4).alias("possessions"))


@query(_TEN + """, state AS (SELECT s_suppkey AS g, CASE WHEN s_suppkey % 10 = 1 OR s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) THEN 'missing' WHEN s_suppkey % 6 = 0 THEN 'isolated' END AS reason FROM supplier)
 SELECT cast(state.g AS VARCHAR) AS game_id, reason, count(blocks.g) AS n_blocks, round(coalesce(sum(points), 0), 3) AS points FROM state LEFT JOIN blocks ON blocks.g = state.g AND reason IS NULL GROUP BY ALL""")
def q49_warehouse_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Games without a box score are missing, every sixth fails the gate."""
    ev, stints, box = _ten(spark, d)
    games = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("game_id"), F.col("s_suppkey").alias("g"))
    gate = games.select("game_id", (F.col("g") % 6 != 0).alias("passed"), F.when(F.col("g") % 6 == 0, "isolated").alias("category"))
    blocks, out = possessions.warehouse_blocks(ev, box.join(games.filter("g % 10 <> 1"), "game_id", "left_semi"), games.select("game_id"), stints, gate)
    per = blocks.groupBy("game_id").agg(F.count("*").alias("n_blocks"), F.sum("points").alias("points"))
    return games.select("game_id").join(out, "game_id", "left").join(per, "game_id", "left").select("game_id", "reason", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.round(F.coalesce("points", F.lit(0.0)), 3).alias("points"))


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as contracts: the first lines are the years; every ninth guarantee matches none, every eighth is blank,
    every tenth row is there twice."""
    lines = contracts.dedupe_first(table(spark, d, "lineitem").select(*_LINE, *_REST), _LINE, _REST)
    y = lines.groupBy(F.col("l_orderkey").alias("k")).agg(*(F.max(F.when(F.col("l_linenumber") == i, cents("l_extendedprice"))).alias(f"y{i}") for i in range(1, 7)))
    k = F.col("k")
    rows = y.select(k.alias("rk"), F.concat(F.lit("P"), k.cast("string")).alias("player"), F.concat(F.lit("T"), (k % 7).cast("string")).alias("team_abbrev"), *(f"y{i}" for i in range(1, 7)), F.when(k % 8 == 0, None).otherwise(F.col("y1") + F.when(k % 9 == 0, 5).otherwise(0)).alias("guaranteed"), (k % 1000).cast("string").alias("bbref_slug"))
    return rows.unionByName(rows.filter("rk % 10 = 0").withColumn("rk", F.col("rk") + 100_000_000))


_LINES1 = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_REST)}) AS rn FROM lineitem) WHERE rn = 1)"
_Y = "cast(round(l_extendedprice * 100) AS BIGINT)"
_CONTRACTS = f"""WITH y AS (SELECT l_orderkey AS k, {', '.join(f'max({_Y}) FILTER (l_linenumber = {i}) AS y{i}' for i in range(1, 7))} FROM {_LINES1} GROUP BY 1),
 c AS (SELECT *, CASE WHEN k % 8 <> 0 THEN y1 + CASE WHEN k % 9 = 0 THEN 5 ELSE 0 END END AS g, 'T' || (k % 7) AS team, cast(k % 1000 AS VARCHAR) AS slug FROM y),
 f AS (SELECT *, g IS NULL OR coalesce(abs(y1 - g) <= 1, FALSE) OR coalesce(abs(y1 + y2 - g) <= 1, FALSE) OR coalesce(abs(y1 + y2 + y3 - g) <= 1, FALSE) OR coalesce(abs(y1 + y2 + y3 + y4 - g) <= 1, FALSE) OR coalesce(abs(y1 + y2 + y3 + y4 + y5 - g) <= 1, FALSE) OR coalesce(abs(y1 + y2 + y3 + y4 + y5 + y6 - g) <= 1, FALSE) AS clean FROM c)"""


@query(_CONTRACTS + """ SELECT count(*) + count(*) FILTER (k % 10 = 0) AS n_rows, count(*) AS n_unique, count(*) FILTER (NOT clean) AS n_partial, count(*) FILTER (g IS NULL) AS n_blank, count(DISTINCT team) FILTER (team = 'T6') AS n_unknown_teams,
 (SELECT count(*) FROM (SELECT slug FROM c GROUP BY 1 HAVING count(DISTINCT team) > 1)) AS n_multi_team, count(*) FILTER (k % 10 = 0) AS n_duplicates FROM f""")
def q50_quality_report(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(f"T{i}",) for i in range(6)], "team_abbrev string")
    return contracts.quality_report(_contracts(spark, d), known, files.SEASONS)


@query(_CONTRACTS + """, m AS (SELECT slug FROM c GROUP BY 1 HAVING count(DISTINCT team) > 1), x AS (SELECT f.*, f.slug IN (SELECT slug FROM m) AS multi FROM f)
 SELECT team AS team_abbrev, cast(sum(y2) AS BIGINT) AS payroll, count(*) AS n_players, count(*) FILTER (multi OR NOT clean) AS n_review, cast(coalesce(sum(y2) FILTER (multi OR NOT clean), 0) AS BIGINT) AS review_amount, row_number() OVER (ORDER BY sum(y2) DESC, team) AS place FROM x WHERE y2 IS NOT NULL GROUP BY team""")
def q51_sorted_payroll(spark: SparkSession, d: str) -> DataFrame:
    """Contracts to contract-years to the second season's payroll, ranked."""
    years = contracts.to_contract_years(_contracts(spark, d), files.SEASONS)
    return ratings.ranked(contracts.team_payroll(years, files.SEASONS[1]), "payroll", "team_abbrev").withColumnRenamed("rank", "place")


@query(f"""WITH s AS (SELECT c_nationkey AS team, sum(100000000 + cast(round(c_acctbal * 100) AS BIGINT)) // 30 AS cap_payroll, sum(100000000 + cast(round(c_acctbal * 100) AS BIGINT) + c_custkey) // 30 AS p, count(*) FILTER (c_custkey % 50 <> 0) AS roster_count, count(*) FILTER (c_custkey % 50 = 0) = 0 AS certain FROM customer GROUP BY 1)
 SELECT 'n' || team AS team, cast(cap_payroll AS BIGINT) AS cap_payroll, cast(p AS BIGINT) AS apron_payroll, roster_count, certain,
 CASE WHEN p >= {YEAR['second_apron']} THEN 'over_second_apron' WHEN p >= {YEAR['first_apron']} THEN 'between_aprons' WHEN p >= {YEAR['tax_level']} THEN 'taxpayer' WHEN p >= {YEAR['salary_cap']} THEN 'over_cap' ELSE 'under_cap' END AS status,
 CASE WHEN roster_count > {YEAR['max_roster']} THEN 'over' WHEN roster_count < {YEAR['min_roster']} THEN 'under' ELSE 'ok' END AS roster_flag FROM s""")
def q52_cap_sheets(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "customer").select(F.lit("s").alias("season"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("team_abbrev"), (F.lit(100_000_000) + cents("c_acctbal")).alias("cap_hit"), F.col("c_custkey").alias("incentives_likely"), (F.col("c_custkey") % 50 == 0).alias("needs_review"))
    sheets = trade.cap_sheets(years.unionByName(years.withColumn("season", F.lit("other"))), "s")
    thirtieth = lambda c: F.floor(F.col(c) / 30).cast("long")
    return trade.roster_report(sheets.withColumns({"cap_payroll": thirtieth("cap_payroll"), "apron_payroll": thirtieth("apron_payroll")}), YEAR)


@query(f"WITH {_STINT} SELECT w.game_id, cast(w.period AS SMALLINT) AS period, cast(event_id AS INTEGER) AS event_num, w.k AS player_id FROM (SELECT *, lag(a) OVER (PARTITION BY game_id, period, k ORDER BY q) AS before FROM tog) w JOIN o ON o.game_id = w.game_id AND o.period = w.period AND 2 * o.pos = w.q AND w.q > 0 WHERE a = 0 AND coalesce(before, 0) = 0")
def q53_exits_while_off(spark: SparkSession, d: str) -> DataFrame:
    return lineups.exits_while_off(_pbp(spark, d))


@query(f"WITH {_GATE}, bad AS (SELECT *, round(abs(r - b), 6) AS error FROM gate WHERE abs(r - b) > 90) SELECT game_id, cast(row_number() OVER (PARTITION BY game_id ORDER BY error DESC, k) AS INTEGER) AS place, k AS player_id, round(r, 3) AS recon_s, cast(b AS DOUBLE) AS box_s FROM bad")
def q54_gate_offenders(spark: SparkSession, d: str) -> DataFrame:
    gate = _gate(spark, d).withColumn("error", F.round("error", 6))
    return lineups.gate_offenders(gate).select("game_id", "place", "player_id", F.round("recon_s", 3).alias("recon_s"), "box_s")


@query(f"WITH {_GATE} SELECT game_id, NOT bool_or(abs(r - b) > 90) AS passed, round(max(abs(r - b)), 3) AS max_error, count(*) FILTER (abs(r - b) > 90) AS n_offenders FROM gate GROUP BY 1")
def q55_gate_errors(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([], "nba_player_id long, full_name string")
    return lineups.gate_results(_gate(spark, d), _box(spark, d), names).select("game_id", "passed", F.round("max_error", 3).alias("max_error"), "n_offenders")


@query(f"""WITH {_GATE}, twin AS (SELECT a.game_id, a.k FROM box a JOIN box b ON a.game_id = b.game_id AND a.k % 2 = b.k % 2 AND a.k <> b.k AND a.k % 10 = b.k % 10 GROUP BY ALL),
 cat AS (SELECT gate.game_id, NOT bool_or(abs(r - b) > 90) AS ok, bool_or(abs(r - b) > 90 AND twin.k IS NOT NULL) AS twin, bool_and(abs(r - b) <= 90 OR r = 0) AS gap FROM gate LEFT JOIN twin ON twin.game_id = gate.game_id AND twin.k = gate.k GROUP BY 1)
 SELECT CASE WHEN ok THEN 'passed' WHEN twin THEN 'surname-collision' WHEN gap THEN 'data-gap' ELSE 'isolated' END AS category, count(*) AS n FROM cat GROUP BY 1""")
def q56_gate_categories(spark: SparkSession, d: str) -> DataFrame:
    """Players whose ids end alike share a last name."""
    box = _box(spark, d)
    names = box.select("nba_player_id").distinct().withColumn("full_name", F.concat(F.lit("First Last"), (F.col("nba_player_id") % 10).cast("string")))
    r = lineups.gate_results(_gate(spark, d), box, names)
    return r.groupBy(F.when(F.col("passed"), "passed").otherwise(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment AS team_abbrev FROM customer WHERE c_nationkey = 3 ORDER BY 1")
def q57_teams_in(spark: SparkSession, d: str) -> DataFrame:
    return app.teams_in(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("season"), F.col("c_mktsegment").alias("team_abbrev")), "3")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^RED|green$')")
def q58_search_names(spark: SparkSession, d: str) -> DataFrame:
    return app.search_names(table(spark, d, "part").select("p_partkey", "p_name"), "^RED|green$", "p_name")


@query("""WITH e AS (SELECT l_suppkey AS player_id, sum(l_extendedprice) / sum(l_quantity) / 100 AS total FROM lineitem GROUP BY 1)
 SELECT c_custkey, player_id, round(total, 4) AS total FROM customer LEFT JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name LEFT JOIN e ON player_id = s_suppkey""")
def q59_lookup_by_name(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("nba_player_id"), F.col("s_name").alias("full_name"))
    board = files.leaderboard_rows(_value(spark, d), names).select("player_id", "name", "total")
    rows = table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "Customer", "Supplier").alias("player"))
    return app.with_ratings(rows, board).select("c_custkey", "player_id", F.round("total", 4).alias("total"))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions of 50 games: errors are substitutions, clicks and views name their player reliably."""
    k, t, e = F.get_json_object("props", "$.k").cast("long"), F.col("event_type"), F.col("event_id")
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    into = F.when(e % 3 == 0, name(e % 10)).otherwise(F.concat(F.lit("x "), name(e % 10)))
    out = F.when(e % 4 == 0, name(k % 8)).otherwise(F.concat(F.lit("x "), name(k % 8)))
    return table(spark, d, "events").select(
        (F.col("user_id") % 50).cast("string").alias("game_id"), e.alias("event_num"), e.alias("pos"), F.when(t == "error", "Substitution").otherwise("Shot").alias("event_type"), F.when(t == "error", F.concat(F.lit("SUB: "), into, F.lit(" FOR "), out)).alias("description"),
        (k % 2 + 1).alias("team_id"), k.alias("person_id"), name(k % 8).alias("player_name"), t.isin("click", "view").alias("reliable"),
    )


_RESOLVE = f"""WITH a AS (SELECT cast(user_id % 50 AS VARCHAR) AS game_id, event_id AS e, event_type AS t, {_K} AS k FROM events),
 m AS (SELECT game_id, k % 2 + 1 AS team, 'n' || (k % 8) AS name, k, e, 0 AS alias FROM a WHERE t IN ('click', 'view') UNION ALL SELECT game_id, k % 2 + 1, CASE WHEN e % 4 = 0 THEN '' ELSE 'x ' END || 'n' || (k % 8), k, e, 1 FROM a WHERE t = 'error'),
 reg AS (SELECT game_id, team, name, coalesce(arg_max(k, e) FILTER (alias = 0), arg_min(k, e) FILTER (alias = 1)) AS id, min(2 * e + alias) AS mention FROM m GROUP BY ALL),
 s AS (SELECT game_id, e, k % 2 + 1 AS team, CASE WHEN e % 3 = 0 THEN '' ELSE 'x ' END || 'n' || (e % 10) AS want FROM a WHERE t = 'error'),
 hit AS (SELECT s.game_id, s.e, coalesce(arg_min(reg.id, CASE WHEN reg.name = s.want THEN -1 ELSE mention END), NULL) AS id FROM s JOIN reg ON reg.game_id = s.game_id AND reg.team = s.team AND list_has_all(string_split(s.want, ' '), string_split(reg.name, ' ')) GROUP BY ALL)"""


@query(_RESOLVE + " SELECT s.game_id, s.e AS event_num, hit.id AS player2_id FROM s LEFT JOIN hit USING (game_id, e)")
def q60_resolve_incoming(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolve_incoming(_actions(spark, d))


@query(_RESOLVE + " SELECT s.game_id, count(*) AS n_subs, count(*) FILTER (hit.id IS NULL) AS n_unresolved, 0 AS n_inconsistent FROM s LEFT JOIN hit USING (game_id, e) GROUP BY 1")
def q61_sub_audit(spark: SparkSession, d: str) -> DataFrame:
    return identity.sub_audit(_actions(spark, d)).withColumn("n_inconsistent", F.col("n_inconsistent").cast("int"))


@query("SELECT avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)::DECIMAL(18, 6)::DOUBLE AS coverage, count(*) AS n FROM (SELECT user_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY 1) q JOIN events USING (user_id) WHERE event_type = 'click'")
def q62_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    draws = e.select(F.lit("player").alias("site"), F.col("user_id").alias("player_id"), F.lit(0).alias("age"), "value")
    return aging.coverage(draws, e.filter("event_type = 'click'").select(F.col("user_id").alias("player_id"), F.lit(0).alias("age"), "value")).withColumn("coverage", F.round("coverage", 6))


@query("""WITH s AS (SELECT event_type, event_id % 2 AS chain, event_id // 2 AS draw, value FROM events), h AS (SELECT chain, (max(draw) + 1) / 2 AS mid FROM s GROUP BY 1),
 p AS (SELECT event_type, chain, draw >= mid AS part, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM s JOIN h USING (chain) GROUP BY ALL), z AS (SELECT event_type, avg(v) AS w, var_samp(m) AS b, avg(n) AS n FROM p GROUP BY 1)
 SELECT event_type, round(sqrt(((n - 1) / n * w + b) / w), 6) AS r_hat FROM z""")
def q63_split_r_hat(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    s = table(spark, d, "events").select("event_type", (e % 2).alias("chain"), F.floor(e / 2).alias("draw"), "value")
    return aging.split_r_hat(s, "event_type").withColumn("r_hat", F.round("r_hat", 6))


@query("""WITH b AS (SELECT l_linenumber % 2 AS a, l_extendedprice / l_quantity AS y, l_quantity AS w FROM lineitem WHERE l_quantity >= 1),
 s AS (SELECT sum(w) FILTER (a = 1) AS wa, sum(w) FILTER (a = 0) AS wb, sum(w * y) FILTER (a = 1) / sum(w) FILTER (a = 1) AS ya, sum(w * y) FILTER (a = 0) / sum(w) FILTER (a = 0) AS yb FROM b),
 c AS (SELECT wa + wb AS w, wa * wb / (wa + wb) * (ya - yb) / (100 + 4 * wa * wb / (wa + wb)) AS t FROM s)
 SELECT cast(p AS BIGINT) AS player_id, round(CASE p WHEN 1 THEN t ELSE -t END, 6) AS offense, round(CASE p WHEN 1 THEN t ELSE -t END, 6) AS defense, round(CASE p WHEN 1 THEN 2 * t ELSE -2 * t END, 6) AS total, round(w, 3) AS possessions FROM c, (SELECT unnest([1, 2]) AS p)""")
def q64_two_player_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Two players who take turns: the ridge has a closed form."""
    odd = F.col("l_linenumber") % 2 == 1
    side = lambda a, b: F.array(F.when(odd, a).otherwise(b).cast("long"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("game_id"), side(1, 2).alias("offense"), side(2, 1).alias("defense"), (F.col("l_extendedprice") / 100).alias("points"), F.col("l_quantity").cast("double").alias("possessions"))
    r, _ = ratings.fit_ratings(spark, b, fixed=100.0)
    return r.select("player_id", *(F.round(c, 6).alias(c) for c in ("offense", "defense", "total")), F.round("possessions", 3).alias("possessions"))


@query("""WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS sd, avg(s_suppkey) AS y, count(*) AS n FROM supplier), b AS (SELECT sum((s_acctbal - m) / sd * (s_suppkey - y)) / (any_value(n) + 1) AS w FROM supplier, s)
 SELECT s_suppkey, round(y + w * (s_acctbal - m) / sd, 4) AS predicted FROM supplier, s, b""")
def q65_standardized_ridge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_suppkey").cast("double").alias("target"))
    return rows.select("s_suppkey", F.round(ratings.predict(ratings.standardized_ridge(rows, ["s_acctbal"], "target")), 4).alias("predicted"))


@query("SELECT DISTINCT 'P' || l_orderkey AS player, cast(l_orderkey % 1000 AS VARCHAR) AS bbref_slug FROM lineitem")
def q66_crosswalk_seed(spark: SparkSession, d: str) -> DataFrame:
    return contracts.crosswalk_seed(_contracts(spark, d))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q67_rows_of(spark: SparkSession, d: str) -> DataFrame:
    wanted = files.rows_where(table(spark, d, "customer"), c_mktsegment="BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return files.rows_of(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", wanted)


@query()
def q68_box_score_projection(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a nation over the years, their account balances as box score: levels informed by it."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 10).cast("long").alias("player_id"), F.concat(F.lit("g"), (F.col("c_nationkey") % 3).cast("string")).alias("position_group"))
    s = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("player_id", "position_group", F.year("o_orderdate").alias("age")).agg((F.avg("o_totalprice") / 1000).alias("rating"), F.count("*").cast("double").alias("weight"))
    box = c.groupBy("player_id").agg((F.avg("c_acctbal") / 1000).alias("balance"))
    anchor = int(s.agg(F.min("age")).first()[0]) + 2
    final, *_ = aging.fit_box_score_projection(s, box, "rating", "weight", ["balance"], anchor=anchor)
    return aging.posterior_summary(final.filter("site = 'player'"), "player_id", "age")


# Events as draws: a user is a player, an event one draw of the rating; odd and even events are the chains. The noise is
# the same MD5 stream on both sides.
_UNIT = "(('0x' || substr(md5(concat_ws('|', '11', k, chain, draw)), {0}, 13))::BIGINT + 0.5) / 4503599627370496.0"


@query(f"""WITH r AS (SELECT user_id AS player_id, cast(event_id % 2 AS BIGINT) AS chain, event_id // 2 AS draw, value AS mean FROM events),
 s AS (SELECT DISTINCT chain, draw, 1 + draw % 3 AS sigma FROM r), o AS (SELECT event_id AS k, user_id AS player_id, value AS y, 200.0 + event_id % 900 AS w FROM events WHERE event_type = 'click'),
 d AS (SELECT k, y, mean + sigma / sqrt(w / 1000) * sqrt(-2 * ln({_UNIT.format(1)})) * cos(2 * pi() * {_UNIT.format(14)}) AS value FROM o JOIN r USING (player_id) JOIN s USING (chain, draw))
 SELECT k AS observation, round(any_value(y), 4) AS y, round(quantile_cont(value, 0.05), 4) AS lower, round(quantile_cont(value, 0.95), 4) AS upper, any_value(y) BETWEEN quantile_cont(value, 0.05) AND quantile_cont(value, 0.95) AS inside FROM d GROUP BY k""")
def q69_predictive_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value").withColumn("chain", F.col("event_id") % 2).withColumn("draw", F.floor(F.col("event_id") / 2))
    none = {"player_id": F.col("user_id"), "age": F.lit(0)}
    draws = e.select("chain", "draw", F.lit("player").alias("site"), none["player_id"].alias("player_id"), none["age"].alias("age"), "value")
    sigma = e.select("chain", "draw", F.lit("sigma_obs").alias("site"), F.lit(None).cast("long").alias("player_id"), F.lit(None).cast("int").alias("age"), (1 + F.col("draw") % 3).cast("double").alias("value"))
    seen = e.filter("event_type = 'click'").select(F.col("event_id").alias("observation"), none["player_id"].alias("player_id"), none["age"].alias("age"), F.col("value").alias("y"), (200.0 + F.col("event_id") % 900).alias("w"))
    i = posterior.predictive_intervals(posterior.predictive_draws(draws.unionByName(sigma), seen, seed=11))
    return i.select("observation", *(F.round(c, 4).alias(c) for c in ("y", "lower", "upper")), "inside")


# Customers as draws, their yearly mean price as deltas between ages: many have years without an order, where curves end.
_YEARS = """WITH y AS (SELECT c_mktsegment AS position, c_custkey AS draw, cast(year(o_orderdate) AS INTEGER) AS age, (avg(o_totalprice) - 150000) / 1000 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 lo AS (SELECT min(age) + 2 AS anchor FROM y), n AS (SELECT *, age - row_number() OVER (PARTITION BY position, draw ORDER BY age) AS run FROM y),
 h AS (SELECT n.*, anchor, max(CASE WHEN age IN (anchor - 1, anchor) THEN run END) OVER (PARTITION BY position, draw) AS home FROM n, lo), k AS (SELECT * FROM h WHERE run = home),
 c AS (SELECT a.position, a.draw, a.age, (SELECT CASE WHEN a.age >= a.anchor THEN coalesce(sum(value) FILTER (b.age >= b.anchor AND b.age < a.age), 0) ELSE -sum(value) FILTER (b.age >= a.age AND b.age < b.anchor) END FROM k b WHERE b.position = a.position AND b.draw = a.draw) AS value
  FROM (SELECT DISTINCT position, draw, anchor, unnest([age, age + 1]) AS age FROM k) a)"""


@query(_YEARS + " SELECT position, cast(age AS INTEGER) AS age, count(*) AS n, round(avg(value), 4) AS mean, round(stddev(value), 4) AS sd, round(quantile_cont(value, 0.1), 4) AS lower, round(quantile_cont(value, 0.9), 4) AS upper FROM c GROUP BY ALL")
def q70_position_curves(spark: SparkSession, d: str) -> DataFrame:
    deltas, anchor = _yearly(spark, d)
    s = posterior.curve_summary(posterior.position_curves(deltas, anchor), "position")
    return s.select("position", "age", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "lower", "upper")))


def _yearly(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("position")), "o_custkey")
    y = o.groupBy("position", F.col("o_custkey").alias("draw"), F.year("o_orderdate").alias("age")).agg(((F.avg("o_totalprice") - 150000) / 1000).alias("value"))
    return y.withColumns({"chain": F.lit(0), "site": F.lit("position")}), int(table(spark, d, "orders").agg(F.min(F.year("o_orderdate"))).first()[0]) + 2


@query("""WITH y AS (SELECT o_custkey AS player_id, cast(year(o_orderdate) AS INTEGER) AS age, avg(o_totalprice) / 1000 AS value FROM orders GROUP BY ALL), a AS (SELECT player_id, value AS base FROM y WHERE age = (SELECT min(age) + 2 FROM y))
 SELECT player_id, age, round(value - base, 7) AS value FROM y JOIN a USING (player_id)""")
def q71_relative_curves(spark: SparkSession, d: str) -> DataFrame:
    deltas, anchor = _yearly(spark, d)
    draws = deltas.select("chain", F.lit(0).alias("draw"), F.lit("player").alias("site"), F.col("draw").alias("player_id"), "age", (F.col("value") + 150).alias("value"))
    return posterior.player_curves(draws, anchor, level=False).select("player_id", "age", F.round("value", 7).alias("value"))


@query("""WITH s AS (SELECT event_type AS site, user_id % 7 AS player_id, event_id % 2 AS chain, event_id // 2 AS draw, value FROM events), h AS (SELECT chain, (max(draw) + 1) / 2 AS mid FROM s GROUP BY 1),
 p AS (SELECT site, player_id, chain, draw >= mid AS part, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM s JOIN h USING (chain) GROUP BY ALL),
 z AS (SELECT site, player_id, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS r_hat FROM p GROUP BY ALL) SELECT site, round(max(r_hat), 6) AS r_hat, count(*) AS n FROM z GROUP BY 1""")
def q72_max_r_hat(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("event_type").alias("site"), (F.col("user_id") % 7).alias("player_id"), (F.col("event_id") % 2).alias("chain"), F.floor(F.col("event_id") / 2).alias("draw"), "value")
    return posterior.max_r_hat(s, "player_id").withColumn("r_hat", F.round("r_hat", 6))


# Sketches of an event type by day, merged over days: the exact ranks of the interval's ends lie within the stated error.
@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, TRUE AS within FROM events GROUP BY 1")
def q75_merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    s = posterior.sketch_summary(posterior.merged_sketches(posterior.sketches(e, "event_type", "day"), "event_type"), "event_type")
    share = lambda end, strict: F.avg((F.col("value") < F.col(end) if strict else F.col("value") <= F.col(end)).cast("double"))
    ranks = e.join(s, "event_type").groupBy("event_type", "n", "mean").agg(*(share(c, strict).alias(f"{c}{strict:d}") for c in ("lower", "upper") for strict in (True, False)))
    error = posterior.rank_error() + 1e-9
    # with ties a value has a range of ranks, so one of them has to be near
    near = lambda c, p: (F.col(f"{c}1") <= p + error) & (F.col(f"{c}0") >= p - error)
    return ranks.select("event_type", "n", F.round("mean", 6).alias("mean"), (near("lower", 0.1) & near("upper", 0.9)).alias("within"))


@query("SELECT o_orderkey, o_custkey, round(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 * o_totalprice ELSE o_totalprice END, 2) AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def q76_snapshot_table(spark: SparkSession, d: str) -> DataFrame:
    """All orders stored, the urgent ones upserted at twice the price, finished ones deleted, and read back."""
    o = table(spark, d, "orders")
    own = o.select("o_orderkey", "o_custkey", "o_totalprice")
    t = SnapshotTable(spark, scratch(spark, "orders"), ("o_orderkey",))
    t.upsert(own, "o_orderkey")
    t.upsert(o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", (2 * F.col("o_totalprice")).alias("o_totalprice")), "o_orderkey")
    t.delete(o.filter("o_orderstatus = 'F'"), "o_orderkey")
    return t.read().withColumn("o_totalprice", F.round("o_totalprice", 2))
