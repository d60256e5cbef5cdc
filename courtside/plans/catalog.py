"""The operators over the driver's tables, by analogy, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents, parse_dollars, pct_of, strip_dollars
from ..functions.names import last_name, normalize_ascii, normalize_name
from ..functions.parsing import clock_seconds, minutes_to_seconds, safe_int, short_hash, snake_case
from ..operators import aging, contracts, identity, lineups, overlay, possessions, ratings, trade
from ..session import table
from ..sources import files
from .registry import QUERIES, SQL, query  # noqa: F401

YEAR = trade.LEAGUE_YEARS["2026-27"]
@query("""SELECT n.n_name AS team, sum(cast(round(o_totalprice * 100) AS BIGINT)) AS payroll, count(*) AS n_players, count(*) FILTER (o_orderstatus = 'P') AS n_review,
 coalesce(sum(cast(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'P'), 0) AS review_amount
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY 1""")
def q01_payroll(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", cents("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "P").alias("flag"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    # sums by customer first: one row per customer meets the names
    return contracts.group_payroll(o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")), "team", "amount", "flag")


_LINE = ["l_orderkey", "l_linenumber"]
_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_FIRST_LINES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_REST)}) AS rn FROM lineitem) WHERE rn = 1)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM {_FIRST_LINES}")
def q02_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return contracts.dedupe_first(table(spark, d, "lineitem"), _LINE, _REST).select(*_LINE, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(f"""WITH p AS (SELECT l_orderkey AS k, {', '.join(f"max(CASE WHEN l_linenumber = {i} THEN cast(round(l_extendedprice * 100) AS BIGINT) END) AS y{i}" for i in range(1, 7))} FROM {_FIRST_LINES} GROUP BY 1),
 s AS (SELECT *, y1 + y2 AS g FROM p),
 c AS (SELECT *, CASE WHEN g IS NULL THEN 0 WHEN abs(y1 - g) <= 1 THEN 1 WHEN abs(y1 + y2 - g) <= 1 THEN 2 ELSE 0 END AS n FROM s)
 SELECT k, i AS season_index, y AS cap_hit, CASE WHEN i <= n THEN y ELSE 0 END AS guaranteed FROM (SELECT k, n, unnest([1,2,3,4,5,6]) AS i, unnest([y1,y2,y3,y4,y5,y6]) AS y FROM c) WHERE y IS NOT NULL""")
def q03_contract_years(spark: SparkSession, d: str) -> DataFrame:
    lines = contracts.dedupe_first(table(spark, d, "lineitem").select(*_LINE, *_REST), _LINE, _REST)
    pay = cents("l_extendedprice")
    slots = lines.groupBy(F.col("l_orderkey").alias("k")).agg(*(F.max(F.when(F.col("l_linenumber") == i, pay)).alias(f"y{i}") for i in range(1, 7)))
    years = [F.col(f"y{i}") for i in range(1, 7)]
    n, _ = contracts.guarantee_cliff(years, years[0] + years[1])
    out = slots.select("k", n.alias("n"), F.posexplode(F.array(*years)).alias("i", "cap_hit")).filter("cap_hit is not null")
    return out.select("k", (F.col("i") + 1).alias("season_index"), "cap_hit", F.when(F.col("i") < F.col("n"), F.col("cap_hit")).otherwise(F.lit(0).cast("long")).alias("guaranteed"))


@query("SELECT l_partkey, count(DISTINCT s_nationkey) AS n_groups FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1")
def q04_multi_team(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return contracts.multi_group(pairs, "l_partkey", "s_nationkey")


@query("SELECT c_nationkey, count(*) AS n_rows, CASE WHEN count(*) < 55 THEN 'under' ELSE 'over' END AS bound FROM customer GROUP BY 1 HAVING count(*) < 55 OR count(*) > 65")
def q05_roster_bounds(spark: SparkSession, d: str) -> DataFrame:
    return contracts.group_bounds(table(spark, d, "customer").select("c_nationkey"), "c_nationkey", 55, 65)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) AS BIGINT) AS cents,
 cast(round(cast(cast(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(20,0)) * cast(round(l_discount * 100) AS DECIMAL(9,0)) / 100, 0) AS BIGINT) AS cut FROM lineitem""")
def q06_pct_of(spark: SparkSession, d: str) -> DataFrame:
    c = cents("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("cents"), pct_of(c, F.round(F.col("l_discount") * 100)).alias("cut"))


_BANDS = f"CASE WHEN p >= {YEAR['second_apron']} THEN 'over_second_apron' WHEN p >= {YEAR['first_apron']} THEN 'between_aprons' WHEN p >= {YEAR['tax_level']} THEN 'taxpayer' WHEN p >= {YEAR['salary_cap']} THEN 'over_cap' ELSE 'under_cap' END"


@query(f"SELECT o_custkey, p AS payroll, {_BANDS} AS status FROM (SELECT o_custkey, sum(cast(round(o_totalprice * 100) AS BIGINT)) AS p FROM orders GROUP BY 1)")
def q07_apron_bands(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("payroll"))
    return s.withColumn("status", trade.apron_status(F.col("payroll"), YEAR))


_CEIL = "CASE WHEN NOT below THEN s WHEN s <= 7500000 THEN 2 * s + 250000 WHEN s <= 29000000 THEN s + 7500000 ELSE cast(floor((s * 125 + 50) / 100) AS BIGINT) + 250000 END"
_BAND = "CASE WHEN NOT below THEN 'over_apron_100pct' WHEN s <= 7500000 THEN 'band1_200pct+250k' WHEN s <= 29000000 THEN 'band2_S+7.5M' ELSE 'band3_125pct+250k' END"


@query(f"SELECT o_orderkey, {_CEIL.replace(' / 100)', ' // 100)')} AS ceiling, {_BAND} AS band FROM (SELECT o_orderkey, cast(round(o_totalprice * 100) AS BIGINT) AS s, o_orderpriority <> '1-URGENT' AS below FROM orders)")
def q08_matching_ceiling(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", cents("o_totalprice").alias("s"), (F.col("o_orderpriority") != "1-URGENT").alias("below"))
    return o.select("o_orderkey", trade.matching_ceiling(F.col("s"), F.col("below")).alias("ceiling"), trade.matching_band(F.col("s"), F.col("below")).alias("band"))


_TRADE = f"""WITH piece AS (SELECT o_orderkey - o_orderkey % 2 AS trade_id, 't' || (o_custkey % 200) AS a, 't' || ((o_custkey + 7) % 200) AS b, cast(round(o_totalprice * 100) AS BIGINT) AS cap, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS inc FROM orders),
 leg AS (SELECT trade_id, a AS team, cap AS o, 0 AS i, FALSE AS h FROM piece UNION ALL SELECT trade_id, b, 0, cap, inc = 0 FROM piece),
 s AS (SELECT trade_id, team, sum(o) AS o, sum(i) AS i, bool_or(h) AS h FROM leg GROUP BY ALL),
 sheet AS (SELECT 't' || (c_custkey % 190) AS team, 150000000 + sum(cast(round(c_acctbal * 100) AS BIGINT)) AS pay, min(c_acctbal) > -990 AS sure FROM customer GROUP BY 1),
 j AS (SELECT s.*, pay, sure, pay + i - o AS post, pay + i - o < {YEAR['first_apron']} AS below, o AS s FROM s LEFT JOIN sheet USING (team)),
 v AS (SELECT *, {_CEIL.replace(' / 100)', ' // 100)')} AS ceil, sure AND NOT (h AND abs(post - {YEAR['first_apron']}) < 5000000) AS certain FROM j)"""


def _trades(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("trade_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 200).cast("string")).alias("from_team"), F.concat(F.lit("t"), ((F.col("o_custkey") + 7) % 200).cast("string")).alias("to_team"),
        cents("o_totalprice").alias("cap_hit"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).cast("long").alias("incentives_likely"),
    )
    sheets = table(spark, d, "customer").groupBy(F.concat(F.lit("t"), (F.col("c_custkey") % 190).cast("string")).alias("team")).agg((F.lit(150_000_000) + F.sum(cents("c_acctbal"))).alias("apron_payroll"), (F.min("c_acctbal") > -990).alias("certain"))
    return trade.trade_verdicts(o, sheets, YEAR)


@query(_TRADE + f""" SELECT trade_id, team, cast(o AS BIGINT) AS outgoing, cast(i AS BIGINT) AS incoming, cast(CASE WHEN pay IS NULL THEN 0 ELSE ceil END AS BIGINT) AS max_incoming,
 CASE WHEN pay IS NULL OR post < {YEAR['salary_cap']} THEN 'INDETERMINATE' WHEN i > ceil THEN 'ILLEGAL' WHEN NOT certain THEN 'INDETERMINATE' ELSE 'LEGAL' END AS severity,
 CASE WHEN pay IS NULL THEN 'missing input' WHEN post < {YEAR['salary_cap']} THEN 'cap-room path not modeled' WHEN NOT below THEN 'CBA VII(k): over-apron 100% match' WHEN o <= 7500000 THEN 'CBA VII(k)(1): S<=$7.5M' WHEN o <= 29000000 THEN 'CBA VII(k)(2): $7.5M<S<=$29M' ELSE 'CBA VII(k)(3): S>$29M' END AS rule FROM v""")
def q09_trade_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d).select("trade_id", "team", "outgoing", "incoming", "max_incoming", "severity", "rule")


@query(_TRADE + f""", z AS (SELECT trade_id, CASE WHEN pay IS NULL OR post < {YEAR['salary_cap']} THEN 1 WHEN i > ceil THEN 2 WHEN NOT certain THEN 1 ELSE 0 END AS r FROM v)
 SELECT trade_id, count(*) AS n_teams, CASE max(r) WHEN 2 THEN 'ILLEGAL' WHEN 1 THEN 'INDETERMINATE' ELSE 'LEGAL' END AS severity FROM z GROUP BY 1""")
def q09b_trade_rollup(spark: SparkSession, d: str) -> DataFrame:
    return trade.trade_rollup(_trades(spark, d))


_K = "cast(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH base AS (SELECT s_suppkey AS k, cast(round(s_acctbal * 100) AS BIGINT) AS cap FROM supplier),
 st AS (SELECT {_K} AS k, event_id, event_type, cast(round(value * 100) AS BIGINT) AS v FROM events WHERE event_type IN ('signup', 'error', 'click')),
 last AS (SELECT k, arg_max(event_type, event_id) FILTER (event_type <> 'click') AS t, max(event_id) FILTER (event_type <> 'click') AS e, arg_max(v, event_id) FILTER (event_type = 'signup') AS v FROM st GROUP BY 1),
 team AS (SELECT st.k, arg_max(st.event_id % 30, st.event_id) AS team FROM st JOIN last USING (k) WHERE st.event_type = 'click' AND st.event_id > coalesce(last.e, -1) GROUP BY 1)
 SELECT cast(coalesce(base.k, last.k) AS VARCHAR) AS slug, CASE WHEN last.t = 'signup' THEN last.v ELSE base.cap END AS cap_hit,
 CASE WHEN team.team IS NOT NULL THEN 'T' || team.team WHEN last.t = 'signup' THEN 'NEW' ELSE 'OLD' END AS team
 FROM base FULL JOIN last USING (k) LEFT JOIN team ON team.k = coalesce(base.k, last.k) WHERE (last.t IS DISTINCT FROM 'error') AND (base.k IS NOT NULL OR last.t = 'signup')""")
def q10_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("contract_id"), F.lit("s").alias("season"), F.col("s_suppkey").cast("string").alias("bbref_slug"), F.col("s_name").alias("player"), F.lit("OLD").alias("team_abbrev"), F.lit(1).cast("short").alias("season_index"),
        cents("s_acctbal").alias("cap_hit"), F.lit(0).cast("long").alias("guaranteed"), F.lit(False).alias("is_guaranteed"), F.lit(None).cast("string").alias("option_type"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("review_reason"),
    )
    kind = F.when(F.col("event_type") == "signup", "sign").when(F.col("event_type") == "error", "waive").otherwise("trade")
    none = F.lit(None).cast("string")
    slug = F.get_json_object("props", "$.k")
    steps = table(spark, d, "events").filter(F.col("event_type").isin("signup", "error", "click")).select(
        F.col("event_id").alias("seq"), F.lit(0).alias("leg"), kind.alias("kind"), slug.alias("bbref_slug"), slug.alias("player"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("T"), (F.col("event_id") % 30).cast("string"))).otherwise("NEW").alias("team"), cents("value").alias("cap_hit"), F.lit(0).cast("long").alias("guaranteed"), F.lit(False).alias("dead_money"), none.alias("field"), none.alias("value"), none.alias("note"), none.alias("as_of"),
    )
    frame, _ = overlay.apply_transactions(base, steps, "s")
    return frame.select(F.col("bbref_slug").alias("slug"), "cap_hit", F.col("team_abbrev").alias("team"))


# Each slug has another name, r and the number, that events rename it to and from: a fold of both, step by step, over a
# list of rows (contract, slug, cap, guaranteed, team, review).
_FOLD = f"""WITH RECURSIVE ev AS (SELECT event_id AS seq, {_K} AS k, event_type AS t, cast(round(value * 100) AS BIGINT) AS v FROM events WHERE event_type <> 'purchase'),
 st AS (SELECT seq, k, row_number() OVER (PARTITION BY k ORDER BY seq) AS i, CASE WHEN seq % 3 = 0 THEN 'r' || k ELSE k::VARCHAR END AS slug, CASE t WHEN 'signup' THEN 'sign' WHEN 'error' THEN 'waive' WHEN 'click' THEN 'trade' ELSE 'amend' END AS kind,
  CASE t WHEN 'click' THEN 'T' || seq % 30 WHEN 'error' THEN CASE WHEN seq % 5 = 0 THEN 'OLD' ELSE 'NEW' END ELSE 'NEW' END AS team, v AS cap, CASE WHEN seq % 4 = 0 THEN v // 2 ELSE v END AS gtd, seq % 2 = 0 AS even, CASE WHEN seq % 3 = 0 THEN k::VARCHAR ELSE 'r' || k END AS other FROM ev),
 base AS (SELECT s_suppkey AS k, {{'cid': s_suppkey::VARCHAR, 'slug': s_suppkey::VARCHAR, 'cap': cast(round(s_acctbal * 100) AS BIGINT), 'gtd': cast(round(s_acctbal * 100) AS BIGINT), 'team': 'OLD', 'review': FALSE}} AS r FROM supplier),
 keys AS (SELECT k FROM base UNION SELECT k FROM st),
 fold AS (SELECT keys.k, 0::BIGINT AS i, NULL::BIGINT AS seq, CASE WHEN base.k IS NULL THEN [] ELSE [r] END AS rows, NULL::VARCHAR AS warning FROM keys LEFT JOIN base USING (k)
  UNION ALL SELECT k, i, seq, list_sort(list_concat(rest, CASE WHEN kind = 'sign' THEN [{{'cid': 'override:' || slug, 'slug': slug, 'cap': cap, 'gtd': gtd, 'team': team, 'review': FALSE}}]
    WHEN kind = 'waive' THEN CASE WHEN even AND own[1].gtd > 0 THEN [{{'cid': 'dead:' || slug, 'slug': slug, 'cap': own[1].gtd, 'gtd': own[1].gtd, 'team': own[1].team, 'review': TRUE}}] ELSE [] END
    WHEN kind = 'trade' THEN list_transform(own, lambda r: {{'cid': r.cid, 'slug': r.slug, 'cap': r.cap, 'gtd': r.gtd, 'team': team, 'review': r.review}})
    WHEN even THEN list_transform(own, lambda r: {{'cid': r.cid, 'slug': other, 'cap': r.cap, 'gtd': r.gtd, 'team': r.team, 'review': r.review}})
    ELSE list_transform(own, lambda r: {{'cid': r.cid, 'slug': r.slug, 'cap': cap, 'gtd': r.gtd, 'team': r.team, 'review': r.review}}) END)),
   CASE WHEN kind = 'sign' THEN CASE WHEN len(own) > 0 THEN slug || ' was under contract with ' || own[1].team || ': the ' || team || ' deal takes its place' END
    WHEN len(own) = 0 THEN 'no row of ' || slug || ' to ' || kind
    WHEN kind = 'waive' AND own[1].team <> team THEN slug || ' is waived by ' || team || ' but held by ' || own[1].team || ', whose row goes' END
  FROM (SELECT s.*, list_filter(f.rows, lambda r: r.slug = s.slug) AS own, list_filter(f.rows, lambda r: r.slug <> s.slug) AS rest FROM fold f JOIN st s ON s.k = f.k AND s.i = f.i + 1)),
 ends AS (SELECT k, arg_max(rows, i) AS rows FROM fold GROUP BY 1)"""


def _renames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    base = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("contract_id"), F.lit("s").alias("season"), F.col("s_suppkey").cast("string").alias("bbref_slug"), F.col("s_name").alias("player"), F.lit("OLD").alias("team_abbrev"), F.lit(1).cast("short").alias("season_index"),
        cents("s_acctbal").alias("cap_hit"), cents("s_acctbal").alias("guaranteed"), F.lit(False).alias("is_guaranteed"), none.alias("option_type"), F.lit(False).alias("needs_review"), none.alias("review_reason"),
    )
    e, k, v, t = F.col("event_id"), F.get_json_object("props", "$.k"), cents("value"), F.col("event_type")
    kind = F.when(t == "signup", "sign").when(t == "error", "waive").when(t == "click", "trade").otherwise("amend")
    slug, other = F.when(e % 3 == 0, F.concat(F.lit("r"), k)).otherwise(k), F.when(e % 3 == 0, k).otherwise(F.concat(F.lit("r"), k))
    team = F.when(t == "click", F.concat(F.lit("T"), (e % 30).cast("string"))).when((t == "error") & (e % 5 == 0), "OLD").otherwise("NEW")
    steps = table(spark, d, "events").filter(t != "purchase").select(
        e.alias("seq"), F.lit(0).alias("leg"), kind.alias("kind"), slug.alias("bbref_slug"), slug.alias("player"), team.alias("team"), v.alias("cap_hit"), F.when(e % 4 == 0, F.floor(v / 2)).otherwise(v).alias("guaranteed"), (e % 2 == 0).alias("dead_money"),
        F.when(e % 2 == 0, "bbref_slug").otherwise("cap_hit").alias("field"), F.when(e % 2 == 0, other).otherwise(v.cast("string")).alias("value"), none.alias("note"), none.alias("as_of"),
    )
    return overlay.apply_transactions(base, steps, "s")


@query(_FOLD + " SELECT r.slug AS slug, r.cid AS contract_id, r.cap AS cap_hit, r.gtd AS guaranteed, r.team AS team, r.review AS needs_review FROM (SELECT unnest(rows) AS r FROM ends)")
def q73_overlay_renames(spark: SparkSession, d: str) -> DataFrame:
    frame, _ = _renames(spark, d)
    return frame.select(F.col("bbref_slug").alias("slug"), "contract_id", "cap_hit", "guaranteed", F.col("team_abbrev").alias("team"), "needs_review")


@query(_FOLD + " SELECT seq, warning FROM fold WHERE warning IS NOT NULL")
def q74_overlay_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _renames(spark, d)[1].select(F.col("warn_seq").alias("seq"), "warning")



_SIDES = "SELECT cast(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS game_id"


@query(f"""WITH s AS ({_SIDES}, event_type = 'view' AS away, {_K} AS team_id FROM events WHERE event_type IN ('view', 'click'))
 SELECT game_id, max(team_id) FILTER (NOT away) AS home_team_id, max(team_id) FILTER (away) AS away_team_id FROM s GROUP BY 1 HAVING count(*) FILTER (away) > 0 AND count(*) FILTER (NOT away) > 0""")
def q11_home_away(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("game_id"), F.lit("x").alias("season"), F.to_date("ts").alias("game_date"), F.when(F.col("event_type") == "view", "A @ B").otherwise("A vs. B").alias("matchup"), F.get_json_object("props", "$.k").cast("long").alias("team_id"), F.lit(0).alias("pts"),
    )
    return files.games_from_team_rows(rows).select("game_id", "home_team_id", "away_team_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders UNION ALL SELECT o_orderkey + 100000000, 'N', o_custkey FROM orders WHERE o_orderkey % 10 = 0")
def q12_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(o.filter("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_custkey"))
    return files.upsert(o, new, "o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def q13_unresolved(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("nba_player_id"), F.col("p_name").alias("full_name"), F.col("p_size").alias("to_year"))
    x = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("nba_player_id")).distinct().select("nba_player_id", F.lit("a").alias("bbref_slug"), F.lit("b").alias("spotrac_slug"))
    return identity.unresolved(p, x).select(F.col("nba_player_id").alias("p_partkey"), F.col("full_name").alias("p_name"))


@query("""SELECT event_id, cast(minute(ts) * 60 + second(ts) AS DOUBLE) AS clock, minute(ts) * 60 + second(ts) AS played, cast(minute(ts) * 60 + second(ts) AS INTEGER) AS played_iso, 'event_type_id' AS header,
 cast(json_extract_string(props, '$.k') AS INTEGER) AS k, substr(sha1(event_type || '|' || cast(user_id AS VARCHAR)), 1, 16) AS id, cast(round(value * 100) AS BIGINT) AS dollars FROM events""")
def q14_parsers(spark: SparkSession, d: str) -> DataFrame:
    m, s = F.minute("ts"), F.floor(F.second("ts")).cast("int")
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "props", "value", m.alias("m"), s.alias("s"))
    return e.select(
        "event_id", clock_seconds(F.format_string("PT%dM%02d.00S", "m", "s")).alias("clock"), minutes_to_seconds(F.format_string("%d:%02d", "m", "s")).alias("played"), minutes_to_seconds(F.format_string("PT%dM%d.00S", "m", "s")).alias("played_iso"), snake_case(F.lit("eventType-Id")).alias("header"),
        safe_int(F.get_json_object("props", "$.k")).alias("k"), short_hash(F.col("event_type"), F.col("user_id").cast("string")).alias("id"), strip_dollars(F.concat(F.lit("$"), F.format_number(cents("value"), 0))).alias("dollars"),
    )


@query("""SELECT p_partkey, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'jr', 'sr', 'ii', 'iii', 'iv', 'v')), ' ') AS name,
 list_extract(string_split_regex(lower(trim(p_name)), '\\s+'), -1) AS last FROM part""")
def q15_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", normalize_ascii("p_name").alias("name"), last_name("p_name").alias("last"))


@query("SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, event_id FROM events")
def q16_result_sets(spark: SparkSession, d: str) -> DataFrame:
    row = F.array(F.col("event_id").cast("string"), "event_type", F.get_json_object("props", "$.k"))
    sets = F.array(F.struct(F.lit("Other").alias("name"), F.array(F.lit("X")).alias("headers"), F.array(F.array(F.lit("0"))).alias("rowSet")), F.struct(F.lit("Events").alias("name"), F.array(F.lit("eventId"), F.lit("EVENT-TYPE"), F.lit("k")).alias("headers"), F.array("row").alias("rowSet")))
    p = table(spark, d, "events").select("user_id", row.alias("row")).select("user_id", F.to_json(F.struct(sets.alias("resultSets"))).alias("payload"))
    r = files.result_rows(p, "payload", "Events")
    f = F.col("fields")
    return r.select("user_id", f["event_type"].alias("event_type"), f["k"].alias("k"), f["event_id"].cast("long").alias("event_id"))


def _pbp(spark: SparkSession, d: str) -> DataFrame:
    """Events as play-by-play: four days of a user are a game, a day is a quarter of 720 s."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts")).cast("int")
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.col("event_type")
    return table(spark, d, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(day / 4).cast("string")).alias("game_id"), F.col("event_id").cast("int").alias("event_num"), (day % 4 + 1).cast("short").alias("period"), (F.lit(720.0) - sec / 120.0).alias("clock_seconds_left"),
        F.when(t.isin("signup", "error"), "Substitution").when(t == "purchase", "Made Shot").when(t == "click", "Turnover").otherwise("Rebound").alias("event_type"), F.when(t == "view", "Offensive").alias("event_action_type"),
        F.when(F.col("value") > 50, "3PT jumper").otherwise("layup").alias("description"), (k % 2 + 1).alias("team_id"), F.when(t != "signup", k).alias("player1_id"), F.when(t == "signup", k).alias("player2_id"), F.lit(None).cast("long").alias("player3_id"),
    )


_PBP = f"""ev AS (SELECT cast(user_id AS VARCHAR) || '-' || (date_diff('day', DATE '2020-01-01', cast(ts AS DATE)) // 4) AS game_id, event_id, date_diff('day', DATE '2020-01-01', cast(ts AS DATE)) % 4 + 1 AS period,
 720.0::DOUBLE - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 120.0::DOUBLE AS clk, event_type, value, {_K} AS k FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY game_id, period ORDER BY clk DESC NULLS FIRST, event_id) AS pos, 720.0::DOUBLE - clk AS t FROM ev),
 opener AS (SELECT game_id, period, k FROM (SELECT game_id, period, k, min(pos) FILTER (event_type <> 'signup') AS seen, min(pos) FILTER (event_type = 'signup') AS entered FROM o GROUP BY ALL) WHERE seen IS NOT NULL AND (entered IS NULL OR seen < entered))"""
_STINT = _PBP + """, tog AS (SELECT game_id, period, k, 0 AS q, 1 AS a FROM opener UNION ALL SELECT game_id, period, k, 2 * pos, 0 FROM o WHERE event_type = 'error' UNION ALL SELECT game_id, period, k, 2 * pos + 1, 1 FROM o WHERE event_type = 'signup'),
 iv AS (SELECT * FROM (SELECT *, lead(q) OVER (PARTITION BY game_id, period, k ORDER BY q) AS q2 FROM tog) WHERE a = 1),
 fin AS (SELECT game_id, period, 2 * pos AS e, t FROM o WHERE event_type IN ('signup', 'error') UNION ALL SELECT DISTINCT game_id, period, 1099511627776, 720.0 FROM o),
 st AS (SELECT *, greatest(coalesce(max(t) OVER (PARTITION BY game_id, period ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS s FROM fin),
 live AS (SELECT *, row_number() OVER (PARTITION BY game_id, period ORDER BY e) AS stint_no FROM st WHERE t > s),
 full_st AS (SELECT live.game_id, live.period, live.stint_no, live.s, live.t AS en, coalesce(string_agg(DISTINCT cast(iv.k AS VARCHAR), ',' ORDER BY cast(iv.k AS VARCHAR)), '') AS lineup FROM live LEFT JOIN iv ON live.game_id = iv.game_id AND live.period = iv.period AND iv.q < live.e AND (iv.q2 IS NULL OR live.e <= iv.q2) GROUP BY ALL)"""


@query(f"SELECT CASE event_type WHEN 'signup' THEN 'Substitution' WHEN 'error' THEN 'Substitution' WHEN 'purchase' THEN 'Made Shot' WHEN 'click' THEN 'Turnover' ELSE 'Rebound' END AS event_type, {_K} AS player_id, count(*) AS n FROM events WHERE {_K} NOT IN (SELECT n_nationkey FROM nation) GROUP BY ALL")
def q17_phantom_audit(spark: SparkSession, d: str) -> DataFrame:
    return lineups.phantom_audit(_pbp(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nba_player_id")))


@query(f"WITH {_PBP} SELECT game_id, cast(period AS SMALLINT) AS period, k AS player_id FROM opener")
def q18_openers(spark: SparkSession, d: str) -> DataFrame:
    return lineups.openers(lineups.ordered_events(_pbp(spark, d)))


@query(f"WITH {_STINT} SELECT game_id, cast(period AS SMALLINT) AS period, cast(stint_no AS INTEGER) AS stint_no, round(s, 4) AS start_s, round(en, 4) AS end_s, lineup FROM full_st")
def q19_stints(spark: SparkSession, d: str) -> DataFrame:
    s = lineups.reconstruct_stints(_pbp(spark, d))
    names = F.array_join(F.array_sort(F.transform("lineup", lambda x: x.cast("string"))), ",")
    return s.select("game_id", "period", "stint_no", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"), names.alias("lineup"))


_GATE = _STINT + """, sec AS (SELECT game_id, unnest(string_split(lineup, ',')) AS k, en - s AS x FROM full_st WHERE lineup <> ''), rec AS (SELECT game_id, cast(k AS BIGINT) AS k, sum(x) AS r FROM sec GROUP BY ALL),
 box AS (SELECT game_id, k, count(*) * 200.0 AS b FROM ev GROUP BY ALL),
 gate AS (SELECT coalesce(rec.game_id, box.game_id) AS game_id, coalesce(rec.k, box.k) AS k, coalesce(r, 0) AS r, coalesce(b, 0) AS b FROM rec FULL JOIN box ON rec.game_id = box.game_id AND rec.k = box.k)"""


def _box(spark: SparkSession, d: str) -> DataFrame:
    e = _pbp(spark, d).select("game_id", F.coalesce("player1_id", "player2_id").alias("nba_player_id"))
    return e.groupBy("game_id", "nba_player_id").agg((F.count("*") * 200).cast("int").alias("seconds_played")).withColumn("nba_team_id", F.col("nba_player_id") % 2 + 1)


def _gate(spark: SparkSession, d: str) -> DataFrame:
    return lineups.minutes_gate(lineups.player_seconds(lineups.reconstruct_stints(_pbp(spark, d))), _box(spark, d))


@query(f"WITH {_GATE} SELECT game_id, k AS player_id, round(r, 3) AS recon_s, cast(b AS DOUBLE) AS box_s, abs(r - b) > 90 AS offends FROM gate")
def q20_minutes_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select("game_id", "player_id", F.round("recon_s", 3).alias("recon_s"), "box_s", "offends")


@query(f"""WITH {_GATE}, cat AS (SELECT game_id, NOT bool_or(abs(r - b) > 90) AS ok, bool_and(abs(r - b) <= 90 OR r = 0) AS gap FROM gate GROUP BY 1), g AS (SELECT cat.*, 's' || right(game_id, 1) AS season FROM cat)
 SELECT season, count(*) AS n_games, count(*) FILTER (ok) AS n_included, count(*) FILTER (NOT ok AND gap) AS n_gap, count(*) FILTER (NOT ok AND NOT gap) AS n_isolated FROM g GROUP BY ROLLUP (season)""")
def q21_gate_accounting(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.lit(-1).cast("long").alias("nba_player_id"), F.col("n_name").alias("full_name"))
    g = _gate(spark, d)
    r = lineups.gate_results(g, _box(spark, d), names)
    games = r.select("game_id", F.concat(F.lit("s"), F.right("game_id", F.lit(1))).alias("season"))
    return lineups.gate_accounting(r, games).select("season", "n_games", "n_included", "n_gap", "n_isolated")


@query(f"""WITH {_STINT} SELECT game_id, cast(period AS SMALLINT) AS period, cast(stint_no AS INTEGER) AS stint_no, k % 2 + 1 AS team_id, count(*) FILTER (event_type = 'purchase') AS fga, count(*) FILTER (event_type = 'view') AS oreb, count(*) FILTER (event_type = 'click') AS tov,
 cast(coalesce(sum(CASE WHEN value > 50 THEN 3 ELSE 2 END) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS pts FROM o JOIN full_st f USING (game_id, period) WHERE o.t >= f.s AND o.t < f.en GROUP BY ALL""")
def q22_stint_tally(spark: SparkSession, d: str) -> DataFrame:
    e = _pbp(spark, d)
    return possessions.tally_by_stint(e, lineups.reconstruct_stints(e)).drop("fta")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as blocks: supplier on offence against brand, price per unit as efficiency."""
    p = table(spark, d, "part").select("p_partkey", F.substring_index("p_brand", "#", -1).cast("long").alias("brand"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("game_id"), F.array(F.col("l_suppkey") + 1000).alias("offense"), F.array(F.col("brand")).alias("defense"), (F.col("l_extendedprice") / 100).alias("points"), F.col("l_quantity").alias("possessions")
    )


_COO = """WITH b AS (SELECT l_orderkey, l_suppkey + 1000 AS o, cast(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS df, l_extendedprice / l_quantity AS y, l_quantity AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 1),
 c AS (SELECT l_orderkey, y, w, o AS player_id, FALSE AS defense, 1.0 AS x FROM b UNION ALL SELECT l_orderkey, y, w, df, TRUE, -1.0 FROM b)"""


@query(_COO + " SELECT player_id, defense, count(*) AS n, round(sum(w * x * y) / 1000, 2) AS xwy, round(sum(w * x), 3) AS xw FROM c GROUP BY ALL")
def q24_design(spark: SparkSession, d: str) -> DataFrame:
    c = ratings.design_coo(ratings.design_rows(_blocks(spark, d)))
    return c.groupBy("player_id", "defense").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("x") * F.col("y")) / 1000, 2).alias("xwy"), F.round(F.sum(F.col("w") * F.col("x")), 3).alias("xw"))


@query(_COO + ", t AS (SELECT w, 2 * o AS i, 2 * df + 1 AS j FROM b) SELECT least(i, j) AS i, greatest(i, j) AS j, round(sum(-w), 3) AS g FROM t GROUP BY ALL UNION ALL SELECT i, i, round(sum(w), 3) FROM t GROUP BY i UNION ALL SELECT j, j, round(sum(w), 3) FROM t GROUP BY j")
def q25_gram(spark: SparkSession, d: str) -> DataFrame:
    return ratings.pair_sums(ratings.design_rows(_blocks(spark, d)).withColumn("fold", F.lit(0))).select("i", "j", F.round("g", 3).alias("g"))


# Two players a supplier take turns on offence, so the normal equations fall into pairs that meet only in the intercept:
# with w, t the possessions and points of a pair's side, its rating is (t - c w) / (2 w + penalty).
_GREEDY = """WITH RECURSIVE b AS (SELECT l_orderkey, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 3))::INTEGER AS bucket, 2 * l_suppkey + l_linenumber % 2 AS o, 2 * l_suppkey + 1 - l_linenumber % 2 AS df,
  l_extendedprice / l_quantity AS y, l_quantity AS w FROM lineitem WHERE l_quantity >= 1),
 sizes AS (SELECT bucket, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, bucket) AS k FROM b GROUP BY 1),
 deal AS (SELECT 0::BIGINT AS k, -1 AS bucket, -1 AS fold, list_transform(range(least(5, (SELECT count(*) FROM sizes))), lambda z: 0::BIGINT) AS load
  UNION ALL SELECT k, bucket, spot - 1, list_transform(load, lambda x, p: CASE WHEN p = spot THEN x + n ELSE x END)
  FROM (SELECT s.k, s.bucket, s.n, load, list_position(load, list_min(load)) AS spot FROM deal JOIN sizes s ON s.k = deal.k + 1)),
 rows AS MATERIALIZED (SELECT b.*, fold FROM b JOIN deal USING (bucket) WHERE fold >= 0),
 own AS (SELECT o, df, fold, sum(w) AS w, sum(w * y) AS t FROM rows GROUP BY ALL),
 allp AS (SELECT o, df, sum(w) AS w, sum(t) AS t FROM own GROUP BY ALL), nf AS (SELECT unnest(range((SELECT count(DISTINCT fold) FROM own))) AS fold),
 grid AS (SELECT unnest([100.0, 300, 1000, 2000, 3000, 5000, 8000, 15000, 30000]::DOUBLE[]) AS lam),
 tr AS (SELECT a.o, a.df, nf.fold, a.w - coalesce(own.w, 0) AS w, a.t - coalesce(own.t, 0) AS t FROM allp a CROSS JOIN nf LEFT JOIN own ON own.o = a.o AND own.fold = nf.fold),
 cut AS (SELECT fold, lam, (sum(t) - sum(2 * w * t / (2 * w + lam))) / (sum(w) - sum(2 * w * w / (2 * w + lam))) AS c FROM tr, grid GROUP BY ALL),
 errors AS (SELECT lam, fold, sum(r.w * (y - c - 2 * (tr.t - c * tr.w) / (2 * tr.w + lam)) ** 2) / sum(r.w) AS e FROM rows r JOIN tr USING (o, fold) JOIN cut USING (fold) GROUP BY ALL),
 scores AS (SELECT lam, avg(e) AS score FROM errors GROUP BY 1),
 best AS (SELECT lam FROM scores ORDER BY score, lam LIMIT 1),
 mid AS (SELECT lam, (sum(t) - sum(2 * w * t / (2 * w + lam))) / (sum(w) - sum(2 * w * w / (2 * w + lam))) AS c FROM allp, best GROUP BY lam),
 half AS (SELECT o, df, w, t, lam, (t - c * w) / (2 * w + lam) AS r FROM allp, mid),
 plain AS (SELECT player_id, sum(off) AS offense, sum(def) AS defense, sum(w) AS possessions FROM (SELECT o AS player_id, r AS off, 0 AS def, w FROM half UNION ALL SELECT df, 0, -r, w FROM half) GROUP BY 1)"""
_VALUED = "round(offense, 5) AS offense, round(defense, 5) AS defense, round(offense + defense, 5) AS total, round(possessions, 2) AS possessions, round((offense + defense + 2.5) * possessions / 100, 3) AS value, round((offense + defense + 2.5) * possessions / 3000, 4) AS wins_added"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.array((2 * F.col("l_suppkey") + k).cast("long"))
    odd, li = F.col("l_linenumber") % 2, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").cast("string").alias("game_id"), side(odd).alias("offense"), side(1 - odd).alias("defense"), (F.col("l_extendedprice") / 100).alias("points"), F.col("l_quantity").cast("double").alias("possessions"))


def _rounded(r: DataFrame) -> DataFrame:
    return r.select("player_id", *(F.round(c, n).alias(c) for c, n in (("offense", 5), ("defense", 5), ("total", 5), ("possessions", 2), ("value", 3), ("wins_added", 4))))


@query(_GREEDY + f" SELECT player_id::BIGINT AS player_id, {_VALUED} FROM plain")
def q26_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ratings.fit_ratings(spark, _turns(spark, d))[0])


@query(_GREEDY + " SELECT lam AS lambda, round(score / 1000, 6) AS score, lam = (SELECT lam FROM best) AS chosen FROM scores")
def q27_cv_scores(spark: SparkSession, d: str) -> DataFrame:
    design = ratings.design_rows(_turns(spark, d))
    lam, scores = ratings.choose_lambda(spark, ratings.moments(design, ratings.balanced_folds(design)))
    return spark.createDataFrame([(x, round(s / 1000, 6), x == lam) for x, s in zip(ratings.LAMBDAS, scores, strict=True)], "lambda double, score double, chosen boolean")


# the prior's models: two standardised features for offence, one for defence, on the reliable players' plain ratings
_PRIOR = """,
 box AS (SELECT 2 * s_suppkey + k AS player_id, s_acctbal + 500 * k AS f1, (s_nationkey + k * (s_suppkey % 7))::DOUBLE AS f2, s_acctbal + 2000 AS poss FROM supplier, (SELECT unnest([0, 1]) AS k)),
 fitrows AS (SELECT f1, f2, offense AS yo, defense AS yd FROM box JOIN plain USING (player_id) WHERE poss >= 1000),
 st AS (SELECT count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, stddev_pop(f1) AS d1, stddev_pop(f2) AS d2, avg(yo) AS mo, avg(yd) AS md FROM fitrows),
 zs AS (SELECT (f1 - m1) / d1 AS z1, (f2 - m2) / d2 AS z2, yo - mo AS yo, yd - md AS yd FROM fitrows, st),
 g AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 1 AS c, sum(z1 * yo) AS p, sum(z2 * yo) AS q, sum(z1 * yd) AS r FROM zs),
 mu AS (SELECT player_id, mo + ((c * p - b * q) * (f1 - m1) / d1 + (a * q - b * p) * (f2 - m2) / d2) / (a * c - b * b) AS mo, md + r / a * (f1 - m1) / d1 AS md FROM box, st, g),
 sh AS (SELECT o, df, w, lam, coalesce(mo.mo, 0) AS mo, coalesce(md.md, 0) AS md, t - w * (coalesce(mo.mo, 0) - coalesce(md.md, 0)) AS t FROM half LEFT JOIN mu mo ON mo.player_id = o LEFT JOIN mu md ON md.player_id = df),
 mid2 AS (SELECT (sum(t) - sum(2 * w * t / (2 * w + lam))) / (sum(w) - sum(2 * w * w / (2 * w + lam))) AS c FROM sh),
 half2 AS (SELECT o, df, w, mo + (t - c * w) / (2 * w + lam) AS off, md - (t - c * w) / (2 * w + lam) AS def FROM sh, mid2),
 bayes AS (SELECT player_id, sum(off) AS offense, sum(def) AS defense, sum(w) AS possessions FROM (SELECT o AS player_id, off, 0 AS def, w FROM half2 UNION ALL SELECT df, 0, def, w FROM half2) GROUP BY 1)"""


@query(_GREEDY + _PRIOR + f" SELECT player_id::BIGINT AS player_id, {_VALUED} FROM bayes")
def q28_prior_ridge(spark: SparkSession, d: str) -> DataFrame:
    design = ratings.design_rows(_turns(spark, d))
    m = ratings.moments(design, ratings.balanced_folds(design))
    plain, facts = ratings.fit_moments(spark, m)
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    box = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", k.alias("k")).select(
        (2 * F.col("s_suppkey") + F.col("k")).cast("long").alias("player_id"), (F.col("s_acctbal") + 500 * F.col("k")).alias("pts_100"),
        (F.col("s_nationkey") + F.col("k") * (F.col("s_suppkey") % 7)).cast("double").alias("ast_100"), *((F.col("s_acctbal") + 2000).alias(c) for c in ("off_possessions", "def_possessions")),
    )
    mu = ratings.box_score_prior(plain, box, ["pts_100", "ast_100"], ["pts_100"])
    return _rounded(ratings.fit_moments(spark, m, fixed=facts["lambda"], prior=mu)[0])


_VALUE = """WITH e AS (SELECT l_suppkey AS player_id, sum(l_extendedprice) / sum(l_quantity) / 100 AS total, sum(l_quantity) AS possessions FROM lineitem GROUP BY 1), v AS (SELECT *, (total + 2.5) * possessions / 100 AS value FROM e)"""


def _value(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("player_id")).agg((F.sum("l_extendedprice") / F.sum("l_quantity") / 100).alias("total"), F.sum("l_quantity").alias("possessions"))
    return ratings.with_value(e)


@query(_VALUE + " SELECT player_id, round(total, 4) AS total, round(value, 2) AS value, round(value / 30, 4) AS wins_added, row_number() OVER (ORDER BY round(value, 6) DESC, player_id) AS rank FROM v")
def q29_value_rank(spark: SparkSession, d: str) -> DataFrame:
    v = ratings.ranked(_value(spark, d).withColumn("by", F.round("value", 6)), "by", "player_id")
    return v.select("player_id", F.round("total", 4).alias("total"), F.round("value", 2).alias("value"), F.round("wins_added", 4).alias("wins_added"), "rank")


@query("""WITH b AS (SELECT l_suppkey + 1000 AS o, cast(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS df, l_extendedprice / 100 AS pts, l_quantity AS w FROM lineitem JOIN part ON l_partkey = p_partkey), tot AS (SELECT sum(pts) AS p, sum(w) AS w FROM b),
 d AS (SELECT df AS id, sum(pts) AS p, sum(w) AS w FROM b GROUP BY 1), x AS (SELECT d.id, d.p, d.w, tot.p - d.p AS op, tot.w - d.w AS ow FROM d, tot UNION ALL SELECT o, 0, 0, tot.p - sum(b.pts), tot.w - sum(b.w) FROM b, tot GROUP BY o, tot.p, tot.w)
 SELECT id AS player_id, round(CASE WHEN w > 1e-9 THEN 100 * p / w ELSE 0 END, 3) AS on_per_100, round(CASE WHEN ow > 1e-9 THEN 100 * op / ow ELSE 0 END, 3) AS off_per_100 FROM x""")
def q30_on_off(spark: SparkSession, d: str) -> DataFrame:
    return possessions.on_off_defense(_blocks(spark, d)).select("player_id", F.round("on_per_100", 3).alias("on_per_100"), F.round("off_per_100", 3).alias("off_per_100"))


_SEASONS = "se AS (SELECT o_custkey AS player_id, year(o_orderdate) AS age, avg(o_totalprice) / 1000 AS r, count(*)::DOUBLE AS w FROM orders GROUP BY ALL)"
_DELTA = f"WITH {_SEASONS}, d AS (SELECT player_id, age, r2 - r AS delta, least(w, w2) AS weight FROM (SELECT *, lead(age) OVER p AS a2, lead(r) OVER p AS r2, lead(w) OVER p AS w2 FROM se WINDOW p AS (PARTITION BY player_id ORDER BY age)) WHERE a2 = age + 1), cv AS (SELECT age, sum(weight * delta) / sum(weight) AS delta FROM d GROUP BY 1)"


def _seasons(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("player_id"), y.alias("age")).agg((F.avg("o_totalprice") / 1000).alias("rating"), F.count("*").cast("double").alias("weight")).withColumn("season", F.col("age").cast("string"))


@query(_DELTA + " SELECT player_id, cast(age AS INTEGER) AS age, round(delta, 3) AS delta, weight FROM d")
def q31_deltas(spark: SparkSession, d: str) -> DataFrame:
    return aging.player_deltas(_seasons(spark, d), "rating", "weight").withColumn("delta", F.round("delta", 3))


@query(_DELTA + """, m AS (SELECT min(age) + 2 AS a FROM cv) SELECT cast(age AS INTEGER) AS age, round(value, 5) AS value FROM (SELECT age + 1 AS age, sum(delta) OVER (ORDER BY age) AS value FROM cv, m WHERE age >= a UNION ALL SELECT age, -sum(delta) OVER (ORDER BY age DESC) FROM cv, m WHERE age < a UNION ALL SELECT a, 0 FROM m)""")
def q32_cumulative_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = aging.league_delta_curve(aging.player_deltas(_seasons(spark, d), "rating", "weight"))
    return aging.cumulative_curve(curve, int(curve.agg(F.min("age")).first()[0]) + 2).select("age", F.round("value", 5).alias("value"))


@query("SELECT round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd, count(*) AS n FROM customer")
def q33_standardize(spark: SparkSession, d: str) -> DataFrame:
    s = ratings.feature_stats(table(spark, d, "customer"), ["c_acctbal"], "c_acctbal")
    return s.select(F.round("m_c_acctbal", 4).alias("mean"), F.round("s_c_acctbal", 4).alias("sd"), "n")


@query()
def q34_projection(spark: SparkSession, d: str) -> DataFrame:
    """A posterior for a panel of nation and segment over the years of all orders."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 10).cast("long").alias("player_id"), F.concat(F.lit("g"), (F.col("c_nationkey") % 3).cast("string")).alias("position_group"))
    s = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("player_id", "position_group", F.year("o_orderdate").alias("age")).agg((F.avg("o_totalprice") / 1000).alias("rating"), F.count("*").cast("double").alias("weight"))
    lo = int(s.agg(F.min("age")).first()[0])
    off = aging.fit_hierarchy(s, "rating", "weight", anchor=lo + 2)
    de = aging.fit_hierarchy(s, "rating", "weight", anchor=lo + 2, seed=1)
    return aging.project_players(off, de, s.groupBy("player_id").agg(F.lit(lo + 1).alias("age")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q35_top_orders(spark: SparkSession, d: str) -> DataFrame:
    return files.rows_where(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20)


@query(_VALUE + " SELECT player_id, s_name AS name, round(total, 4) AS total, round(value, 2) AS value FROM v JOIN supplier ON player_id = s_suppkey WHERE trim(s_name) <> ''")
def q36_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("nba_player_id"), F.col("s_name").alias("full_name"))
    return files.leaderboard_rows(_value(spark, d), names).select("player_id", "name", F.round("total", 4).alias("total"), F.round("value", 2).alias("value"))


@query("SELECT user_id, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(quantile_cont(value, 0.1), 4) AS lower_80, round(quantile_cont(value, 0.9), 4) AS upper_80 FROM events GROUP BY 1")
def q37_posterior_summary(spark: SparkSession, d: str) -> DataFrame:
    s = aging.posterior_summary(table(spark, d, "events").select("user_id", "value"), "user_id")
    return s.select("user_id", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "lower_80", "upper_80")))


@query()
def q38_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    players = table(spark, d, "supplier").select(F.col("s_suppkey").alias("nba_player_id"), F.col("s_name").alias("full_name"))
    other = table(spark, d, "customer").select(F.regexp_replace("c_name", "Customer", "Supplier").alias("full_name"), F.col("c_custkey").cast("string").alias("slug"))
    return identity.build_crosswalk(players, other, None, None)


# accents on letters, a suffix that goes, a ligature of two letters
@query("""SELECT c_custkey, trim(regexp_replace(lower(strip_accents(replace(translate(c_name, 'ouC', 'ôüÇ'), 'm', 'ḿ'))), '[^a-z0-9]+', ' ', 'g')) || CASE WHEN c_nationkey % 3 = 1 THEN ' finn' ELSE '' END AS name FROM customer""")
def q39_normalize_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.regexp_replace(F.translate("c_name", "ouC", "ôüÇ"), "m", "m\u0301"), F.when(F.col("c_nationkey") % 3 == 0, " Jr.").when(F.col("c_nationkey") % 3 == 1, " \ufb01nn").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", normalize_name(raw).alias("name"))


@query("SELECT event_id, CASE WHEN value >= 1 THEN cast(round(cast(round(value, 2) AS DECIMAL(18,2)) * 1000000) AS BIGINT) ELSE cast(floor(value) AS BIGINT) END AS amount FROM events")
def q40_parse_millions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    text = F.when(v >= 1, F.concat(F.lit("$"), F.round(v, 2).cast("decimal(18,2)").cast("string"), F.lit("M"))).otherwise(F.floor(v).cast("string"))
    return table(spark, d, "events").select("event_id", parse_dollars(text).alias("amount"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Play-by-play to stints to tallies to ranked value, in one plan."""
    e = _pbp(spark, d)
    t = possessions.tally_by_stint(e, lineups.reconstruct_stints(e)).withColumn("poss", possessions.possessions(F.col("fga"), F.col("oreb"), F.col("tov"), F.col("fta")))
    r = t.filter("poss > 0").groupBy("team_id", "period").agg((100 * F.sum("pts") / F.sum("poss")).alias("total"), F.sum("poss").alias("possessions"))
    return ratings.with_value(r).orderBy(F.desc("value"), "team_id", "period")
