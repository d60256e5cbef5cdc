"""Goldens of the scalar functions and the trade rules."""

import pytest
from pyspark.sql import functions as F

from courtside.functions import money, names, parsing
from courtside.operators import trade


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(expr.alias("x")).first().x


def test_minutes_and_clocks_of_all_spellings(spark):
    """Seconds written every way a feed writes them come back; the rest is unknown, not zero."""
    rows = [(m, s, f"{m}:{s:02d}", f"PT{m}M{s}.00S", f" PT{m:02d}M{s:02d}.00S ") for m in (0, 1, 7, 19, 53) for s in (0, 1, 29, 59)]
    df = spark.createDataFrame(rows, "m int, s int, colon string, iso string, padded string")
    got = df.select((F.col("m") * 60 + F.col("s")).alias("want"), *(f(c).alias(f"{f.__name__}_{c}") for f in (parsing.minutes_to_seconds, parsing.clock_seconds) for c in ("colon", "iso", "padded"))).collect()
    assert len(got) == 20 and all(set(r) == {r.want} for r in got)
    odd = spark.createDataFrame([(x,) for x in (None, "", "  ", "7", "7:5:3", "M7", "PT", "PT3M", "PT8.50S", "PT1M9.50S", "PT2M0.25S")], "x string")
    minutes = {r.x: r.v for r in odd.select("x", parsing.minutes_to_seconds("x").alias("v")).collect()}
    clock = {r.x: r.v for r in odd.select("x", parsing.clock_seconds("x").alias("v")).collect()}
    assert minutes == {None: None, "": 0, "  ": 0, "7": None, "7:5:3": None, "M7": None, "PT": None, "PT3M": 180, "PT8.50S": 8, "PT1M9.50S": 70, "PT2M0.25S": 120}
    assert clock == {None: None, "": None, "  ": None, "7": None, "7:5:3": None, "M7": None, "PT": 0.0, "PT3M": 180.0, "PT8.50S": 8.5, "PT1M9.50S": 69.5, "PT2M0.25S": 120.25}


def test_money(spark):
    assert one(spark, money.pct_of(F.lit(9_999_999), "110")) == 10_999_999
    assert one(spark, money.parse_dollars(F.lit("$1.35M"))) == 1_350_000
    assert one(spark, money.strip_dollars(F.lit("$7,654,321"))) == 7_654_321
    assert one(spark, money.strip_dollars(F.lit(" "))) is None
    assert one(spark, money.dollars(F.lit(-5))) == "$-5"
    with pytest.raises(Exception, match="empty amount"):
        one(spark, money.parse_dollars(F.lit("")))


def test_names_lose_accents_marks_and_suffixes(spark):
    given = {"José": "jose", "Bo-Bo": "bo bo", "O.T.": "o t", "ŽAN": "zan", "D'Ax": "d ax"}
    family = {"Ruíz": "ruiz", "Ōno": "ono", "VON Ek": "von ek"}
    rows = [(f"{a}  {b}{suffix}", f"{x} {y}") for a, x in given.items() for b, y in family.items() for suffix in ("", " Jr.", " II", " iv", " Sr")]
    df = spark.createDataFrame(rows, "raw string, want string")
    got = df.select("want", names.normalize_name("raw").alias("got"), names.last_name("raw").alias("last"), "raw").collect()
    assert len(got) == 75 and all(r.got == r.want for r in got)
    assert {r.last for r in got} == {"ruíz", "ōno", "ek"}
    assert one(spark, names.last_name(F.lit("Jr."))) == "jr."


def test_ceiling(spark):
    """The ceiling joins at neither edge of a band: twice and a quarter million, flat, then five quarters and a quarter."""
    low, high = trade.BAND_1, trade.BAND_2
    rows = [(low - 2, 2 * (low - 2) + 250_000), (low, 2 * low + 250_000), (low + 1, low + 1 + 7_500_000), (high, high + 7_500_000), (high + 4, (high + 4) * 5 // 4 + 250_000)]
    got = spark.createDataFrame(rows, "s long, want long").select("s", "want", trade.matching_ceiling(F.col("s"), F.lit(True)).alias("below"), trade.matching_ceiling(F.col("s"), F.lit(False)).alias("over")).collect()
    assert all(r.below == r.want and r.over == r.s for r in got)


def test_missing_sheet_and_rollup(spark):
    pieces = spark.createDataFrame([("t", "A", "B", 20_000_000, 0), ("t", "B", "A", 60_000_000, 0)], "trade_id string, from_team string, to_team string, cap_hit long, incentives_likely long")
    sheets = spark.createDataFrame([("A", 180_000_000, True)], "team string, apron_payroll long, certain boolean")
    v = {r.team: r for r in trade.trade_verdicts(pieces, sheets, trade.LEAGUE_YEARS["2026-27"]).collect()}
    assert v["B"].severity == "INDETERMINATE" and v["B"].reason == "no cap sheet supplied for B"
    assert v["A"].severity == "ILLEGAL"
    assert trade.trade_rollup(trade.trade_verdicts(pieces, sheets, trade.LEAGUE_YEARS["2026-27"])).first().severity == "ILLEGAL"


def test_request_key_ignores_order():
    assert parsing.request_key("a", {"x": 1, "y": 2}) == parsing.request_key("a", {"y": 2, "x": 1})
