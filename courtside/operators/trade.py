"""Cap sheets and salary-matching verdicts, for any number of proposals in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import grouped, pct_of

#: fixed values: thresholds of a league year, in dollars
LEAGUE_YEARS = {
    "2026-27": {"salary_cap": 164_961_000, "min_team_salary": 148_465_000, "tax_level": 200_428_000, "first_apron": 209_015_000, "second_apron": 221_686_000, "non_taxpayer_mle": 15_044_000, "taxpayer_mle": 6_064_000, "room_mle": 9_366_000, "bae": 5_285_000, "expanded_tpe": 9_096_000, "rookie_min": 1_357_763, "two_way_salary": 678_882, "max_roster": 15, "min_roster": 14},
    "2025-26": {"salary_cap": 154_647_000, "min_team_salary": 139_182_000, "tax_level": 187_895_000, "first_apron": 195_945_000, "second_apron": 207_824_000, "non_taxpayer_mle": 14_104_000, "taxpayer_mle": 5_685_000, "room_mle": 8_781_000, "bae": 5_134_000, "expanded_tpe": 8_527_000, "rookie_min": 1_272_870, "two_way_salary": 636_435, "max_roster": 15, "min_roster": 14},
}
#: fixed values: the bands of the matching rule
BAND_1, BAND_2, FLAT, ALLOWANCE, NEAR_LINE = 7_500_000, 29_000_000, 7_500_000, 250_000, 5_000_000
#: fixed values: bands and the rules they cite
RULES = {
    "over_apron_100pct": "CBA VII(k): over-apron 100% match",
    "band1_200pct+250k": "CBA VII(k)(1): S<=$7.5M",
    "band2_S+7.5M": "CBA VII(k)(2): $7.5M<S<=$29M",
    "band3_125pct+250k": "CBA VII(k)(3): S>$29M",
}


def apron_status(payroll: Column, year: dict[str, int]) -> Column:
    return (
        F.when(payroll >= year["second_apron"], "over_second_apron").when(payroll >= year["first_apron"], "between_aprons").when(payroll >= year["tax_level"], "taxpayer").when(payroll >= year["salary_cap"], "over_cap").otherwise("under_cap")
    )


def matching_band(out: Column, below: Column) -> Column:
    return F.when(~below, "over_apron_100pct").when(out <= BAND_1, "band1_200pct+250k").when(out <= BAND_2, "band2_S+7.5M").otherwise("band3_125pct+250k")


def matching_ceiling(out: Column, below: Column) -> Column:
    """Most salary that may come back for ``out``."""
    return F.when(~below, out).when(out <= BAND_1, pct_of(out, "200") + ALLOWANCE).when(out <= BAND_2, out + FLAT).otherwise(pct_of(out, "125") + ALLOWANCE)


def cap_sheets(years: DataFrame, season: str) -> DataFrame:
    """Per team cap and apron payroll, roster count without dead rows, and whether nothing is in doubt."""
    likely = F.col("incentives_likely") if "incentives_likely" in years.columns else F.lit(0).cast("long")
    return years.filter(F.col("season") == season).groupBy(F.col("team_abbrev").alias("team")).agg(
        F.sum("cap_hit").alias("cap_payroll"), F.sum(F.col("cap_hit") + likely).alias("apron_payroll"), F.count_if(~F.col("needs_review")).alias("roster_count"), (F.count_if(F.col("needs_review")) == 0).alias("certain")
    )


def roster_report(sheets: DataFrame, year: dict[str, int]) -> DataFrame:
    n = F.col("roster_count")
    return sheets.withColumn("status", apron_status(F.col("apron_payroll"), year)).withColumn("roster_flag", F.when(n > year["max_roster"], "over").when(n < year["min_roster"], "under").otherwise("ok"))


def trade_verdicts(pieces: DataFrame, sheets: DataFrame, year: dict[str, int]) -> DataFrame:
    """Pieces (trade_id, from_team, to_team, cap_hit, incentives_likely) -> a verdict per trade and team.

    Every piece becomes an outgoing and an incoming leg, legs are added up by team, and one left join brings the
    sheets; all rules are columns. A team without a sheet is INDETERMINATE.
    """
    side = lambda team, sign: F.struct(F.col(team).alias("team"), F.lit(sign).alias("sign"))
    legs = pieces.select("trade_id", "cap_hit", "incentives_likely", F.explode(F.array(side("from_team", -1), side("to_team", 1))).alias("leg")).select("trade_id", "cap_hit", "incentives_likely", "leg.*")
    zero = F.lit(0).cast("long")
    sums = legs.groupBy("trade_id", "team").agg(
        F.coalesce(F.sum(F.when(F.col("sign") < 0, F.col("cap_hit"))), zero).alias("outgoing"), F.coalesce(F.sum(F.when(F.col("sign") > 0, F.col("cap_hit"))), zero).alias("incoming"),
        F.bool_or((F.col("sign") > 0) & (F.coalesce("incentives_likely", zero) == 0)).alias("hidden"),
    )
    j = sums.join(sheets.select("team", "apron_payroll", "certain"), "team", "left")
    j = j.withColumn("post", F.col("apron_payroll") + F.col("incoming") - F.col("outgoing")).withColumn("below", F.col("post") < year["first_apron"])
    j = j.withColumn("ceiling", matching_ceiling(F.col("outgoing"), F.col("below"))).withColumn("band", matching_band(F.col("outgoing"), F.col("below")))
    margin = F.abs(F.col("post") - year["first_apron"])
    near = F.col("hidden") & (margin < NEAR_LINE)
    j = j.withColumn("sure", F.col("certain") & ~near)
    missing, room, fits = F.col("apron_payroll").isNull(), F.col("post") < year["salary_cap"], F.col("incoming") <= F.col("ceiling")
    inc, out, top = grouped("incoming"), grouped("outgoing"), grouped("ceiling")
    return j.select(
        "trade_id", "team", "outgoing", "incoming", F.when(missing, zero).otherwise(F.col("ceiling")).alias("max_incoming"), F.when(missing, "n/a").otherwise(F.col("band")).alias("band"),
        F.when(missing | room, "INDETERMINATE").when(~fits, "ILLEGAL").when(~F.col("sure"), "INDETERMINATE").otherwise("LEGAL").alias("severity"),
        F.when(missing, F.concat(F.lit("no cap sheet supplied for "), F.col("team")))
        .when(room, "team appears under the salary cap post-trade; cap-room absorption is not yet modeled (needs cap holds)")
        .when(~fits, F.concat(F.lit("incoming $"), inc, F.lit(" exceeds the $"), top, F.lit(" ceiling for $"), out, F.lit(" outgoing by $"), grouped(F.col("incoming") - F.col("ceiling"))))
        .when(~F.col("sure"), F.concat(F.lit("would be legal at $"), inc, F.lit(" <= $"), top, F.lit(", but the apron band is uncertain (see caveats)")))
        .otherwise(F.concat(F.lit("outgoing $"), out, F.lit(" permits up to $"), top, F.lit("; incoming $"), inc, F.lit(" fits"))).alias("reason"),
        F.when(missing, "missing input").when(room, "cap-room path not modeled").otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv)), F.col("band"))).alias("rule"),
        F.when(near, F.concat(F.lit("within $"), grouped(margin), F.lit(" of the first apron and incoming likely incentives are unobserved; band may be wrong"))).alias("caveat"),
    )


def trade_rollup(verdicts: DataFrame) -> DataFrame:
    """ILLEGAL outranks INDETERMINATE, which outranks LEGAL."""
    rank = F.when(F.col("severity") == "ILLEGAL", 2).when(F.col("severity") == "INDETERMINATE", 1).otherwise(0)
    return verdicts.groupBy("trade_id").agg(F.max(rank).alias("rank"), F.count("*").alias("n_teams")).select("trade_id", "n_teams", F.element_at(F.array(F.lit("LEGAL"), F.lit("INDETERMINATE"), F.lit("ILLEGAL")), F.col("rank") + 1).alias("severity"))
