"""Warehouse tables: DDL schema and key of each. Spark doesn't enforce keys; ``assert_key`` checks one."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: fixed values: table, key columns, columns
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw.nba_response": (("request_hash",), "request_hash string, endpoint string, params_json string, fetched_at timestamp_ntz, payload_json string"),
    "raw.contract_page": (("source", "url"), "source string, url string, fetched_at timestamp_ntz, html string"),
    "stg.player": (("nba_player_id",), "nba_player_id long, full_name string, first_name string, last_name string, birthdate date, position string, height_in short, weight_lb short, draft_year short, draft_round short, draft_number short, from_year short, to_year short, is_active boolean"),
    "stg.team": (("nba_team_id",), "nba_team_id long, abbreviation string, nickname string, city string, full_name string"),
    "stg.player_xwalk": (("nba_player_id",), "nba_player_id long, bbref_slug string, spotrac_slug string, match_method string, match_score double, resolved_at timestamp_ntz"),
    "stg.game": (("game_id",), "game_id string, season string, season_type string, game_date date, home_team_id long, away_team_id long, home_pts short, away_pts short"),
    "stg.pbp_event": (("game_id", "event_num"), "game_id string, event_num int, period short, clock_seconds_left double, event_type string, event_action_type string, description string, team_id long, player1_id long, player2_id long, player3_id long, home_score short, away_score short"),
    "stg.box_player": (("game_id", "nba_player_id"), "game_id string, nba_player_id long, nba_team_id long, seconds_played int, pts short, reb short, ast short, started boolean"),
    "stg.contract": (("contract_id",), "contract_id string, nba_player_id long, nba_team_id long, signed_date date, total_value long, years short, has_trade_bonus boolean, trade_bonus_amount long, no_trade_clause boolean, source string"),
    "stg.contract_year": (("contract_id", "season"), "contract_id string, season string, nba_player_id long, cap_hit long, guaranteed long, option_type string, is_two_way boolean, is_rookie_scale boolean, incentives_likely long, incentives_unlikely long"),
    "stg.player_rights": (("nba_player_id", "season"), "nba_player_id long, season string, nba_team_id long, bird_tier string, years_of_service short"),
    "stg.transaction": (("transaction_id",), "transaction_id string, txn_date date, season string, txn_type string, description string, source_url string"),
    "stg.transaction_leg": (("transaction_id", "leg_num"), "transaction_id string, leg_num short, nba_player_id long, from_team_id long, to_team_id long, cash_amount long, pick_detail string"),
    "mart.stint": (("stint_id",), "stint_id string, game_id string, period short, start_seconds double, end_seconds double, off_team_id long, home_lineup array<long>, away_lineup array<long>, possessions double, home_pts short, away_pts short"),
    "mart.cap_sheet": (("nba_team_id", "season", "as_of"), "nba_team_id long, season string, as_of date, cap_payroll long, apron_payroll long, roster_count short, two_way_count short"),
    "mart.trade_exception": (("exception_id",), "exception_id string, nba_team_id long, season string, amount long, created_date date, expires_date date, used_amount long"),
}
CONTRACT_YEAR = "contract_id string, season string, bbref_slug string, player string, team_abbrev string, season_index short, cap_hit long, guaranteed long, is_guaranteed boolean, option_type string, needs_review boolean, review_reason string"


def assert_key(df: DataFrame, *keys: str) -> DataFrame:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"key {keys} is not unique")
    return df
