"""Declared schemas of all inputs and stage tables, as DDL text."""

from __future__ import annotations

from touchline.operators.results import COUNT_COLUMNS, IDENTITY_COLUMNS, ODDS_COLUMNS

# Results file: every column is read as text.
RESULTS_RAW = ", ".join(
    f"`{c}` string" for c in (*IDENTITY_COLUMNS, *COUNT_COLUMNS, *ODDS_COLUMNS)
)

MATCHES = (
    "match_id bigint, match_date date, kick_off string, home_score int, away_score int, "
    "match_status string, match_status_360 string, last_updated timestamp_ntz, "
    "last_updated_360 timestamp_ntz, match_week int, competition_id int, "
    "competition_country_name string, competition_name string, competition string, "
    "season_id int, season string, "
    "home_team_id int, home_team string, home_team_gender string, home_team_group string, "
    "home_team_country_id int, home_team_country_name string, "
    "away_team_id int, away_team string, away_team_gender string, away_team_group string, "
    "away_team_country_id int, away_team_country_name string, "
    "competition_stage_id int, competition_stage string, stadium_id int, stadium string, "
    "stadium_country_id int, stadium_country_name string, referee_id int, referee string, "
    "referee_country_id int, referee_country_name string, "
    "home_managers string, away_managers string, "
    "home_manager_id int, home_manager_name string, home_manager_nickname string, "
    "home_manager_dob date, home_manager_country_id int, home_manager_country_name string, "
    "away_manager_id int, away_manager_name string, away_manager_nickname string, "
    "away_manager_dob date, away_manager_country_id int, away_manager_country_name string, "
    "data_version string, shot_fidelity_version int, xy_fidelity_version int, "
    "home_fd string, away_fd string"
)

# Typed events, one row per event of any match.
EVENTS = (
    "match_id bigint, event_id string, index bigint, period int, minute int, type string, "
    "team string, player string, location array<double>, shot_xg double, shot_outcome string, "
    "shot_technique string, shot_body_part string, shot_type string, key_pass_id string, "
    "play_pattern string, pass_cross boolean, substitution_replacement string, "
    "bad_behaviour_card string, foul_committed_card string"
)

LINEUPS = (
    "match_id bigint, team string, "
    "lineup array<struct<player_name: string, positions: array<struct<position: string>>>>"
)

XG_BY_MATCH = (
    "match_id bigint, home_fd string, away_fd string, match_date date, home_xg double, away_xg double"
)

KEY_EVENTS = (
    "match_id bigint, home_fd string, away_fd string, match_date date, index bigint, "
    "event_type string, player string, team_fd string, minute int, xg double"
)

# The CSV export of the same table, which has no event index.
KEY_EVENTS_CSV = (
    "match_id bigint, home_fd string, away_fd string, match_date date, event_type string, "
    "player string, team_fd string, minute int, xg double"
)

SHOTS = (
    "match_id bigint, home_fd string, away_fd string, match_date date, index bigint, "
    "team_fd string, player string, minute int, x double, y double, xg double, is_goal int, "
    "outcome string, technique string, body_part string, home_score int, away_score int, "
    "score_after string"
)

PLAYERS = (
    "match_id bigint, home_fd string, away_fd string, match_date date, team_fd string, "
    "player_name string, minutes int, xg double, goals int, position string"
)

COMMENTARY = (
    "match_id bigint, home_fd string, away_fd string, match_round int, content_type string, "
    "highlight_idx int, player string, minute int, is_goal int, event_type string, "
    "commentary string"
)


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [column.split()[0].strip("`") for column in ddl.split(", ")]
