"""Queries over match results, rounds, standings and scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog.registry import register
from touchline.catalog.views import SEASON, raw_results, sql, v_match, v_season
from touchline.operators import conform, report, results, standings
from touchline.sources.stage import stage
from touchline.sources.tables import nested_by_round

# One all-text results file in SQL; the seeds are those of ``raw_results``.
_COUNTS = ["HTHG", "HTAG", "HS", "AS", "HST", "AST", "HC", "AC", "HY", "AY", "HR", "AR"]


def _count_sql(seed: int) -> str:
    """Cleaned count column: text that is a gap or misprint is null."""
    return (
        f"CASE WHEN match_id % 17 = {seed % 17} OR match_id % 19 = {seed % 19} "
        f"OR match_id % 23 = {seed % 23} THEN NULL ELSE CAST((match_id * {seed}) % {4 + seed} AS DOUBLE) END"
    )


def _odds_sql(seed: int) -> str:
    return (
        f"CASE WHEN match_id % 13 = {seed} THEN NULL "
        f"ELSE CAST(((match_id * {seed}) % 900 + 101) AS DOUBLE) / 100 END"
    )


_TYPED = (
    "SELECT match_id, season, CASE WHEN match_id % 29 = 0 THEN NULL ELSE match_date END AS \"Date\", "
    "home_team AS \"HomeTeam\", away_team AS \"AwayTeam\", "
    "CASE WHEN match_id % 31 = 0 THEN NULL ELSE CAST(home_goals AS DOUBLE) END AS \"FTHG\", "
    "CASE WHEN match_id % 37 = 0 THEN NULL ELSE CAST(away_goals AS DOUBLE) END AS \"FTAG\", "
    + ", ".join(f'{_count_sql(s)} AS "{c}"' for s, c in enumerate(_COUNTS, 3))
    + ", "
    + ", ".join(f'{_odds_sql(s)} AS "{c}"' for s, c in enumerate(results.ODDS_NAMES, 5))
    + " FROM v_match"
)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return results.type_results(raw_results(spark, sf), extra=("match_id", "season"))


@register(sql(_TYPED, "v_match"))
def results_typed(spark: SparkSession, sf: str) -> DataFrame:
    """All-text results to numbers and dates, gaps and misprints to null."""
    return _typed(spark, sf)


_INT = "CAST(greatest(coalesce(trunc({0}), 0), 0) AS BIGINT)"


@register(sql(
    f"""SELECT match_id, season, home_goals, away_goals,
        CASE WHEN home_goals > away_goals THEN 'H' WHEN away_goals > home_goals THEN 'A' ELSE 'D' END AS result,
        coalesce(printf('%.2f', "match_resultH"), '—') AS odds_h,
        coalesce(printf('%.2f', "match_resultX"), '—') AS odds_x,
        coalesce(printf('%.2f', "match_resultA"), '—') AS odds_a
    FROM (SELECT *, {_INT.format('"FTHG"')} AS home_goals, {_INT.format('"FTAG"')} AS away_goals
          FROM ({_TYPED}))""",
    "v_match",
))
def results_display(spark: SparkSession, sf: str) -> DataFrame:
    """Whole goals, result code and odds text of a results list."""
    return results.results_view(_typed(spark, sf), ["match_id", "season"])


@register(sql(
    "\nUNION ALL\n".join(
        f"""SELECT match_id, {i} AS ord, '{label}' AS label,
            {_INT.format(f'"{h}"')} AS home_value, {_INT.format(f'"{a}"')} AS away_value FROM ({_TYPED})"""
        for i, (label, h, a) in enumerate(results.STATISTICS, 1)
    ),
    "v_match",
))
def match_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of a match as one row per label."""
    return results.statistics(_typed(spark, sf), ["match_id"])


@register(sql("SELECT match_id, season, match_date, round FROM v_season", "v_season"))
def assign_round(spark: SparkSession, sf: str) -> DataFrame:
    """Round numbers by place in date order, per season."""
    placed = conform.assign_round(v_match(spark, sf), SEASON, "match_date", "match_id")
    return placed.select("match_id", "season", "match_date", "round")


@register(sql(
    "SELECT DISTINCT season, round, max(round) OVER (PARTITION BY season) AS last_round FROM v_season",
    "v_season",
))
def rounds_available(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of every season and the last of them."""
    return conform.rounds_available(v_season(spark, sf), SEASON)


@register(sql(
    "SELECT match_id, season, round, home_team, away_team, home_goals, away_goals FROM v_season WHERE round = 17",
    "v_season",
))
def matches_of_round(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of one round."""
    columns = ["match_id", "season", "round", "home_team", "away_team", "home_goals", "away_goals"]
    return standings.table_of_round(v_season(spark, sf), 17).select(*columns)


_TEAM_ROWS = """
  SELECT season, round, home_team AS team, home_goals AS gf, away_goals AS ga, match_id, match_date, 0 AS side FROM v_season
  UNION ALL
  SELECT season, round, away_team, away_goals, home_goals, match_id, match_date, 1 FROM v_season"""


@register(sql(
    f"""SELECT season, round, team, 1 AS played, CAST(gf > ga AS INTEGER) AS won, CAST(gf = ga AS INTEGER) AS drawn,
        CAST(gf < ga AS INTEGER) AS lost, gf, ga FROM ({_TEAM_ROWS})""",
    "v_season",
))
def team_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows per match, one from each side."""
    return standings.team_rows(v_season(spark, sf), SEASON).drop("seen_at")


# Straight from the definition: every round adds up all matches up to it.
_STANDINGS = f"""
  rows AS ({_TEAM_ROWS}),
  firsts AS (SELECT season, team, min(struct_pack(d := match_date, m := match_id, s := side)) AS seen,
                    min(round) AS first_round FROM rows GROUP BY ALL),
  rounds AS (SELECT DISTINCT season, round FROM rows),
  per AS (SELECT season, team, round, count(*) AS played, count(*) FILTER (gf > ga) AS won,
                 count(*) FILTER (gf = ga) AS drawn, count(*) FILTER (gf < ga) AS lost,
                 sum(gf) AS gf, sum(ga) AS ga FROM rows GROUP BY ALL),
  grid AS (SELECT r.season, r.round, f.team, f.seen FROM rounds r JOIN firsts f
           ON r.season = f.season AND r.round >= f.first_round),
  run AS (SELECT g.season, g.round, g.team, g.seen,
                 {", ".join(f"CAST(sum(coalesce({c}, 0)) OVER w AS BIGINT) AS {c}" for c in standings.TALLIES)}
          FROM grid g LEFT JOIN per p ON p.season = g.season AND p.team = g.team AND p.round = g.round
          WINDOW w AS (PARTITION BY g.season, g.team ORDER BY g.round ROWS UNBOUNDED PRECEDING)),
  league AS (SELECT season, round, CAST(row_number() OVER (PARTITION BY season, round
                    ORDER BY won * 3 + drawn DESC, gf - ga DESC, gf DESC, seen, team) AS INTEGER) AS position,
                    team, {", ".join(standings.TALLIES)}, gf - ga AS gd, won * 3 + drawn AS pts
             FROM run)"""


def _league(body: str) -> str:
    return sql("", "v_season").rstrip() + "," + _STANDINGS + "\n" + body


def _table(spark: SparkSession, sf: str) -> DataFrame:
    tallies = stage(standings.round_tallies(v_season(spark, sf), SEASON), "tallies")
    return standings.standings_of(tallies, SEASON)


@register(_league("SELECT * FROM league"))
def standings_all_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """League tables after every round of every season."""
    return _table(spark, sf)


@register(_league("""SELECT l.season, l.round, max(l.pts) FILTER (l.position = 1) AS lead,
  max(l.pts + 3 * (g.games - l.played)) FILTER (l.position > 1) AS reach,
  coalesce(count(*) = max(g.teams) AND max(l.pts) FILTER (l.position = 1)
           > max(l.pts + 3 * (g.games - l.played)) FILTER (l.position > 1), false) AS settled
  FROM league l JOIN (SELECT season, max(played) AS games, count(DISTINCT team) AS teams FROM league GROUP BY season) g
  USING (season) GROUP BY l.season, l.round"""))
def title_races(spark: SparkSession, sf: str) -> DataFrame:
    """After every round, the leader's points and what another team can still get."""
    return standings.title_races(stage(_table(spark, sf), "league"), SEASON)


@register(_league("SELECT * FROM league WHERE round = 17"))
def standings_one_round(spark: SparkSession, sf: str) -> DataFrame:
    """League tables after one round."""
    return standings.table_of_round(_table(spark, sf), 17)


@register(_league(
    "SELECT * FROM league WHERE (season, round) IN (SELECT (season, max(round)) FROM rounds GROUP BY season)"
))
def standings_last_round(spark: SparkSession, sf: str) -> DataFrame:
    """Final league tables: only the last round is summed up."""
    matches = v_season(spark, sf)
    return standings.final_standings(matches, SEASON)


@register(_league("""SELECT season, round, position, team, CASE WHEN gd > 0 THEN '+' || gd ELSE CAST(gd AS VARCHAR) END AS gd_text,
    team = 'NATION_3' AS is_focus, CAST(pts AS BIGINT) AS pts FROM league"""))
def standings_display(spark: SparkSession, sf: str) -> DataFrame:
    """League tables with signed goal difference and the focus team marked."""
    shown = standings.table_view(_table(spark, sf), "NATION_3")
    return shown.select("season", "round", "position", "team", "gd_text", "is_focus", "pts")


@register(_league("""SELECT season, round, count(*) AS teams, max(team) FILTER (position = 1) AS leader,
    max(pts) FILTER (position = 1) AS leader_pts FROM league GROUP BY season, round"""))
def leader_by_round(spark: SparkSession, sf: str) -> DataFrame:
    """Leader and size of the table after every round."""
    return standings.leaders(_table(spark, sf), SEASON)


@register(_league("""SELECT season, round, CAST(to_json(list(struct_pack(position := position, team := team, played := played,
    won := won, drawn := drawn, lost := lost, gf := gf, ga := ga, gd := gd, pts := pts) ORDER BY position)) AS VARCHAR) AS rows
    FROM league GROUP BY season, round"""))
def standings_nested(spark: SparkSession, sf: str) -> DataFrame:
    """League tables as one JSON text per round."""
    return nested_by_round(_table(spark, sf), SEASON, "position")


@register(sql(
    """SELECT team, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn,
       count(*) FILTER (gf < ga) AS lost, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against
       FROM (SELECT home_team AS team, home_goals AS gf, away_goals AS ga FROM v_match
             UNION ALL SELECT away_team, away_goals, home_goals FROM v_match) GROUP BY team""",
    "v_match",
))
def team_record(spark: SparkSession, sf: str) -> DataFrame:
    """Wins, draws, losses and goals of every team over all seasons."""
    named = v_match(spark, sf).select(
        F.col("home_team").alias("home_fd"), F.col("away_team").alias("away_fd"),
        F.col("home_goals").alias("home_score"), F.col("away_goals").alias("away_score"),
    )
    return report.team_record(named)
