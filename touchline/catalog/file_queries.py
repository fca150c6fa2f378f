"""Queries that write whole tables as files of the feed and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schemas
from touchline.catalog.feed import raw_lineups
from touchline.catalog.registry import ORACLES, register
from touchline.catalog import result_queries, story_queries  # noqa: F401  (their SQL is used here)
from touchline.catalog.views import SEASON, feed_events, feed_matches, raw_results, sql, v_match, v_season
from touchline.operators import results, shots, standings
from touchline.plans import season
from touchline.sources import assets, landed, results_file, tables
from touchline.sources.stage import stage_run_folder


@register(ORACLES["results_typed"])
def results_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Results typed out of all-text CSV files with a header."""
    folder = stage_run_folder(spark, "results_csv")
    tables.write_csv(raw_results(spark, sf), folder)
    typed = results.type_results(results_file.read_raw(spark, folder), extra=("match_id", "season"))
    return typed.withColumns({"match_id": F.col("match_id").cast("bigint"), "season": F.col("season").cast("int")})


@register(sql(
    "SELECT match_id, match_date, match_round AS match_week, home_team, away_team, home_score, away_score FROM fixtures",
    "fixtures",
))
def matches_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Match list out of JSON with the feed's nested objects."""
    folder = stage_run_folder(spark, "matches_json")
    feed_matches(spark, sf).select(
        "match_id", "match_date", "match_week", "home_score", "away_score",
        F.struct(F.col("season").alias("season_id"), F.col("season").cast("string").alias("season_name")).alias("season"),
        F.struct(F.col("home_team").alias("home_team_name")).alias("home_team"),
        F.struct(F.col("away_team").alias("away_team_name")).alias("away_team"),
    ).write.json(folder)
    found = landed.read_matches(spark, folder, multi_line=False)
    return found.select("match_id", "match_date", "match_week", "home_team", "away_team", "home_score", "away_score")


@register(sql(
    """SELECT match_id, event_id, index, period, minute, type, team, player, x, y, shot_xg, shot_outcome, key_pass_id,
       pass_cross, substitution_replacement, bad_behaviour_card, foul_committed_card FROM ev""", "ev",
))
def events_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """All events out of one folder of JSON per match, names nested as in the feed."""
    folder = stage_run_folder(spark, "events_json")
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))
    feed_events(spark, sf).select(
        "match_id", F.col("event_id").alias("id"), "index", "period", "minute", "location",
        *[named(c).alias(c) for c in ("type", "team", "player", "play_pattern")],
        F.struct(
            F.col("shot_xg").alias(landed.XG_FIELD), "key_pass_id",
            *[named(f"shot_{c}").alias(c) for c in ("outcome", "technique", "body_part", "type")],
        ).alias("shot"),
        F.struct(F.col("pass_cross").alias("cross")).alias("pass"),
        F.struct(named("substitution_replacement").alias("replacement")).alias("substitution"),
        F.struct(named("bad_behaviour_card").alias("card")).alias("bad_behaviour"),
        F.struct(named("foul_committed_card").alias("card")).alias("foul_committed"),
    ).repartition("match_id").write.partitionBy("match_id").json(folder)
    found = landed.read_events(spark, folder, multi_line=False)
    return found.withColumns({"x": F.get("location", F.lit(0)), "y": F.get("location", F.lit(1))}).select(
        "match_id", "event_id", "index", "period", "minute", "type", "team", "player", "x", "y", "shot_xg", "shot_outcome",
        "key_pass_id", "pass_cross", "substitution_replacement", "bad_behaviour_card", "foul_committed_card",
    )


@register(sql("SELECT DISTINCT match_id, team, player FROM ev WHERE type = 'Pass' AND player IS NOT NULL", "ev"))
def lineups_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Players of all line-ups out of one folder of JSON per match."""
    folder = stage_run_folder(spark, "lineups_json")
    raw_lineups(feed_events(spark, sf)).withColumnRenamed("team", "team_name").repartition("match_id").write.partitionBy(
        "match_id",
    ).json(folder)
    found = landed.read_lineups(spark, folder, multi_line=False)
    return found.select("match_id", "team", F.explode("lineup").alias("p")).select(
        "match_id", "team", F.col("p.player_name").alias("player"),
    )


@register(sql("SELECT match_id, home_fd, away_fd, home_xg, away_xg FROM xg", "xg"))
def xg_csv(spark: SparkSession, sf: str) -> DataFrame:
    """xG per match, exported as CSV and read back with its schema."""
    folder = stage_run_folder(spark, "xg_csv")
    matches = feed_matches(spark, sf)
    tables.write_csv(shots.match_xg(feed_events(spark, sf), matches).select(*schemas.names(schemas.XG_BY_MATCH)), folder)
    return tables.read_csv(spark, folder, schemas.XG_BY_MATCH).select("match_id", "home_fd", "away_fd", "home_xg", "away_xg")


@register(ORACLES["matches_of_round"])
def round_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """One round out of matches stored by round; only its folder is read."""
    folder = stage_run_folder(spark, "matches_by_round")
    columns = ["match_id", "season", "round", "home_team", "away_team", "home_goals", "away_goals"]
    tables.write_by_round(v_season(spark, sf).select(*columns), folder, ["season"])
    return tables.read_round(spark, folder, 17).select(*columns)


@register(sql("SELECT match_id, season, match_date, place FROM (SELECT *, row_number() OVER (ORDER BY match_date, match_id) AS place FROM v_match)", "v_match"))
def results_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Results in date order, with their place in it; the rows come out sorted."""
    return results.in_date_order(v_season(spark, sf).select("match_id", "season", "match_date"))


@register(ORACLES["standings_all_rounds"])
def standings_extended(spark: SparkSession, sf: str) -> DataFrame:
    """League tables built without the last three weeks of every season, then extended by them."""
    folder = stage_run_folder(spark, "seasons")
    played = v_match(spark, sf).select(
        *SEASON, F.col("match_id").alias("source_row"), F.col("match_date").alias("Date"),
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"),
    )
    ends = played.groupBy(*SEASON).agg(F.date_sub(F.max("Date"), 21).alias("_end"))
    split = played.join(ends, SEASON)
    season.store(spark, split.filter(F.col("Date") <= F.col("_end")).drop("_end"), folder, SEASON)
    season.add(spark, split.filter(F.col("Date") > F.col("_end")).drop("_end"), folder, SEASON)
    return tables.read_by_round(spark, f"{folder}/standings").select(
        *SEASON, "round", "position", "team", *standings.TALLIES, "gd", "pts",
    )


@register(sql(
    """SELECT match_id, m % 24 || ':00' AS kick_off, CASE WHEN m % 2 = 0 THEN 'available' ELSE 'scheduled' END AS match_status,
       CASE WHEN m % 3 > 0 THEN 'processing' END AS match_status_360,
       CASE WHEN m % 5 > 0 THEN '2024-01-02 03:04:05' END AS last_updated,
       CAST(m % 4 AS INTEGER) AS competition_id, 'C' || m % 4 AS competition, 'N' || m % 7 AS competition_country_name,
       CAST(m % 3 AS INTEGER) AS competition_stage_id, 'Stage ' || m % 3 AS competition_stage,
       CAST(m % 90 AS INTEGER) AS stadium_id, 'P' || m % 90 AS stadium, CAST(m % 7 AS INTEGER) AS stadium_country_id,
       CASE WHEN m % 11 > 0 THEN 'P' || m % 90 END AS referee, CASE WHEN m % 11 > 0 THEN 'N' || m % 7 END AS referee_country_name,
       CAST(m % 90 AS INTEGER) AS home_team_id, 'female' AS home_team_gender, 'G' || m % 8 AS home_team_group,
       'N' || m % 7 AS home_team_country_name, CAST(m % 90 AS INTEGER) AS away_team_id,
       CASE WHEN m % 2 = 0 THEN 'P' || m % 90 || ', Q' || m % 13 ELSE '' END AS home_managers,
       CASE WHEN m % 2 = 0 THEN CAST(m % 90 AS INTEGER) END AS home_manager_id,
       CASE WHEN m % 2 = 0 THEN DATE '1970-03-04' END AS home_manager_dob,
       CASE WHEN m % 2 = 0 THEN 'N' || m % 7 END AS home_manager_country_name, CAST(NULL AS VARCHAR) AS away_managers,
       '1.' || m % 3 AS data_version, CASE WHEN m % 6 > 0 THEN 2 END AS shot_fidelity_version
       FROM (SELECT match_id, match_id AS m FROM fixtures)""",
    "fixtures",
))
def match_columns_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """What a match list tells beside teams and scores: states, places, officials, managers, versions."""
    folder = stage_run_folder(spark, "match_columns_json")
    person = "named_struct('id', m % 90, 'name', concat('P', m % 90), 'country', named_struct('id', m % 7, 'name', concat('N', m % 7)"

    def team(side: str, managers: str) -> str:
        return (
            f"named_struct('{side}_team_id', m % 90, '{side}_team_name', {side}_team, '{side}_team_gender', 'female', "
            f"'{side}_team_group', concat('G', m % 8), 'country', named_struct('id', m % 7, 'name', concat('N', m % 7)), "
            f"'managers', {managers}) AS {side}_team"
        )

    boss = f"{person}), 'dob', '1970-03-04')"
    deputy = "named_struct('id', m % 13, 'name', concat('Q', m % 13), 'country', named_struct('id', 1L, 'name', 'N'), 'dob', 'unknown')"
    feed_matches(spark, sf).withColumn("m", F.col("match_id")).selectExpr(
        "match_id", "match_date", "concat(m % 24, ':00') AS kick_off",
        "if(m % 2 = 0, 'available', 'scheduled') AS match_status", "if(m % 3 > 0, 'processing', NULL) AS match_status_360",
        "if(m % 5 > 0, '2024-01-02T03:04:05', 'soon') AS last_updated",
        "named_struct('competition_id', m % 4, 'competition_name', concat('C', m % 4), 'country_name', concat('N', m % 7)) AS competition",
        "named_struct('id', m % 3, 'name', concat('Stage ', m % 3)) AS competition_stage",
        f"{person})) AS stadium", f"if(m % 11 > 0, {person})), NULL) AS referee",
        team("home", f"if(m % 2 = 0, array({boss}, {deputy}), slice(array({boss}), 1, 0))"), team("away", "NULL"),
        "named_struct('data_version', concat('1.', m % 3), 'shot_fidelity_version', if(m % 6 > 0, '2', 'none')) AS metadata",
    ).write.json(folder)
    found = landed.read_matches(spark, folder, multi_line=False)
    return found.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss")).select(
        "match_id", "kick_off", "match_status", "match_status_360", "last_updated", "competition_id", "competition",
        "competition_country_name", "competition_stage_id", "competition_stage", "stadium_id", "stadium", "stadium_country_id",
        "referee", "referee_country_name", "home_team_id", "home_team_gender", "home_team_group", "home_team_country_name",
        "away_team_id", "home_managers", "home_manager_id", "home_manager_dob", "home_manager_country_name", "away_managers",
        "data_version", "shot_fidelity_version",
    )


@register(sql("SELECT match_id, home_xg, away_xg, CAST(NULL AS VARCHAR) AS commentary FROM xg", "xg"))
def missing_source(spark: SparkSession, sf: str) -> DataFrame:
    """Stored xG beside texts that were never written: every match stays, without a text."""
    folder = stage_run_folder(spark, "partly_stored")
    tables.write_table(shots.match_xg(feed_events(spark, sf), feed_matches(spark, sf)), f"{folder}/xg_by_match")
    xg = tables.read_table(spark, f"{folder}/xg_by_match", schemas.XG_BY_MATCH)
    texts = tables.read_table(spark, f"{folder}/commentary", schemas.COMMENTARY)
    return xg.join(texts.select("match_id", "commentary"), "match_id", "left").select("match_id", "home_xg", "away_xg", "commentary")


@register(sql(
    "SELECT season, CAST(sum(octet_length(encode(home_team || ' - ' || away_team)) + 1) AS BIGINT) AS bytes FROM v_match GROUP BY season",
    "v_match",
))
def listed_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes per season out of the listing of stored files, whose content is not read."""
    folder = stage_run_folder(spark, "assets")
    named = v_match(spark, sf).select("season", F.concat_ws(" - ", "home_team", "away_team").alias("value"))
    named.repartition("season").write.partitionBy("season").text(folder)
    files = assets.list_assets(spark, folder, "*.txt", folders=["season"])
    return files.groupBy(F.col("season").cast("int").alias("season")).agg(F.sum("bytes").alias("bytes"))
