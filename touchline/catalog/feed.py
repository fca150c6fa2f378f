"""The event tables of one query, each made once and only when asked for.

Tables that more than one step of a query reads are written as stage tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import dimensions
from touchline.catalog import views
from touchline.operators import briefs, lineups, lookup, prompts, sequence, shots
from touchline.sources.stage import stage


def raw_lineups(events: DataFrame) -> DataFrame:
    """Line-ups in feed form, out of the players with a pass."""
    number = F.regexp_extract("player", "([0-9]+)$", 1).cast("int") % 5
    first = (
        F.when(number == 0, "Goalkeeper").when(number == 1, "Left Wing").when(number == 2, "Centre Back")
        .when(number == 3, "Sweeper")
    )
    listed = F.when(
        first.isNotNull(),
        F.array(F.struct(first.alias("position")), F.struct(F.lit("Right Wing").alias("position"))),
    ).otherwise(F.array().cast("array<struct<position: string>>"))
    players = (
        events.filter((F.col("type") == "Pass") & F.col("player").isNotNull())
        .select("match_id", "team", "player").distinct()
    )
    return players.select(
        "match_id", "team",
        F.array(F.struct(F.col("player").alias("player_name"), listed.alias("positions"))).alias("lineup"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events").select("user_id").distinct()


def stats_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Season statistics: a third by full name, a third with a middle name, a third missing."""
    u = F.col("user_id")
    plain = views.player_name(u)
    middle = F.concat(F.lit("First"), (u % 7).cast("string"), F.lit(" Middle Last"), u.cast("string"))
    return users(spark, sf).filter(u % 3 < 2).select(
        (u + 1).cast("int").alias("ord"),
        F.when(u % 3 == 0, middle).otherwise(plain).alias("name"),
        (u % 15).cast("int").alias("goals"),
        (u % 9).cast("int").alias("assists"),
        (u % 34).cast("int").alias("apps"),
        (u % 40 / 4).alias("xg"),
        F.when(u % 10 == 0, "top scorer").otherwise(F.concat(F.lit("note "), (u % 4).cast("string"))).alias("note"),
    )


def cry_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Goal cries: names shorter, longer and equal to the players', and some missing."""
    u = F.col("user_id")
    short = F.concat(F.lit("Last"), u.cast("string"))
    long = F.concat(F.lit("Dr "), views.player_name(u), F.lit(" Junior"))
    language = F.when(u % 6 == 0, "German").when(u % 6 == 1, "French").when(u % 6 == 2, "Spanish").otherwise("Dutch")
    return users(spark, sf).filter((u % 4 < 3) & (u % 5 > 0)).select(
        (u + 1).cast("int").alias("ord"),
        F.when(u % 4 == 0, short).when(u % 4 == 1, long).otherwise(views.player_name(u)).alias("name"),
        F.concat(F.lit("GOL "), (u % 5).cast("string")).alias("cry"),
        language.alias("language"),
        F.lit("flag").alias("flag"),
    )


class Feed:
    def __init__(self, spark: SparkSession, sf: str, focus_team: str | None = None):
        self.spark, self.sf, self.focus_team = spark, sf, focus_team

    @cached_property
    def events(self) -> DataFrame:
        return views.feed_events(self.spark, self.sf)

    @cached_property
    def fixtures(self) -> DataFrame:
        return stage(views.fixtures(self.spark, self.sf), "fixtures")

    @cached_property
    def feed_named(self) -> DataFrame:
        """Fixtures under their feed names, which are those of the results view."""
        return self.fixtures.withColumn("home_fd", F.col("home_team")).withColumn("away_fd", F.col("away_team"))

    @cached_property
    def shots_once(self) -> DataFrame:
        """Shots for a query that reads them in one place only."""
        return shots.shot_rows(self.events, self.fixtures)

    @cached_property
    def shots(self) -> DataFrame:
        return stage(self.shots_once, "shots")

    @cached_property
    def key_events_once(self) -> DataFrame:
        return shots.key_events(self.events, self.fixtures)

    @cached_property
    def key_events(self) -> DataFrame:
        return stage(self.key_events_once, "key_events")

    @cached_property
    def reds(self) -> DataFrame:
        return self.key_events.filter(F.col("event_type") == "red_card")

    @cached_property
    def sequence_once(self) -> DataFrame:
        cards = sequence.score_at(self.reds.drop("event_type", "xg"), self.shots)
        chosen = sequence.items(shots.highlight_shots(self.shots), cards)
        return sequence.number_items(stage(chosen, "items"))

    @cached_property
    def sequence(self) -> DataFrame:
        return stage(self.sequence_once, "sequence")

    @cached_property
    def match_xg(self) -> DataFrame:
        return shots.match_xg(self.events, self.fixtures)

    @cached_property
    def lines(self) -> DataFrame:
        return stage(self.lines_once, "lines")

    @cached_property
    def lines_once(self) -> DataFrame:
        places = lineups.positions(raw_lineups(self.events))
        return lineups.player_lines(self.events, self.fixtures, places)

    @cached_property
    def scorers(self) -> DataFrame:
        return briefs.scorers_of_match(self.shots)

    @cached_property
    def scorer_lists(self) -> DataFrame:
        return briefs.scorer_lists(self.scorers)

    @cached_property
    def hook_players(self) -> DataFrame:
        return briefs.hook_players(self.scorers, prompts.HOOK_SCORERS)

    @cached_property
    def briefs_once(self) -> DataFrame:
        return briefs.match_briefs(
            self.shots, self.reds, self.fixtures, self.match_xg, self.fixtures,
            focus_team=self.focus_team, final_round=None,
        )

    @cached_property
    def briefs(self) -> DataFrame:
        return stage(self.briefs_once, "briefs")

    @cached_property
    def player_names(self) -> DataFrame:
        return self.events.filter(F.col("player").isNotNull()).select("player").distinct()

    @cached_property
    def stats(self) -> DataFrame:
        return lookup.season_stats_of(self.player_names, stats_dimension(self.spark, self.sf))

    @cached_property
    def cries(self) -> DataFrame:
        return lookup.goal_cry_of(self.player_names, cry_dimension(self.spark, self.sf), dimensions.DEFAULT_CRY)

    @cached_property
    def highlight_briefs(self) -> DataFrame:
        counted = briefs.goal_numbers(self.sequence)
        return briefs.highlight_briefs(counted, self.briefs, self.scorers, self.stats)
