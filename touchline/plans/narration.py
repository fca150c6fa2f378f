"""Briefs, prompts and the voice queue, for matches not done yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import dimensions
from touchline.operators import briefs, conform, enrich, incremental, lookup, prompts, voice
from touchline.operators.joins import hot_keys
from touchline.sources.assets import list_assets
from touchline.sources.stage import Scope, stage
from touchline.sources.tables import read_table, write_table

PROMPTS = (
    "match_id bigint, focus string, content_type string, highlight_idx int, player string, minute int, "
    "is_goal int, event_type string, prompt string, home_fd string, away_fd string, match_round int, "
    "season string, bucket int"
)
#: Prompts are stored by season of a league and by one of so many shares of its matches.
BUCKETS = 16
STORED_BY = ["season", "bucket"]


def _of_matches(df: DataFrame, matches: DataFrame) -> DataFrame:
    return df.join(matches.select("match_id"), "match_id", "left_semi")


def _placed(df: DataFrame, matches: DataFrame) -> DataFrame:
    """Prompts with the folder they are stored in."""
    return df.join(matches.select("match_id", "season"), "match_id").withColumn(
        "bucket", F.pmod(F.xxhash64("match_id"), F.lit(BUCKETS)).cast("int"),
    )


def _beside(done: DataFrame, new: DataFrame) -> DataFrame:
    """Stored prompts of other matches in the folders that ``new`` writes to; other folders are not read."""
    # The filter lets Spark prune folders by the short side while it runs.
    folders = F.broadcast(new.filter("bucket >= 0").select(*STORED_BY).distinct())
    return incremental.unseen(done.join(folders, STORED_BY, "left_semi"), new, ["match_id"])


def _season_of_league() -> Column:
    """Season of one competition, never null; leagues share the names of seasons."""
    competition = F.coalesce(F.col("competition_id").cast("string"), "competition", F.lit(""))
    return F.concat_ws("/", competition, F.coalesce(F.col("season_id").cast("string"), "season", F.lit("")))


def build_prompts(
    spark: SparkSession,
    out: str,
    focus_team: str | None = None,
    rounds: DataFrame | None = None,
    stats: DataFrame | None = None,
    cries: DataFrame | None = None,
    opponent: str | None = None,
    again: bool = False,
    nickname: str = "",
    stadium: str = "",
    frame: prompts.Frame = prompts.Frame(),
    final_round: int | None = None,
) -> None:
    """Append prompts of the matches that have none, or replace them with ``again``.

    Replacing rewrites only the folders (season and share of its matches) that
    hold a match done again.  Everything is computed before the first folder is
    touched; should a run end while folders are exchanged, a run without
    ``again`` makes the prompts of the matches that have none by then.

    ``rounds`` has ``home_fd``, ``away_fd`` and ``round``; without it the
    round stated by the feed is taken.  What is told of a season is taken from
    all its stored matches, whichever of them get prompts.  A season ends with
    its last stored round; while matches of it are still to come, give the
    round it will end with as ``final_round``, which is then also the number of
    matches of a team.  The round that settles a title follows from the tables.
    """
    with Scope(spark):  # stage tables go when the prompts are stored
        stats = dimensions.season_stats(spark) if stats is None else stats
        cries = dimensions.goal_cries(spark) if cries is None else cries
        stored = spark.read.parquet(f"{out}/matches").dropDuplicates(["match_id"])
        if rounds is None:
            stored = stored.withColumn("match_round", F.coalesce("match_week", F.lit(0)))
        else:
            stored = lookup.pair_round(stored, rounds, ["match_id"])
        stored = stage(stored.withColumn("season", _season_of_league()), "stored_matches")
        totals = stage(briefs.match_totals(spark.read.parquet(f"{out}/shots"), stored), "totals")
        matches = conform.focus_matches(stored, focus_team, opponent) if focus_team else stored
        done = read_table(spark, f"{out}/prompts", PROMPTS)
        if not again:
            matches = incremental.unseen(matches, done, ["match_id"])
        matches = stage(matches, "matches")

        all_shots = _of_matches(spark.read.parquet(f"{out}/shots"), matches)
        events = _of_matches(spark.read.parquet(f"{out}/key_events"), matches)
        reds = events.filter(F.col("event_type") == "red_card")
        facts = stage(
            briefs.match_briefs(
                all_shots, reds, matches, spark.read.parquet(f"{out}/xg_by_match"), stored, focus_team, final_round,
                totals=totals, titles=briefs.season_titles(totals, stored, final_round),
            ),
            "briefs",
        )
        scorers = stage(briefs.scorers_of_match(all_shots), "scorers")
        highlights = _of_matches(spark.read.parquet(f"{out}/highlights"), matches)
        names = highlights.filter(F.col("player").isNotNull()).select("player").distinct()
        flags = briefs.highlight_briefs(
            briefs.goal_numbers(highlights), facts, scorers, lookup.season_stats_of(names, stats),
            hot=hot_keys(highlights, ["match_id"]),
        )
        context = enrich.shot_context(_of_matches(spark.read.parquet(f"{out}/events"), matches))
        texts = enrich.with_context(prompts.highlight_texts(flags), context)
        spoken = prompts.highlight_prompts(
            texts, facts, lookup.goal_cry_of(names, cries, dimensions.DEFAULT_CRY),
            dimensions.language_notes(spark), frame,
        )
        hooked = prompts.hooks(facts, briefs.hook_players(scorers, prompts.HOOK_SCORERS))
        table = prompts.prompt_table(prompts.intro_prompts(hooked, nickname, stadium, frame), spoken, facts)
        new = stage(_placed(table, stored).select(*done.columns), "prompts")
        if again:
            new = stage(incremental.append(_beside(done, new), new), "new_prompts")
        mode = "overwrite" if again else "append"
        write_table(new.repartition(*STORED_BY), f"{out}/prompts", STORED_BY, mode)


def build_voice_queue(spark: SparkSession, texts: DataFrame, audio: str, out: str, pattern: str | None = None) -> DataFrame:
    """Write the texts still to be voiced and return the counts by status."""
    chosen = voice.texts_of_team(texts, pattern) if pattern else texts
    assets = list_assets(spark, audio)
    write_table(voice.voice_queue(chosen, assets), f"{out}/voice_queue")
    return voice.status_counts(voice.voice_status(chosen, assets))
