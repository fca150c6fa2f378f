"""Queries over texts, the voice queue, incremental work and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog.feed import Feed
from touchline.catalog.registry import register
from touchline.catalog.views import BLOCKS, COLUMNS, feed_base, feed_columns, feed_events, sql, table, v_match
from touchline.functions import names, text
from touchline.operators import conform, incremental, lookup, voice
from touchline.sources.stage import stage_run_folder
from touchline.streaming.key_events import store_key_events
from touchline.streaming.unseen import append_unseen

# --- texts out of conversations --------------------------------------------


def texts_of(spark: SparkSession, sf: str) -> DataFrame:
    """One match per conversation; its first turn is the intro, the others are highlights."""
    conv, turn = F.col("conv_id"), F.col("turn")
    first = turn == 0
    return table(spark, sf, "conversations").select(
        conv.alias("match_id"),
        F.concat(F.lit("M'gladbach "), conv.cast("string")).alias("home_fd"),
        F.concat(F.lit("Team "), (conv % 25).cast("string")).alias("away_fd"),
        F.when(first, "intro").otherwise("highlight").alias("content_type"),
        (turn - 1).cast("int").alias("highlight_idx"),
        F.when((conv + turn) % 11 == 0, "nan").when((conv + turn) % 13 == 0, "ok")
        .when((conv + turn) % 17 != 0, F.concat("text", F.lit(" "), (conv % 10).cast("string"), F.lit("-"),
                                               (turn % 10).cast("string"), F.lit("-2"))).alias("commentary"),
    )


def assets_of(texts: DataFrame) -> DataFrame:
    """Audio that exists already: that of the intros and of the first highlights."""
    have = texts.filter(F.col("highlight_idx") <= 0)
    return have.select(names.asset_name(*[
        F.col(c) for c in ("home_fd", "away_fd", "content_type", "highlight_idx")
    ]).alias("file_name"))


BLOCKS["said"] = ([], """
  SELECT conv_id AS match_id, 'M''gladbach ' || conv_id AS home_fd, 'Team ' || (conv_id % 25) AS away_fd,
         CASE WHEN turn = 0 THEN 'intro' ELSE 'highlight' END AS content_type, CAST(turn - 1 AS INTEGER) AS highlight_idx,
         CASE WHEN (conv_id + turn) % 11 = 0 THEN 'nan' WHEN (conv_id + turn) % 13 = 0 THEN 'ok'
              WHEN (conv_id + turn) % 17 <> 0 THEN text || ' ' || (conv_id % 10) || '-' || (turn % 10) || '-2' END AS commentary
  FROM conversations""")
BLOCKS["status"] = (["said"], """
  SELECT *, CASE WHEN commentary IS NULL OR length(commentary) < 5 OR commentary = 'nan' THEN 'unusable'
                 WHEN highlight_idx <= 0 THEN 'present' ELSE 'queued' END AS status,
         replace(replace(home_fd, ' ', '_'), '''', '') || '_vs_' || replace(replace(away_fd, ' ', '_'), '''', '') || '_'
           || content_type || '_' || highlight_idx || '.mp3' AS file_name
  FROM said""")


def spoken_sql(column: str, pattern: str = "([0-9])-([0-9])") -> str:
    """SQL that spells out scores: one replacement per possible score."""
    out = f"regexp_replace({column}, '{pattern}', '<<\\1:\\2>>', 'g')"
    for home, first in enumerate(text.SPOKEN):
        for away, second in enumerate(text.SPOKEN):
            said = f"{first} all" if home == away else f"{first}-{second}"
            out = f"replace({out}, '<<{home}:{away}>>', '{said}')"
    return out


@register(sql("SELECT match_id, home_fd, away_fd, content_type, highlight_idx, file_name, status FROM status", "status"))
def voice_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with its audio file and whether it is to be voiced."""
    texts = texts_of(spark, sf)
    return voice.voice_status(texts, assets_of(texts)).drop("commentary")


@register(sql(f"SELECT file_name, {spoken_sql('commentary')} AS spoken FROM status WHERE status = 'queued'", "status"))
def voice_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Texts still to be voiced, scores spelled out."""
    texts = texts_of(spark, sf)
    return voice.voice_queue(texts, assets_of(texts))


@register(sql("SELECT status, count(*) AS texts FROM status GROUP BY status", "status"))
def voice_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to do, done and unusable."""
    texts = texts_of(spark, sf)
    return voice.status_counts(voice.voice_status(texts, assets_of(texts)))


@register(sql("SELECT CAST(coalesce(sum(length(commentary)), 0) AS BIGINT) AS characters FROM said", "said"))
def usage_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of all texts."""
    return voice.characters(texts_of(spark, sf))


@register(sql(
    "SELECT match_id, content_type, highlight_idx FROM said WHERE highlight_idx <= 0", "said",
))
def available_audio(spark: SparkSession, sf: str) -> DataFrame:
    """Audio per match, read back from file names."""
    texts = texts_of(spark, sf)
    matches = texts.select("match_id", "home_fd", "away_fd").distinct()
    return voice.available_audio(matches, assets_of(texts))


@register(sql(
    "SELECT match_id, arg_min(commentary, highlight_idx) AS intro FROM said WHERE content_type = 'intro' GROUP BY match_id",
    "said",
))
def match_intro(spark: SparkSession, sf: str) -> DataFrame:
    """The intro of every match."""
    return voice.intro_of_match(texts_of(spark, sf))


@register(sql(
    """SELECT q.match_id, q.highlight_idx, q.index, t.commentary FROM seq q
       LEFT JOIN said t ON t.match_id = q.match_id AND t.highlight_idx = q.highlight_idx AND t.content_type = 'highlight'""",
    "seq", "said",
))
def text_of_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """Text beside each highlight of the sequence."""
    found = voice.text_of_highlights(Feed(spark, sf).sequence_once, texts_of(spark, sf))
    return found.select("match_id", "highlight_idx", "index", "commentary")


@register(f"SELECT doc_id, {spoken_sql('text')} AS spoken FROM documents")
def score_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with scores spelled out."""
    return table(spark, sf, "documents").select("doc_id", text.score_words(F.col("text")).alias("spoken"))


@register("""SELECT doc_id, lang, n_chars FROM documents
    WHERE text IS NOT NULL AND length(text) >= 5 AND text <> 'nan'""")
def usable_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents long enough to be spoken."""
    return table(spark, sf, "documents").filter(conform.usable_text(F.col("text"))).select("doc_id", "lang", "n_chars")


@register(sql(
    """SELECT match_id, home_goals || '-' || away_goals AS score, home_goals = CAST(split_part(home_goals || '-' || away_goals, '-', 1) AS INTEGER) AS same,
       CAST(match_id % 200 AS BIGINT) || CASE WHEN match_id % 200 % 100 BETWEEN 11 AND 13 THEN 'th' WHEN match_id % 10 = 1 THEN 'st'
         WHEN match_id % 10 = 2 THEN 'nd' WHEN match_id % 10 = 3 THEN 'rd' ELSE 'th' END AS nth FROM v_match""", "v_match",
))
def ordinals_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal numbers, and scores written and read back."""
    score = text.score_text(F.col("home_goals"), F.col("away_goals"))
    return v_match(spark, sf).select(
        "match_id",
        score.alias("score"),
        (text.score_part(score, 0) == F.col("home_goals")).alias("same"),
        text.ordinal(F.col("match_id") % 200).alias("nth"),
    )


@register("""SELECT p_partkey, p_name,
    CASE WHEN length(long_name) > 30 THEN left(long_name, 28) || '…' ELSE long_name END AS shown,
    upper(left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1) || left(p_brand, 1)) AS initials
    FROM (SELECT *, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_partkey AS long_name FROM part)""")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    """Long names cut for display, and initials."""
    full = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", "p_name", names.shorten(full).alias("shown"), names.initials(full).alias("initials")
    )


# --- incremental work ------------------------------------------------------

@register(sql("SELECT match_id, season FROM v_match WHERE home_goals <= away_goals", "v_match"))
def unseen_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that were not worked on yet, where the home wins were."""
    matches = v_match(spark, sf).select("match_id", "season")
    done = v_match(spark, sf).filter(F.col("home_goals") > F.col("away_goals"))
    return incremental.unseen(matches, done, ["match_id"])


@register(sql(
    """SELECT match_id, season, CASE WHEN home_goals <= away_goals THEN 'new' ELSE 'old' END AS version
       FROM v_match""", "v_match",
))
def regenerate(spark: SparkSession, sf: str) -> DataFrame:
    """Home wins and draws exist; draws are made again and away wins are new."""
    rows, lead = v_match(spark, sf), F.col("home_goals") - F.col("away_goals")
    old = rows.filter(lead >= 0).select("match_id", "season", F.lit("old").alias("version"))
    new = rows.filter(lead <= 0).select("match_id", "season", F.lit("new").alias("version"))
    return incremental.regenerate(old, new, ["match_id"])


@register(sql("""SELECT match_id, home_fd, away_fd, content_type, highlight_idx FROM said
    WHERE NOT regexp_matches(home_fd, '(?i)team 1') AND NOT regexp_matches(away_fd, '(?i)team 1')""", "said"))
def texts_without_team(spark: SparkSession, sf: str) -> DataFrame:
    """Existing texts except those of one team, as before they are made again."""
    return incremental.without_team(texts_of(spark, sf), "team 1").drop("commentary")


@register(sql("""SELECT match_id, content_type, highlight_idx FROM said
    WHERE regexp_matches(home_fd, '(?i)TEAM 2') OR regexp_matches(away_fd, '(?i)TEAM 2')""", "said"))
def texts_of_team(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the matches of a team."""
    found = voice.texts_of_team(texts_of(spark, sf), "TEAM 2")
    return found.select("match_id", "content_type", "highlight_idx")


# --- stream ----------------------------------------------------------------


def event_files(spark: SparkSession, sf: str) -> DataFrame:
    """The events as they arrive: one file, or the part files of a folder."""
    return feed_columns(feed_base(spark.readStream.schema(COLUMNS["events"]).parquet(f"{sf}/events.parquet*")))


@register(sql(
    """SELECT match_id, event_id, index, CASE WHEN type = 'Shot' THEN 'goal' ELSE 'red_card' END AS event_type, player, team,
       minute, CASE WHEN type = 'Shot' THEN CAST(round(CAST(shot_xg AS DECIMAL(18,6)), 3) AS DOUBLE) ELSE 0.0 END AS xg
       FROM ev WHERE (type = 'Shot' AND shot_outcome = 'Goal')
         OR coalesce(bad_behaviour_card, foul_committed_card) IN ('Red Card', 'Second Yellow')""", "ev",
))
def key_events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Goals and dismissals found by a stream over the event files."""
    folder = stage_run_folder(spark, "key_events_stream")
    store_key_events(event_files(spark, sf), f"{folder}/rows", "progress", folder=folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@register(sql("SELECT match_id, event_id, index, type, team, player, minute FROM ev", "ev"))
def unseen_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events, where those of every third match were stored before the stream began."""
    folder = stage_run_folder(spark, "unseen_stream")
    columns = ["match_id", "event_id", "index", "type", "team", "player", "minute"]
    feed_events(spark, sf).select(*columns).filter("match_id % 3 = 0").write.parquet(f"{folder}/rows")
    append_unseen(
        event_files(spark, sf).select(*columns), f"{folder}/rows", ["match_id", "event_id"], "progress", folder=folder,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@register(sql(
    """SELECT upper(translate(player, 'aeiouc', 'áêïőüč')) AS player, min(player) AS alike_name, count(*) AS passes
       FROM ev WHERE type = 'Pass' AND player IS NOT NULL GROUP BY 1""", "ev",
))
def alike_names(spark: SparkSession, sf: str) -> DataFrame:
    """Players written with accents and capitals, found by the plain spelling of the feed."""
    passes = feed_events(spark, sf).filter((F.col("type") == "Pass") & F.col("player").isNotNull())
    plain = passes.groupBy(F.col("player").alias("name")).agg(F.count("*").alias("passes"))
    accented = plain.select(F.upper(F.translate("name", "aeiouc", "áêïőüč")).alias("player"))
    return lookup.by_alike_name(accented, plain.withColumn("ord", F.xxhash64("name")), "player", "inner")
