"""Landed feed files: matches, events and line-ups as JSON.

One read covers all files.  Values that are an object with a ``name`` in one
feed version and plain text in another are read as text and resolved by
``name_of``.  Rows that do not parse are kept apart, see ``rejects``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.conform import name_of
from touchline.schemas import EVENTS, MATCHES, names
from touchline.sources.tables import _or_empty

# Field names of the feed.
XG_FIELD = "statsbomb_xg"
CORRUPT = "_corrupt_record"

EVENT_FILE = (
    "id string, index bigint, period int, minute int, type string, team string, player string, "
    "location array<double>, play_pattern string, "
    f"shot struct<{XG_FIELD}: double, outcome: string, technique: string, body_part: string, "
    "type: string, key_pass_id: string>, "
    "pass struct<cross: boolean>, "
    "substitution struct<replacement: string>, "
    "bad_behaviour struct<card: string>, foul_committed struct<card: string>, "
    f"{CORRUPT} string"
)

_COUNTRY = "country: struct<id: int, name: string>"
_MANAGER = f"struct<id: int, name: string, nickname: string, dob: string, {_COUNTRY}>"


def _team(side: str) -> str:
    return (
        f"{side}_team struct<{side}_team_id: int, {side}_team_name: string, {side}_team_gender: string, "
        f"{side}_team_group: string, {_COUNTRY}, managers: array<{_MANAGER}>>"
    )


# Stamps and versions are read as text, so that an odd one costs no row.
MATCH_FILE = (
    "match_id bigint, match_date date, kick_off string, match_week int, "
    "competition struct<competition_id: int, country_name: string, competition_name: string>, "
    "season struct<season_id: int, season_name: string>, "
    f"{_team('home')}, {_team('away')}, "
    "home_score int, away_score int, match_status string, match_status_360 string, "
    "last_updated string, last_updated_360 string, "
    "competition_stage struct<id: int, name: string>, "
    f"stadium struct<id: int, name: string, {_COUNTRY}>, referee struct<id: int, name: string, {_COUNTRY}>, "
    "metadata struct<data_version: string, shot_fidelity_version: string, xy_fidelity_version: string>, "
    f"{CORRUPT} string"
)

LINEUP_FILE = (
    "team_id int, team_name string, "
    "lineup array<struct<player_name: string, positions: array<struct<position: string>>>>, "
    f"{CORRUPT} string"
)


def _of_file(df: DataFrame) -> DataFrame:
    """Rows with the file they come from."""
    return df.withColumn("file_name", F.col("_metadata.file_name")).withColumn("file_path", F.col("_metadata.file_path"))


def _read(spark: SparkSession, path: str | Sequence[str], schema: str, multi_line: bool) -> DataFrame:
    reader = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    paths = path if isinstance(path, str) else list(path)
    return _or_empty(
        spark,
        lambda: _of_file(reader.json(paths)),
        f"{schema}, file_name string, file_path string",
    )


def _match_of_file():
    """Match out of the folder (``match_id=7/``) a file lies in, else out of its name (``7.json``)."""
    folder = F.regexp_extract("file_path", r"/match_id=([0-9]+)/[^/]*$", 1)
    name = F.regexp_extract("file_name", r"([0-9]+)\.json$", 1)
    return F.coalesce(folder.try_cast("bigint"), name.try_cast("bigint"))


def events_from(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Typed events out of event-file rows; ``raw`` may be a stream."""
    return raw.filter(F.col(CORRUPT).isNull()).select(
        _match_of_file().alias("match_id"),
        F.col("id").alias("event_id"),
        "index", "period", "minute",
        *[name_of(F.col(c)).alias(c) for c in ("type", "team", "player")],
        "location",
        F.col(f"shot.{XG_FIELD}").alias("shot_xg"),
        *[
            name_of(F.col(f"shot.{c}")).alias(f"shot_{c}")
            for c in ("outcome", "technique", "body_part", "type")
        ],
        F.col("shot.key_pass_id").alias("key_pass_id"),
        name_of(F.col("play_pattern")).alias("play_pattern"),
        F.col("pass.cross").alias("pass_cross"),
        name_of(F.col("substitution.replacement")).alias("substitution_replacement"),
        name_of(F.col("bad_behaviour.card")).alias("bad_behaviour_card"),
        name_of(F.col("foul_committed.card")).alias("foul_committed_card"),
        *extra,
    ).select(*names(EVENTS), *extra)


def read_event_files(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Raw rows of all event files; ``multi_line=False`` for one object per line, which Spark can split."""
    return _read(spark, path, EVENT_FILE, multi_line)


def read_events(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    return events_from(read_event_files(spark, path, multi_line))


def rejects(raw: DataFrame) -> DataFrame:
    """Files and texts that could not be read, for a table of their own.

    The first field goes along, as Spark does not read the record text alone.
    """
    return raw.filter(F.col(CORRUPT).isNotNull()).select(
        "file_name", F.col(raw.columns[0]).cast("string").alias("first_field"), F.col(CORRUPT).alias("record")
    )


def stream_events(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Events as their files arrive, with the arrival time of the file."""
    files = (
        spark.readStream.schema(EVENT_FILE)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    raw = _of_file(files).withColumn("arrived_at", F.col("_metadata.file_modification_time"))
    return events_from(raw, extra=("arrived_at",))


def _place_columns(name: str, country: bool = False) -> list:
    """Id and name of a nested object, and those of its country."""
    columns = [F.col(f"{name}.id").alias(f"{name}_id"), F.col(f"{name}.name").alias(name)]
    if country:
        columns += [
            F.col(f"{name}.country.id").alias(f"{name}_country_id"),
            F.col(f"{name}.country.name").alias(f"{name}_country_name"),
        ]
    return columns


def _team_columns(side: str) -> list:
    team = f"{side}_team"
    return [
        F.col(f"{team}.{team}_id").alias(f"{team}_id"), F.col(f"{team}.{team}_name").alias(team),
        F.col(f"{team}.{team}_gender").alias(f"{team}_gender"), F.col(f"{team}.{team}_group").alias(f"{team}_group"),
        F.col(f"{team}.country.id").alias(f"{team}_country_id"),
        F.col(f"{team}.country.name").alias(f"{team}_country_name"),
    ]


def _manager_columns(side: str) -> list:
    """Names of all managers, and the fields of the first one."""
    managers, manager = F.col(f"{side}_team.managers"), f"{side}_manager"
    first = F.get(managers, F.lit(0))
    return [
        F.array_join(managers["name"], ", ").alias(f"{side}_managers"),
        *[first[c].alias(f"{manager}_{c}") for c in ("id", "name", "nickname")],
        first["dob"].try_cast("date").alias(f"{manager}_dob"),
        first["country"]["id"].alias(f"{manager}_country_id"), first["country"]["name"].alias(f"{manager}_country_name"),
    ]


def read_matches(
    spark: SparkSession,
    path: str | Sequence[str],
    competition_id: int | None = None,
    season_id: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Match list, optionally of one competition or season."""
    raw = _read(spark, path, MATCH_FILE, multi_line).filter(F.col(CORRUPT).isNull())
    flat = raw.select(
        "match_id", "match_date", "kick_off", "home_score", "away_score", "match_status", "match_status_360",
        *[F.col(c).try_cast("timestamp_ntz").alias(c) for c in ("last_updated", "last_updated_360")], "match_week",
        "competition.competition_id",
        F.col("competition.country_name").alias("competition_country_name"),
        "competition.competition_name",
        F.col("competition.competition_name").alias("competition"),
        "season.season_id",
        F.col("season.season_name").alias("season"),
        *[column for side in ("home", "away") for column in _team_columns(side)],
        *_place_columns("competition_stage"), *_place_columns("stadium", True), *_place_columns("referee", True),
        *[column for side in ("home", "away") for column in _manager_columns(side)],
        "metadata.data_version",
        *[F.col(f"metadata.{c}").try_cast("int").alias(c) for c in ("shot_fidelity_version", "xy_fidelity_version")],
    )
    # In the order of the declared table; names in use are added when they are conformed.
    flat = flat.select(*[c for c in names(MATCHES) if c not in ("home_fd", "away_fd")])
    if competition_id is not None:
        flat = flat.filter(F.col("competition_id") == competition_id)
    if season_id is not None:
        flat = flat.filter(F.col("season_id") == season_id)
    return flat


def read_lineups(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Line-ups, one row per match and team."""
    raw = _read(spark, path, LINEUP_FILE, multi_line).filter(F.col(CORRUPT).isNull())
    return raw.select(_match_of_file().alias("match_id"), F.col("team_name").alias("team"), "lineup")
