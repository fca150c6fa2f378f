"""The end-to-end jobs on small landed files, and the streams over them."""

import csv
import itertools
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from touchline import dimensions, schemas
from touchline.catalog.views import COLUMNS, feed_base, feed_columns, feed_events
from touchline.operators.results import COUNT_COLUMNS, IDENTITY_COLUMNS, ODDS_COLUMNS
from touchline.plans import detail, ingest, narration, season
from touchline.sources import assets, landed, tables
from touchline.streaming.key_events import key_event_stream, store_key_events
from touchline.streaming import unseen as streaming_unseen
from touchline.streaming.unseen import append_unseen

HOME, AWAY = "Bayer Leverkusen", "VfB Stuttgart"


def named(name, **more):
    return {"id": 1, "name": name, **more}


def event(index, kind, minute, team=HOME, player="Patrik Schick", **more):
    return {
        "id": f"id-{more.pop('match', 0)}-{index}", "index": index, "period": 1 + (minute > 45), "minute": minute,
        "type": named(kind), "team": named(team), "player": named(player), "play_pattern": named("Regular Play"), **more,
    }


def shot(outcome, xg=0.2, **more):
    return {"shot": {"statsbomb_xg": xg, "outcome": named(outcome), "technique": named("Normal"), "body_part": named("Head"),
                     "type": named("Open Play"), **more}, "location": [110.0, 40.0]}


def match_events(match):
    return [
        event(1, "Pass", 1, player="Granit Xhaka", match=match, **{"pass": {"cross": True}}),
        event(2, "Shot", 10, match=match, **shot("Goal", 0.44, key_pass_id=f"id-{match}-1")),
        event(3, "Shot", 20, team=AWAY, player="Serhou Guirassy", match=match, **shot("Saved")),
        event(4, "Foul Committed", 60, team=AWAY, player="Waldemar Anton", match=match,
              foul_committed={"card": named("Second Yellow")}),
        event(5, "Substitution", 70, match=match, substitution={"replacement": named("Adam Hlozek")}),
        event(6, "Shot", 80, player="Adam Hlozek", match=match, **shot("Goal", 0.06)),
        event(7, "Pass", 94, match=match, player="Granit Xhaka"),
    ]


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    for folder in ("matches/9", "events", "lineups"):
        (root / folder).mkdir(parents=True)

    def listed(match, home, away, week):
        return {
            "match_id": match, "match_date": f"2024-0{match}-01", "kick_off": "15:30:00.000", "match_week": week,
            "competition": {"competition_id": 9, "country_name": "Germany", "competition_name": "League"},
            "season": {"season_id": 281, "season_name": "2023/2024"},
            "home_team": {"home_team_id": 1, "home_team_name": home}, "away_team": {"away_team_id": 2, "away_team_name": away},
            "home_score": 2, "away_score": 0, "match_status": "available",
        }

    matches = [listed(1, HOME, AWAY, 29), listed(2, AWAY, HOME, 34)]
    (root / "matches/9/281.json").write_text(json.dumps(matches))
    for match in (1, 2):
        (root / f"events/{match}.json").write_text(json.dumps(match_events(match)))
        lineup = [{"team_id": 1, "team_name": HOME, "lineup": [
            {"player_name": "Patrik Schick", "positions": [{"position": "Centre Forward"}, {"position": "Left Wing"}]},
            {"player_name": "Granit Xhaka", "positions": []},
        ]}]
        (root / f"lineups/{match}.json").write_text(json.dumps(lineup))
    (root / "events/3.json").write_text("{ not json")
    return root


@pytest.fixture(scope="module")
def built(spark, landing, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    counts = {r["table_name"]: r["rows"] for r in ingest.build(spark, str(landing), out).collect()}
    detail.build(spark, out)
    return out, counts


def test_ingest_report_and_single_parse(spark, landing, tmp_path, rows, monkeypatch):
    """Goals and dismissals come with the counts; the events are parsed in one scan of the files."""
    read = []
    kept = landed.read_event_files

    def counted(*args):
        raw = kept(*args)
        # A scan leaves a mark per row it parses.
        marks = spark.sparkContext.accumulator(0)
        read.append(marks)
        return spark.createDataFrame(raw.rdd.map(lambda row: marks.add(1) or row), raw.schema)

    monkeypatch.setattr(landed, "read_event_files", counted)
    made = ingest.build(spark, str(landing), str(tmp_path / "out"))
    assert rows(made, "table_name", "rows", "goals", "reds") == [
        ("events", 14, None, None), ("key_events", 6, 4, 2), ("matches", 2, None, None), ("players", 10, None, None),
        ("rejects", 1, None, None), ("shots", 6, 4, None), ("xg_by_match", 2, None, None),
    ]
    assert [marks.value for marks in read] == [15]
    empty = ingest.build(spark, str(tmp_path / "nothing"), str(tmp_path / "none"))
    assert {r["rows"] for r in empty.collect()} == {0}


def test_ingest(spark, built, rows):
    out, counts = built
    assert counts == {
        "matches": 2, "events": 14, "rejects": 1, "xg_by_match": 2, "shots": 6, "key_events": 6, "players": 10,
    }
    made = spark.read.parquet(f"{out}/shots").filter("match_id = 1")
    assert rows(made, "index", "team_fd", "player", "score_after", "x") == [
        (2, "Leverkusen", "Patrik Schick", "1-0", 110.0), (3, "Stuttgart", "Serhou Guirassy", "1-0", 110.0),
        (6, "Leverkusen", "Adam Hlozek", "2-0", 110.0),
    ]
    xg = spark.read.parquet(f"{out}/xg_by_match")
    # In match 2 the teams have changed sides.
    assert rows(xg, "match_id", "home_xg", "away_xg") == [(1, 0.5, 0.2), (2, 0.2, 0.5)]
    players = spark.read.parquet(f"{out}/players").filter("match_id = 1")
    assert rows(players, "player_name", "minutes", "goals", "position") == [
        ("Adam Hlozek", 24, 1, ""), ("Granit Xhaka", 94, 0, ""), ("Patrik Schick", 70, 1, "Centre Forward"),
        ("Serhou Guirassy", 94, 0, ""), ("Waldemar Anton", 60, 0, ""),
    ]
    assert ingest.unmapped(spark, out).count() == 0
    before = rows(spark.read.parquet(f"{out}/shots"))
    ingest.rebuild_shots(spark, out)
    ingest.rebuild_key_events(spark, out)
    assert rows(spark.read.parquet(f"{out}/shots")) == before
    assert ingest.match_of(spark.read.parquet(f"{out}/key_events"), 1).count() == 3


def test_detail(spark, built):
    out, _ = built
    found = detail.highlights_of(spark, out, 1).collect()
    assert [(r["label"], r["item_type"], r["minute"]) for r in found] == [
        ("Highlight 1 / 4", "shot", 10), ("Highlight 2 / 4", "shot", 20),
        ("Highlight 3 / 4", "red_card", 60), ("Highlight 4 / 4", "shot", 80),
    ]
    assert found[2]["score_at"] == "1-0"
    shown = {r["player"]: (r["icons"], r["minutes_text"], r["slot"]) for r in detail.lineups_of(spark, out, 1).collect()}
    assert shown["Waldemar Anton"] == ("🟥", "60'", 2)
    assert shown["Adam Hlozek"] == ("⚽", "24'", 3)


def test_prompts_only_for_new_matches(spark, built, rows):
    out, _ = built
    kwargs = {"focus_team": "Leverkusen", "nickname": "Die Werkself", "stadium": "the BayArena"}
    narration.build_prompts(spark, out, **kwargs)
    table = spark.read.parquet(f"{out}/prompts")
    first = rows(table)
    assert table.groupBy("match_id").count().collect()[0]["count"] == 5 and len(first) == 10
    intro = table.filter("match_id = 2 and content_type = 'intro'").first()["prompt"]
    assert "completes a whole season unbeaten for Leverkusen" in intro and "Round 34" in intro
    narration.build_prompts(spark, out, **kwargs)
    assert rows(spark.read.parquet(f"{out}/prompts")) == first
    narration.build_prompts(spark, out, again=True, **kwargs)
    assert rows(spark.read.parquet(f"{out}/prompts")) == first


def test_season_record_takes_all_stored_matches(spark, tmp_path, rows):
    """A mid-table focus team and a later run over the last round get the texts of one run over everything."""
    games = [  # home, away, scorers by team; the season of the other league is longer
        (1, 9, 1, "A", "B", "A"), (2, 9, 1, "C", "D", "CD"), (3, 9, 2, "A", "C", "A"), (4, 9, 2, "B", "D", "B"),
        (5, 9, 3, "D", "A", "A"), (6, 9, 3, "B", "C", "B"), (7, 10, 3, "E", "F", "F"), (8, 10, 4, "F", "E", "F"),
    ]
    folders = {"last": tmp_path / "last", "first": tmp_path / "first"}
    for name, root in folders.items():
        for folder in ("matches", "events", "lineups"):
            (root / folder).mkdir(parents=True)
        for match, league, week, home, away, scorers in games:
            if name == "first" and match in (5, 6, 8):
                continue
            (root / f"matches/{match}.json").write_text(json.dumps([{
                "match_id": match, "match_date": f"2024-01-0{week}", "match_week": week,
                "competition": {"competition_id": league, "competition_name": f"League {league}"},
                "season": {"season_id": 281, "season_name": "2023/2024"},
                "home_team": {"home_team_id": 1, "home_team_name": home}, "away_team": {"away_team_id": 2, "away_team_name": away},
            }]))
            (root / f"events/{match}.json").write_text(json.dumps([
                event(i + 1, "Shot", 20 + i, team=t, player=f"p{t}", match=match, **shot("Goal")) for i, t in enumerate(scorers)
            ]))
            (root / f"lineups/{match}.json").write_text("[]")

    def build(out, landing):
        ingest.build(spark, str(landing), out)
        detail.build(spark, out)

    whole, focus, later = (str(tmp_path / x) for x in ("whole", "focus", "later"))
    for out in (whole, focus):
        build(out, folders["last"])
    narration.build_prompts(spark, whole)
    texts = rows(spark.read.parquet(f"{whole}/prompts"))
    intro = {(r[0], r[1]): r[8] for r in texts if r[2] == "intro"}
    assert {k for k, v in intro.items() if "champions" in v} == {(5, "A"), (8, "F")}
    assert {k for k, v in intro.items() if "unbeaten" in v} == {(5, "A"), (8, "F")}
    narration.build_prompts(spark, focus, focus_team="B")
    assert rows(spark.read.parquet(f"{focus}/prompts")) == [r for r in texts if r[1] == "B"]
    narration.build_prompts(spark, focus, focus_team="B", opponent="C", again=True)
    assert rows(spark.read.parquet(f"{focus}/prompts")) == [r for r in texts if r[1] == "B"]
    # The season goes on after the first run.
    build(later, folders["first"])
    narration.build_prompts(spark, later, final_round=3)
    build(later, folders["last"])
    narration.build_prompts(spark, later)
    last = (5, 6, 8)
    found = rows(spark.read.parquet(f"{later}/prompts"))
    assert [r for r in found if r[0] in last] == [r for r in texts if r[0] in last]
    assert [r for r in found if r[1] in "ABCD"] == [r for r in texts if r[1] in "ABCD"]


def test_matches_done_again_rewrite_only_their_folders(spark, tmp_path, rows, monkeypatch):
    out = str(tmp_path / "out")
    for match, league, home, away in ((1, 9, "A", "B"), (2, 9, "C", "D"), (3, 10, "E", "F")):
        for folder in ("matches", "events", "lineups"):
            (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / f"matches/{match}.json").write_text(json.dumps([{
            "match_id": match, "match_date": f"2024-01-0{match}", "match_week": 1,
            "competition": {"competition_id": league, "competition_name": f"League {league}"},
            "season": {"season_id": 281, "season_name": "2023/2024"},
            "home_team": {"home_team_id": 1, "home_team_name": home}, "away_team": {"away_team_id": 2, "away_team_name": away},
        }]))
        (tmp_path / f"events/{match}.json").write_text(json.dumps([
            event(1, "Shot", 20, team=home, player=f"p{home}", match=match, **shot("Goal")),
        ]))
        (tmp_path / f"lineups/{match}.json").write_text("[]")
    ingest.build(spark, str(tmp_path), out)
    detail.build(spark, out)
    narration.build_prompts(spark, out)
    files = lambda: {p for p in (tmp_path / "out/prompts").rglob("*.parquet")}
    first, texts = files(), rows(spark.read.parquet(f"{out}/prompts"))
    assert {r[0] for r in texts} == {1, 2, 3}
    narration.build_prompts(spark, out, focus_team="A", again=True)
    changed = {p.parent for p in first - files()}
    of_match = lambda m: {
        (r["season"], r["bucket"]) for r in spark.read.parquet(f"{out}/prompts").filter(F.col("match_id") == m).collect()
    }
    assert len(changed) == 1 and of_match(1) != of_match(3)
    now = rows(spark.read.parquet(f"{out}/prompts"))
    assert [r for r in now if r[0] != 1] == [r for r in texts if r[0] != 1]
    assert [r for r in now if r[0] == 1] == [r for r in texts if r[:2] == (1, "A")]

    # A run that ends before the folders are exchanged leaves all prompts.
    def stopped(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(narration, "write_table", stopped)
    with pytest.raises(RuntimeError):
        narration.build_prompts(spark, out, again=True)
    assert rows(spark.read.parquet(f"{out}/prompts")) == now


def test_voice_queue(spark, built, tmp_path, rows):
    out, _ = built
    texts = spark.createDataFrame(
        [(1, "M'gladbach", "Mainz", 1, "intro", -1, "", 0, 0, "intro", "It is 3-1 now"),
         (1, "M'gladbach", "Mainz", 1, "highlight", 0, "", 0, 0, "shot", "What a goal")], schemas.COMMENTARY
    )
    audio = tmp_path / "audio"
    audio.mkdir()
    (audio / "Mgladbach_vs_Mainz_highlight_0.mp3").write_bytes(b"abc")
    counts = narration.build_voice_queue(spark, texts, str(audio), out, "mainz")
    assert rows(counts) == [("present", 1), ("queued", 1)]
    assert rows(spark.read.parquet(f"{out}/voice_queue")) == [("Mgladbach_vs_Mainz_intro_-1.mp3", "It is three-one now")]
    assert rows(assets.list_assets(spark, str(audio))) == [("Mgladbach_vs_Mainz_highlight_0.mp3", 3)]


def test_season(spark, tmp_path, rows):
    header = [*IDENTITY_COLUMNS, "Extra", *COUNT_COLUMNS, *ODDS_COLUMNS]
    games = [("02/01/2024", "A", "B", 1, 0), ("01/01/2024", "C", "D", 2, 2), ("09/01/2024", "B", "C", 0, 3),
             ("08/01/2024", "D", "A", 1, 1)]
    folder = tmp_path / "results"
    folder.mkdir()
    for name in ("s1.csv", "s2.csv"):
        with open(folder / name, "w", newline="") as file:
            writer = csv.DictWriter(file, header, restval="1")
            writer.writeheader()
            for day, home, away, hg, ag in games:
                writer.writerow({"Date": day, "HomeTeam": home, "AwayTeam": away, "FTHG": hg, "FTAG": ag})
    out = str(tmp_path / "out")
    season.build(spark, str(folder), out, per_round=2)
    table = tables.read_round(spark, f"{out}/standings", 2).filter("source_file = 's1.csv'")
    assert [(r["team"], r["pts"], r["gd"]) for r in table.orderBy("position").collect()] == [
        ("C", 4, 3), ("A", 4, 1), ("D", 2, 0), ("B", 0, -4),
    ]
    plan = table._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(round" in plan
    assert spark.read.parquet(f"{out}/results").groupBy("source_file", "round").count().count() == 4
    listed = dimensions.season_scorers(spark).select("ord", "name", "team", "goals", F.lit("s1.csv").alias("source_file"))
    shots = spark.createDataFrame(
        [(7, 1, "X Wirtz", "Leverkusen", 1), (7, 2, "X Wirtz", "Leverkusen", 0)],
        "match_id bigint, index bigint, player string, team_fd string, is_goal int",
    )
    rounds = spark.createDataFrame([("s1.csv", 7, 1)], "source_file string, match_id bigint, round int")
    season.build_scorers(spark, out, listed, "Leverkusen", shots, rounds)
    top = tables.read_round(spark, f"{out}/top_scorers", 1)
    assert top.count() == 20
    assert rows(top.filter("name in ('Harry Kane', 'Florian Wirtz')"), "name", "goals") == [
        ("Harry Kane", 18),
    ]
    nested = tables.nested_by_round(spark.read.parquet(f"{out}/standings"), ["source_file"], "position")
    assert json.loads(nested.filter("round = 1").first()["rows"])[0]["position"] == 1


def results_csv(path, games):
    header = [*IDENTITY_COLUMNS, *COUNT_COLUMNS, *ODDS_COLUMNS]
    with open(path, "w", newline="") as file:
        writer = csv.DictWriter(file, header, restval="1")
        writer.writeheader()
        for day, home, away, hg, ag in games:
            writer.writerow({"Date": f"{day:02d}/01/2024", "HomeTeam": home, "AwayTeam": away, "FTHG": hg, "FTAG": ag})


def files_of(out, table):
    return {path.name for folder in ("round=1", "round=2") for path in (out / table / folder).glob("*.parquet")}


def test_season_extended_equals_built(spark, tmp_path, rows):
    """Rounds added one file at a time, a late result and a repeated run against one build of all."""
    draw = random.Random(5)
    pairs = list(itertools.permutations("ABCDEF", 2))
    games = {
        name: [(1 + i // 3, *pair, draw.randrange(4), draw.randrange(4)) for i, pair in enumerate(draw.sample(pairs, 24))]
        for name in ("s1.csv", "s2.csv")
    }
    games["s2.csv"] = games["s2.csv"][:8]
    late = (6, "G", "A", 2, 0)  # a new team, given after the matches of later days
    steps = [
        {"s1.csv": games["s1.csv"][:13], "s2.csv": games["s2.csv"]},
        {"s1.csv": games["s1.csv"][15:]},
        {"s1.csv": games["s1.csv"][13:15] + [late]},
        {"s3.csv": games["s1.csv"][:4]},  # a season of its own
    ]
    out = tmp_path / "grown"
    for at, step in enumerate(steps):
        folder = tmp_path / f"step{at}"
        folder.mkdir()
        for name, listed in step.items():
            results_csv(folder / name, listed)
        if at == 0:
            season.build(spark, str(folder), str(out), per_round=3)
            first = files_of(out, "results"), files_of(out, "standings")
        else:
            season.extend(spark, str(folder), str(out), per_round=3)
        if at == 2:
            assert (files_of(out, "results"), files_of(out, "standings")) == first
            season.extend(spark, str(folder), str(out), per_round=3)
    whole = tmp_path / "whole"
    whole.mkdir()
    # Matches of day 5 and 6 came after those of later days, and stand at the end of their day.
    results_csv(whole / "s1.csv", [*games["s1.csv"], late])
    results_csv(whole / "s2.csv", games["s2.csv"])
    results_csv(whole / "s3.csv", games["s1.csv"][:4])
    season.build(spark, str(whole), str(tmp_path / "built"), per_round=3)
    for table, dropped in (("results", "source_row"), ("standings", "no"), ("rounds", "no")):
        made, right = (spark.read.parquet(str(tmp_path / name / table)).drop(dropped) for name in ("grown", "built"))
        columns = sorted(right.columns)
        assert sorted(made.columns) == columns
        assert rows(made, *columns) == rows(right, *columns), table


def test_folders_of_many_rounds(spark, tmp_path, rows):
    """Folders grow with the logarithm of the rounds; one round is read out of one, and a null one is kept."""
    path = str(tmp_path / "many")
    df = spark.range(1, 5001).select(F.col("id").cast("int").alias("round"), (F.col("id") * 2).alias("v"))
    df = df.unionAll(spark.createDataFrame([(None, 7)], "round int, v bigint"))
    tables.write_by_round(df, path)
    names = {folder.name for folder in (tmp_path / "many").glob("round=*")}
    assert {f"round={n}" for n in range(1, 65)} <= names and len(names) <= 64 + 32 * 7 + 1
    assert rows(tables.read_by_round(spark, path), "round", "v") == rows(df)
    for n in (1, 17, 64, 65, 66, 127, 128, 129, 3001, 5000):
        one = tables.read_round(spark, path, n)
        assert rows(one, "round", "v") == [(n, 2 * n)]
        assert {f.rsplit("/", 2)[1] for (f,) in one.select(F.input_file_name()).collect()} == {f"round={tables.first_of_folder(n)}"}
    assert rows(tables.read_by_round(spark, path, 70, 2000), "round") == sorted(((n,) for n in range(70, 2001)), key=str)


@pytest.mark.parametrize("old", [False, True])
def test_season_of_many_rounds_extended(spark, tmp_path, rows, old):
    """A late result and new rounds in folders of several rounds, and in tables stored with a folder for each."""
    games = [(1 + i // 5, *pair, i % 4, i % 3) for i, pair in enumerate(itertools.permutations("ABCDEFGHIJKLM", 2))][:150]
    late = (20, "Y", "Z", 1, 0)
    parts = {"built": [*games[:100], late, *games[100:]], "grown": games[:130]}
    for name, listed in parts.items():
        (tmp_path / f"{name}_in").mkdir()
        results_csv(tmp_path / f"{name}_in" / "s1.csv", listed)
        results_csv(tmp_path / f"{name}_in" / "s2.csv", games[:90])
        season.build(spark, str(tmp_path / f"{name}_in"), str(tmp_path / name), per_round=1)
    grown = tmp_path / "grown"
    if old:
        for table in ("results", "standings", "rounds"):
            tables.read_by_round(spark, str(grown / table)).write.partitionBy("round").parquet(str(tmp_path / "old" / table))
        grown = tmp_path / "old"
    more = tmp_path / "more"
    more.mkdir()
    results_csv(more / "s1.csv", [late, *games[130:]])
    season.extend(spark, str(more), str(grown), per_round=1)
    for table, dropped in (("results", "source_row"), ("standings", "no"), ("rounds", "no")):
        made, right = (tables.read_by_round(spark, str(out / table)).drop(dropped) for out in (grown, tmp_path / "built"))
        assert rows(made, *sorted(right.columns)) == rows(right, *sorted(right.columns)), table


def test_season_extended_reads_changed_rounds(spark, tmp_path, rows):
    folder = tmp_path / "more"
    folder.mkdir()
    results_csv(folder / "s1.csv", [(day, "A", "B", 1, 0) for day in range(1, 10)])
    out = str(tmp_path / "out")
    season.build(spark, str(folder), out, per_round=1)
    # Rounds before the last full one are not opened, save the first one for the schema: they hold no table any more.
    for table in ("results", "standings"):
        for gone in range(2, 8):
            for file in (tmp_path / "out" / table / f"round={gone}").glob("*.parquet"):
                file.write_bytes(b"")
    results_csv(folder / "s1.csv", [(10, "A", "B", 0, 3)])
    season.extend(spark, str(folder), out, per_round=1)
    last = tables.read_round(spark, f"{out}/standings", 10)
    assert rows(last, "team", "played", "won", "gf", "ga") == [("A", 10, 9, 9, 3), ("B", 10, 1, 3, 9)]
    results_csv(folder / "s1.csv", [])
    season.extend(spark, str(folder), out, per_round=1)  # nothing new: nothing changes


def test_missing_sources_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert tables.read_table(spark, gone, schemas.SHOTS).columns == schemas.names(schemas.SHOTS)
    assert tables.read_csv(spark, gone, schemas.KEY_EVENTS_CSV).count() == 0
    assert landed.read_events(spark, gone).count() == 0
    assert assets.list_assets(spark, gone).count() == 0


def test_csv_export_reads_back(spark, built, tmp_path, rows):
    out, _ = built
    xg = spark.read.parquet(f"{out}/xg_by_match")
    tables.write_csv(xg, str(tmp_path / "xg"))
    assert rows(tables.read_csv(spark, str(tmp_path / "xg"), schemas.XG_BY_MATCH)) == rows(xg)


def test_matches_of_another_season(spark, landing):
    assert landed.read_matches(spark, str(landing / "matches"), season_id=281).count() == 2
    assert landed.read_matches(spark, str(landing / "matches"), competition_id=10).count() == 0


def test_key_event_stream_drops_repeats(spark, landing, tmp_path, rows):
    arriving = tmp_path / "arriving"
    arriving.mkdir()

    def run():
        stream = landed.stream_events(spark, str(arriving))
        store_key_events(stream, str(tmp_path / "out"), "progress", folder=str(tmp_path)).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")), "match_id", "index", "event_type")

    (arriving / "1.json").write_text((landing / "events/1.json").read_text())
    one = [(1, 2, "goal"), (1, 4, "red_card"), (1, 6, "goal")]
    assert run() == one
    # The same match is delivered once more, with another one.
    (arriving / "again-1.json").write_text((landing / "events/1.json").read_text())
    (arriving / "2.json").write_text((landing / "events/2.json").read_text())
    assert run() == one + [(2, 2, "goal"), (2, 4, "red_card"), (2, 6, "goal")]


def test_unseen_stream_adds_each_match_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "done")
    schema = "match_id bigint, v string"
    spark.createDataFrame([(1, "a"), (1, "b")], schema).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        append_unseen(stream, target, ["match_id", "v"], f"unseen-{tmp_path.name}").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(target).collect()))

    assert run() == [(1, "a"), (1, "b")]
    late = [(1, "late"), (2, "c"), (2, "c"), (1, "a")]
    spark.createDataFrame(late, schema).write.mode("append").parquet(source)
    assert run() == [(1, "a"), (1, "b"), (1, "late"), (2, "c")]


def test_stream_batches_do_not_read_the_table(spark, tmp_path, monkeypatch):
    """Stored rows are read once a run; a run that was stopped halfway adds nothing twice."""
    source, target = str(tmp_path / "in"), str(tmp_path / "done")
    schema = "match_id bigint, v string"
    spark.createDataFrame([(0, "before"), (1, "a")], schema).write.parquet(target)
    for i in range(6):
        rows = [(i, "a"), (i, "b"), (0, "before"), (max(i - 1, 0), "b")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    read, kept = [], streaming_unseen.read_table
    monkeypatch.setattr(streaming_unseen, "read_table", lambda spark, path, schema: read.append(path) or kept(spark, path, schema))

    def run():
        read.clear()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = append_unseen(stream, target, ["match_id", "v"], "progress", folder=str(tmp_path))
        query.awaitTermination()
        assert read.count(target) <= 2
        return sorted(map(tuple, spark.read.parquet(target).collect())), len([p for p in query.recentProgress if p["numInputRows"]])

    want = sorted([(0, "before"), *((i, v) for i in range(6) for v in "ab")])
    assert run() == (want, 6)
    # The last batch was stored but not committed.
    commits = tmp_path / "progress" / "commits"
    for name in ("5", ".5.crc"):
        (commits / name).unlink()
    assert run()[0] == want
    spark.createDataFrame([(5, "b"), (9, "z"), (0, "before")], schema).coalesce(1).write.mode("append").parquet(source)
    assert run()[0] == sorted([*want, (9, "z")])


@pytest.mark.parametrize("form", ["file", "folder", "one file per batch", "shuffled"])
def test_key_event_stream_loses_nothing(spark, tmp_path, rows, form):
    """The same rows for one file, for part files, for many batches, and in any order."""
    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    if form == "file":
        shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    else:
        order = F.xxhash64("event_id") if form == "shuffled" else F.col("ts")
        given.repartitionByRange(6, order).write.parquet(str(tmp_path / "events.parquet"))
    files = spark.readStream.schema(COLUMNS["events"])
    if form in ("one file per batch", "shuffled"):
        files = files.option("maxFilesPerTrigger", 1)
    stream = feed_columns(feed_base(files.parquet(f"{tmp_path}/events.parquet*")))
    store_key_events(stream, str(tmp_path / "out"), "progress", folder=str(tmp_path)).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    want = key_event_stream(feed_events(spark, "/root/testdata/sf0.001"))
    assert rows(found) == rows(want) and found.count() > 50


def test_all_match_columns(spark, tmp_path):
    manager = {"id": 5, "name": "M", "nickname": None, "dob": "1980-01-02", "country": {"id": 1, "name": "X"}}
    match = {
        "match_id": 1, "match_date": "2024-01-01", "last_updated": "2024-01-02T03:04:05.6", "last_updated_360": "soon",
        "home_team": {"home_team_id": 2, "home_team_name": "A", "managers": [manager, {"id": 6, "name": "N"}]},
        "stadium": {"id": 3, "name": "S", "country": {"id": 9, "name": "G"}}, "competition_stage": {"id": 1, "name": "Regular"},
        "metadata": {"data_version": "1.1.0", "shot_fidelity_version": "2"},
    }
    (tmp_path / "m.json").write_text(json.dumps([match]))
    found = landed.read_matches(spark, str(tmp_path))
    assert found.columns == [c for c in schemas.names(schemas.MATCHES) if not c.endswith("_fd")]
    row = found.first()
    assert (row["home_managers"], row["home_manager_name"], str(row["home_manager_dob"])) == ("M, N", "M", "1980-01-02")
    assert (row["stadium"], row["stadium_country_name"], row["competition_stage"]) == ("S", "G", "Regular")
    assert (row["data_version"], row["shot_fidelity_version"], row["xy_fidelity_version"]) == ("1.1.0", 2, None)
    assert str(row["last_updated"]).startswith("2024-01-02 03:04:05") and row["last_updated_360"] is None
