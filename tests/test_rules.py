"""Hand-made edge rows, one small set per rule."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from touchline import dimensions, schemas
from touchline.operators import (
    briefs, conform, enrich, incremental, lineups, lookup, prompts, report, results, scorers, sequence, shots, standings, voice,
)

DAY = dt.date(2024, 3, 1)


def events(spark, *changes):
    """Typed events of match 1 (A at home to B) out of partial rows."""
    base = dict.fromkeys(schemas.names(schemas.EVENTS))
    base |= {"match_id": 1, "period": 1, "minute": 10, "type": "Pass", "team": "A", "player": "p"}
    made = []
    for i, change in enumerate(changes, 1):
        row = {**base, "index": i, "event_id": f"e{i}", **change}
        made.append(tuple(row[c] for c in base))
    return spark.createDataFrame(made, schemas.EVENTS)


def goal(**more):
    return {"type": "Shot", "shot_outcome": "Goal", "shot_xg": 0.3, **more}


def miss(**more):
    return {"type": "Shot", "shot_outcome": "Saved", "shot_xg": 0.1, **more}


@pytest.fixture
def match(spark):
    return spark.createDataFrame(
        [(1, "A", "B", DAY, "A", "B", 2, 1)],
        "match_id bigint, home_team string, away_team string, match_date date, home_fd string, away_fd string, "
        "home_score int, away_score int",
    )


# --- pairs -----------------------------------------------------------------


@pytest.fixture
def legs(spark):
    return spark.createDataFrame(
        [(1, "A", "B", 2.1, 0.8), (2, "B", "A", 0.3, 1.6), (3, "C", "D", 1.0, 2.0)],
        "match_id bigint, home_fd string, away_fd string, home_xg double, away_xg double",
    )


def test_each_leg_has_its_own_xg(spark, legs, rows):
    asked = spark.createDataFrame(
        [(10, "A", "B"), (11, "B", "A"), (12, "D", "C"), (13, "A", "D")], "id int, home_fd string, away_fd string"
    )
    per_pair = lookup.latest_per_pair(legs, ["home_xg", "away_xg"], "match_id")
    out = lookup.pair_values(asked, per_pair, "home_xg", "away_xg", ["id"])
    assert rows(out, "id", "home_xg", "away_xg") == [
        (10, 2.1, 0.8), (11, 0.3, 1.6), (12, 2.0, 1.0), (13, None, None),
    ]


def test_rows_of_pairs_prefer_exact_order(spark, legs, rows):
    wanted = spark.createDataFrame([("A", "B"), ("D", "C"), ("A", "C")], "home_fd string, away_fd string")
    out = lookup.rows_of_pairs(legs, wanted, ["match_id"])
    assert rows(out, "match_id", "want_home", "want_away") == [(1, "A", "B"), (3, "D", "C")]


def test_pair_round(spark, rows):
    rounds = spark.createDataFrame([("A", "B", 3)], "home_fd string, away_fd string, round int")
    asked = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C")], "home_fd string, away_fd string")
    out = lookup.pair_round(asked, rounds, ["home_fd"])
    assert rows(out, "home_fd", "away_fd", "match_round") == [("A", "B", 3), ("A", "C", 0), ("B", "A", 3)]


# --- names -----------------------------------------------------------------


def test_season_stats_first_hit(spark):
    names = spark.createDataFrame(
        [("Florian Wirtz",), ("Wirtz",), ("Grimaldo",), ("Josip Stanišić",), ("V. Boniface",), ("Nobody",)], "player string"
    )
    stats = dimensions.season_stats(spark)
    got = {r["player"]: r["stats_name"] for r in lookup.season_stats_of(names, stats).collect()}
    assert got == {
        "Florian Wirtz": "Florian Wirtz", "Wirtz": "Florian Wirtz", "Grimaldo": "Alejandro Grimaldo Garcia",
        "Josip Stanišić": None, "V. Boniface": "Victor Okoh Boniface", "Nobody": None,
    }
    from touchline.functions.names import fold_accents

    folded = lookup.season_stats_of(names, stats, fold_accents(F.col("player")))
    assert {r["player"]: r["stats_name"] for r in folded.collect()}["Josip Stanišić"] == "Josip Stanisic"


def test_goal_cries(spark):
    names = spark.createDataFrame(
        [("Florian Wirtz",), ("wirtz",), ("Sir Granit Xhaka II",), ("Nobody",)], "player string"
    )
    out = lookup.goal_cry_of(names, dimensions.goal_cries(spark), dimensions.DEFAULT_CRY)
    got = {r["player"]: (r["goal_cry"], r["goal_language"]) for r in out.collect()}
    assert got == {
        "Florian Wirtz": ("TOOOOOR!", "German"), "wirtz": ("TOOOOOR!", "German"),
        "Sir Granit Xhaka II": ("TOR! Wunderbar!", "Swiss"), "Nobody": ("GOAAAAAL!", "English"),
    }


def test_fuzzy_lookups_against_brute_force(spark):
    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abC") for _ in range(rng.randrange(1, 4)))

    keys = list(dict.fromkeys(f"{word()} {word()}" for _ in range(12)))
    asked = list(dict.fromkeys([word() for _ in range(20)] + [f"{word()} {word()}" for _ in range(40)]))
    names = spark.createDataFrame([(a,) for a in asked], "player string")
    stats = spark.createDataFrame(
        [(i, k, i, 0, 0, 0.0, "") for i, k in enumerate(keys)],
        "ord int, name string, goals int, assists int, apps int, xg double, note string",
    )
    cries = spark.createDataFrame(
        [(i, k, f"cry{i}", "x", "y") for i, k in enumerate(keys)], "ord int, name string, cry string, language string, flag string"
    )

    def stat(name):
        if name in keys:
            return name
        return next((k for k in keys if name.split()[-1].lower() in k.lower()), None)

    def cry(name):
        if name in keys:
            return f"cry{keys.index(name)}"
        hit = (i for i, k in enumerate(keys) if name.lower() in k.lower() or k.lower() in name.lower())
        return next((f"cry{i}" for i in hit), "none")

    got = {r["player"]: r["stats_name"] for r in lookup.season_stats_of(names, stats).collect()}
    assert got == {a: stat(a) for a in asked}
    got = {r["player"]: r["goal_cry"] for r in lookup.goal_cry_of(names, cries, ("none", "", "")).collect()}
    assert got == {a: cry(a) for a in asked}


def test_unmapped_names_pass_through(spark, rows):
    raw = spark.createDataFrame([("VfB Stuttgart", "Darmstadt 98")], "home_team string, away_team string")
    names = dimensions.team_names(spark)
    out = conform.conform_names(raw, names, {"home_team": "home_fd", "away_team": "away_fd"})
    assert rows(out, "home_fd", "away_fd") == [("Stuttgart", "Darmstadt 98")]
    assert rows(conform.unmapped_names(raw, names, ["home_team", "away_team"])) == [("Darmstadt 98", 1)]


# --- results, rounds, tables -----------------------------------------------


def test_round_by_place(spark):
    days = [dt.date(2024, 1, d) for d in (3, 1, 2, 1, 3, 2, 1)]
    df = spark.createDataFrame([("s", d, i) for i, d in enumerate(days)], "season string, day date, row bigint")
    out = {r["row"]: r["round"] for r in conform.assign_round(df, ["season"], "day", "row", 2).collect()}
    placed = sorted(range(7), key=lambda i: (days[i], i))
    assert out == {row: place // 2 + 1 for place, row in enumerate(placed)}


def season(spark, games):
    return spark.createDataFrame(
        [("s", i // 2 + 1, *g, i + 1) for i, g in enumerate(games)],
        "season string, round int, home_team string, away_team string, home_goals int, away_goals int, place bigint",
    )


def brute_tables(games):
    table, out = {}, {}
    for i, (h, a, hg, ag) in enumerate(games):
        hg, ag = hg or 0, ag or 0
        for team, own, other in ((h, hg, ag), (a, ag, hg)):
            row = table.setdefault(team, [0] * 6)
            row[0] += 1
            row[1 if own > other else 2 if own == other else 3] += 1
            row[4] += own
            row[5] += other
        ranked = sorted(table.items(), key=lambda t: (-(t[1][1] * 3 + t[1][2]), t[1][5] - t[1][4], -t[1][4]))
        out[i // 2 + 1] = [(n, *r) for n, r in ranked]
    return out


def test_standings_every_round(spark):
    rng = random.Random(5)
    teams = "ABCDEF"
    games = []
    for _ in range(24):
        h, a = rng.sample(teams, 2)
        games.append((h, a, rng.choice([0, 1, 2, None]), rng.randrange(3)))
    out = standings.standings(season(spark, games), ["season"])
    got = {}
    for r in out.orderBy("round", "position").collect():
        got.setdefault(r["round"], []).append((r["team"], *[r[c] for c in standings.TALLIES]))
    assert got == brute_tables(games)
    for table in got.values():
        assert sum(r[5] for r in table) == sum(r[6] for r in table)
    final = standings.final_standings(season(spark, games), ["season"]).orderBy("position").collect()
    assert [(r["team"], *[r[c] for c in standings.TALLIES]) for r in final] == got[12]


def test_level_teams_keep_first_appearance(spark):
    out = standings.standings(season(spark, [("Z", "Y", 1, 1), ("B", "A", 1, 1)]), ["season"])
    assert [r["team"] for r in out.orderBy("position").collect()] == ["Z", "Y", "B", "A"]


def test_scorers(spark, rows):
    listed = spark.createDataFrame(
        [("s", 1, "Ann Other", "F", 9), ("s", 2, "Bo Derek", "F", 1), ("s", 3, "Cy Young", "G", 2)],
        "season string, ord int, name string, team string, goals int",
    )
    last = spark.createDataFrame([("s", 6)], "season string, last_round int")
    goals = spark.createDataFrame(
        [("s", 1, "X Derek", 4), ("s", 3, "Y Derek", 1), ("s", 3, "X Derek", 9), ("s", 2, "Q Young", 7)],
        "season string, round int, player string, seen_at bigint",
    )
    estimates = scorers.estimated(listed, last, ["season"])
    # Half-even: 9 * 1/6 = 1.5 -> 2; a scorer without goals is listed from round 5 on.
    assert [r for r in rows(estimates, "round", "name", "estimate") if r[0] in (1, 5)] == [
        (1, "Ann Other", 2), (5, "Ann Other", 8), (5, "Bo Derek", 1), (5, "Cy Young", 2),
    ]
    final = scorers.override(estimates, scorers.actual(goals, ["season"], last), ["season"], "F")
    counted = rows(final.filter("is_counted"), "round", "name", "goals")
    # From round 3 on the other player of that name was seen first; before, the row is not listed.
    assert counted == [(4, "Bo Derek", 1), (5, "Bo Derek", 1), (6, "Bo Derek", 1)]
    top = scorers.top_scorers(final, ["season"], top=2)
    assert rows(top.filter("round = 6"), "rank", "name", "goals") == [(1, "Ann Other", 9), (2, "Cy Young", 2)]


def test_typed_results(spark):
    columns = schemas.names(schemas.RESULTS_RAW)
    text = dict.fromkeys(columns, "1") | {
        "Date": "31/02/2024", "HomeTeam": "A", "AwayTeam": "", "FTHG": "N/A", "FTAG": "x", "HS": "", "PSH": "1.30"
    }
    raw = spark.createDataFrame([tuple(text[c] for c in columns)], schemas.RESULTS_RAW)
    row = results.type_results(raw).first()
    assert (row["Date"], row["AwayTeam"], row["FTHG"], row["FTAG"], row["HS"], row["match_resultH"]) == (
        None, None, None, None, None, 1.3
    )
    shown = results.statistics(results.type_results(raw), ["HomeTeam"]).orderBy("ord").collect()
    assert [(r["label"], r["home_value"], r["away_value"]) for r in shown][0] == ("Shots", 0, 1)


# --- events ----------------------------------------------------------------


def test_running_score_counts_shot_goals_only(spark, match, rows):
    e = events(spark, goal(), goal(team="B"), miss(), {"type": "Own Goal For"})
    made = shots.shot_rows(e, match)
    assert rows(made, "index", "score_after") == [(1, "1-0"), (2, "1-1"), (3, "1-1")]
    # The final score is 2-1: one own goal is missing.
    assert rows(report.reconcile_goals(made, match)) == [(1, 2, 1, 1, 1)]


def test_key_events_see_reds_of_both_kinds(spark, match, rows):
    e = events(
        spark, goal(), {"type": "Foul Committed", "foul_committed_card": "Second Yellow"},
        {"type": "Bad Behaviour", "bad_behaviour_card": "Red Card"},
        {"type": "Foul Committed", "foul_committed_card": "Yellow Card"}, miss(),
    )
    assert rows(shots.key_events(e, match), "index", "event_type", "xg") == [
        (1, "goal", 0.3), (2, "red_card", 0.0), (3, "red_card", 0.0),
    ]


@pytest.mark.parametrize("n_goals,wanted", [(0, 3), (1, 3), (2, 4), (3, 3)])
def test_highlight_counts(spark, match, n_goals, wanted):
    e = events(spark, *[goal(minute=i) for i in range(n_goals)], *[
        miss(minute=50 + i, shot_xg=0.01 * i) for i in range(5)
    ])
    chosen = shots.highlight_shots(shots.shot_rows(e, match)).collect()
    assert len(chosen) == wanted
    best = sorted((r["xg"] for r in chosen if not r["is_goal"]), reverse=True)
    assert best == [0.04, 0.03, 0.02][: len(best)]


def test_same_player_minute_and_mark_is_one_shot(spark, match, rows):
    e = events(spark, miss(minute=5), miss(minute=5), goal(minute=5), miss(minute=5, player=None))
    assert rows(shots.clean_shots(shots.shot_rows(e, match)), "index", "x", "y", "player") == [
        (1, 60.0, 40.0, "p"), (3, 60.0, 40.0, "p"), (4, 60.0, 40.0, "Unknown"),
    ]


def card(**more):
    return {"type": "Foul Committed", "foul_committed_card": "Red Card", **more}


def test_score_at_card(spark, match, rows):
    e = events(spark, card(minute=3), goal(minute=10), card(minute=10), miss(minute=12), goal(minute=46),
               goal(minute=45, team="B", period=2), card(minute=45), card(minute=90))
    reds = shots.key_events(e, match).filter("event_type = 'red_card'")
    made = shots.shot_rows(e, match)
    assert rows(sequence.score_at(reds, made), "index", "score_at") == [
        (1, "0-0"), (3, "1-0"), (7, "2-1"), (8, "2-0"),
    ]


def test_score_at_against_brute_force(spark, match):
    rng = random.Random(11)
    changes = [
        rng.choice([goal, miss, card])(minute=rng.randrange(30), team=rng.choice("AB"), player=f"p{i}") for i in range(200)
    ]
    e = events(spark, *changes)
    made = shots.shot_rows(e, match)
    reds = shots.key_events(e, match).filter("event_type = 'red_card'")
    ordered = sorted(((r["minute"], r["index"], r["score_after"]) for r in made.collect()))
    for r in sequence.score_at(reds, made).collect():
        before = [s for m, _, s in ordered if m <= r["minute"]]
        assert r["score_at"] == (before[-1] if before else "0-0")
    seq = sequence.number_items(sequence.items(shots.highlight_shots(made), sequence.score_at(reds, made)))
    got = seq.orderBy("highlight_idx").collect()
    assert [r["highlight_idx"] for r in got] == list(range(len(got)))
    order = [(r["minute"], r["item_type"] == "red_card", r["index"]) for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("changes,wanted", [
    ([{"minute": 95, "period": 2}], 95),
    ([{"minute": 80, "period": 2}], 90),
    ([{"minute": 118, "period": 3}], 90),
    ([{"type": "Substitution", "player": "q", "substitution_replacement": "p", "minute": 60},
      {"type": "Substitution", "substitution_replacement": "r", "minute": 80}, card(minute=75)], 15),
    ([card(minute=30), {"minute": 40}], 30),
    ([{"type": "Substitution", "substitution_replacement": "r", "minute": 50},
      {"type": "Substitution", "player": "r", "substitution_replacement": "p", "minute": 70}], 0),
])
def test_minutes(spark, changes, wanted):
    out = lineups.minutes_played(events(spark, {"minute": 1}, *changes))
    assert {r["player"]: r["minutes"] for r in out.collect()}["p"] == wanted


def test_lineup_order(spark):
    lines = spark.createDataFrame(
        [(1, "A", "w", 90, "Left Wing"), (1, "A", "k", 90, "Goalkeeper"), (1, "A", "s", 20, "Goalkeeper"),
         (1, "A", "t", 44, ""), (1, "A", "u", 45, "Sweeper")],
        "match_id bigint, team_fd string, player_name string, minutes int, position string",
    )
    out = lineups.lineup_order(lines, dimensions.position_order(spark), dimensions.DEFAULT_POSITION_ORDER)
    assert [r["player_name"] for r in out.orderBy("slot").collect()] == ["k", "w", "u", "t", "s"]


def test_shot_context(spark):
    e = events(
        spark, {"player": "giver", "pass_cross": True}, miss(key_pass_id="e1", shot_technique="Volley", shot_type="Penalty"),
        miss(key_pass_id="gone"),
    )
    out = enrich.shot_context(e).withColumn("c", enrich.context_text()).orderBy("index").collect()
    assert [(r["assist_player"], r["cross_assist"], r["c"]) for r in out] == [
        ("giver", True, "penalty, volley, cross from giver"), ("", False, ""),
    ]


# --- briefs ----------------------------------------------------------------


def story(spark, match, e, round_=1, focus=None):
    made = shots.shot_rows(e, match)
    reds = shots.key_events(e, match).filter("event_type = 'red_card'")
    rounds = match.withColumn("match_round", F.lit(round_))
    facts = briefs.match_briefs(made, reds, match, shots.match_xg(e, match), rounds, focus)
    seq = sequence.number_items(sequence.items(
        shots.highlight_shots(made), sequence.score_at(reds.drop("event_type", "xg"), made)
    ))
    scorers_ = briefs.scorers_of_match(made)
    flags = briefs.highlight_briefs(briefs.goal_numbers(seq), facts, scorers_)
    return facts, flags, scorers_


def test_winner_is_judged_from_the_own_side(spark, match):
    e = events(spark, goal(minute=5), goal(minute=20, team="B", player="b"), goal(minute=88, team="B", player="b"))
    facts, flags, _ = story(spark, match, e)
    home, away = facts.orderBy(F.desc("focus_home")).collect()
    assert (home["lost"], away["won"], away["tight_game"], away["late_drama"], home["early_goal"]) == (True,) * 5
    mine = {r["index"]: r for r in flags.filter("focus = 'B'").collect()}
    assert [i for i, r in mine.items() if r["is_winner"]] == [3]
    assert mine[2]["is_equaliser"] and mine[3]["is_go_ahead"] and mine[3]["brace"] and not mine[2]["brace"]
    assert mine[1]["opp_takes_lead"] and not mine[1]["is_opener"]
    theirs = {r["index"]: r for r in flags.filter("focus = 'A'").collect()}
    assert theirs[1]["is_opener"] and theirs[3]["opp_takes_lead"] and not theirs[3]["brace"]


def test_hattrick_suppresses_brace(spark, match):
    e = events(spark, *[goal(minute=m) for m in (1, 2, 3, 4)])
    facts, flags, scorers_ = story(spark, match, e, round_=34, focus="A")
    got = flags.orderBy("highlight_idx").collect()
    assert [(r["brace"], r["hattrick_complete"], r["hattrick_extend"]) for r in got] == [
        (False, False, False), (False, False, False), (False, True, False), (False, False, True),
    ]
    hooked = prompts.hooks(facts, briefs.hook_players(scorers_, 3)).first()["hooks"]
    assert hooked == (
        "This completes a whole season unbeaten for A; A finish the season as champions; "
        "p completed a hat-trick; goals from p"
    )
    labels = prompts.match_labels(facts, briefs.hook_players(scorers_, 3)).first()["labels"]
    assert labels.startswith("Easy win — won by 4+ · Final matchday · Unbeaten all season · Champions")
    assert labels.endswith("Hat-trick — p")


def test_no_goals_at_all(spark, match):
    facts, flags, scorers_ = story(spark, match, events(spark, miss(), card(minute=20)))
    row = prompts.hooks(facts, briefs.hook_players(scorers_, 3)).filter("focus = 'A'").first()
    assert (row["drew"], row["goals_for"], row["hooks"]) == (True, 0, "A reduced to ten men")
    red = flags.filter("item_type = 'red_card' and focus = 'B'").first()
    assert (red["early_red"], red["is_opponent_red"], red["score_at"]) == (True, True, "0-0")


def test_texts_are_true_of_the_side(spark, match):
    """No loser is told of a win, no winning goal that did not win, no unbeaten team that lost."""
    e = events(spark, goal(minute=5), goal(minute=20, team="B", player="b"), goal(minute=30), goal(minute=50, team="B", player="b"),
               goal(minute=88, team="B", player="b"))
    facts, flags, scorers_ = story(spark, match, e, round_=34)
    hooks = {r["focus"]: r["hooks"] for r in prompts.hooks(facts, briefs.hook_players(scorers_, 3)).collect()}
    assert "unbeaten" not in hooks["A"] and "champions" not in hooks["A"] and "unbeaten" in hooks["B"]
    texts = prompts.highlight_texts(flags).collect()
    for r in texts:
        won = r["goals_for"] > r["goals_against"]
        assert won or not any(x in r["moment"] for x in ("to win", f"{r['focus']} win", "the winner", "recover to win"))
        assert "the winner" not in r["moment"] or r["is_winner"]
    mine = {(r["focus"], r["index"]): r["moment"] for r in texts}
    assert mine["A", 1].startswith("opening goal") and mine["A", 3] == "A go ahead, score now 2-1"
    assert mine["A", 5] == "B lead 2-3 — A lose 2-3" and mine["B", 5].startswith("the winner")
    assert mine["A", 4] == "B equalise — A go on to lose 2-3" and mine["B", 3] == "A take the lead — but B recover to win 3-2"


def test_tight_games_are_won_and_lost(spark, match):
    facts, _, scorers_ = story(spark, match, events(spark, goal(minute=5)))
    hooks = {r["focus"]: r["hooks"] for r in prompts.hooks(facts, briefs.hook_players(scorers_, 3)).collect()}
    assert hooks["A"].startswith("A tight 1-0 win") and hooks["B"].startswith("A tight 0-1 defeat")


def test_hooks_default(spark, match):
    facts, _, scorers_ = story(spark, match, events(spark, miss()))
    row = prompts.hooks(facts, briefs.hook_players(scorers_, 3)).filter("focus = 'B'").first()
    assert row["hooks"] == "B 0-0 A"


def test_prompts(spark, match):
    e = events(spark, goal(minute=12, player="Patrik Schick", location=[110.0, 40.0]), card(minute=50, team="B", player="x"))
    facts, flags, scorers_ = story(spark, match, e, focus="A")
    names = flags.select("player").distinct()
    texts = prompts.highlight_texts(flags)
    spoken = prompts.highlight_prompts(
        texts, facts, lookup.goal_cry_of(names, dimensions.goal_cries(spark), dimensions.DEFAULT_CRY),
        dimensions.language_notes(spark),
    ).orderBy("highlight_idx").collect()
    assert "- Minute: the 12th\n- Score: 0-0 → 1-0\n" in spoken[0]["prompt"]
    assert 'add "GÓL! Neuvěřitelné!" — celebrating in Czech' in spoken[0]["prompt"]
    assert "opening goal — A take the lead" in spoken[0]["prompt"]
    assert spoken[1]["prompt"].splitlines()[1] == (
        "Facts: x (B) dismissed in minute 50. Score: 1-0. leaving B with ten men."
    )


# --- texts and increments --------------------------------------------------


def test_voice_queue(spark, rows):
    texts = spark.createDataFrame(
        [(1, "A B", "C", "intro", -1, "It ended 2-1."), (1, "A B", "C", "highlight", 0, "abcd"),
         (1, "A B", "C", "highlight", 1, None), (1, "A B", "C", "highlight", 2, "goal now")],
        "match_id bigint, home_fd string, away_fd string, content_type string, highlight_idx int, commentary string",
    )
    assets = spark.createDataFrame([("A_B_vs_C_highlight_2.mp3",)], "file_name string")
    assert rows(voice.voice_queue(texts, assets)) == [("A_B_vs_C_intro_-1.mp3", "It ended two-one.")]
    assert rows(voice.status_counts(voice.voice_status(texts, assets))) == [
        ("present", 1), ("queued", 1), ("unusable", 2),
    ]
    matches = texts.select("match_id", "home_fd", "away_fd").distinct()
    assert rows(voice.available_audio(matches, assets)) == [(1, "highlight", 2)]


def test_regenerate_twice_changes_nothing(spark, rows):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "match_id int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "match_id int, v string")
    once = incremental.regenerate(old, new, ["match_id"])
    assert rows(once) == [(1, "old"), (2, "new"), (3, "new")]
    assert rows(incremental.regenerate(once, new, ["match_id"])) == rows(once)
    assert incremental.unseen(new, once, ["match_id"]).count() == 0


def test_contenders_reach_the_same_list(spark, rows):
    listed = spark.createDataFrame(
        [(1, i, f"n{i}", "F" if i % 17 == 0 else "T", i % 4) for i in range(1, 300)] + [(1, 400, "x", None, 3)],
        "season int, ord int, name string, team string, goals int",
    )
    rounds = spark.createDataFrame([(1, 6)], "season int, last_round int")

    def best(some):
        made = scorers.estimated(some, rounds, ["season"]).withColumn("goals", F.col("estimate"))
        return rows(scorers.top_scorers(made, ["season"], 5))

    some = scorers.contenders(listed, ["season"], "F", 5)
    assert best(some) == best(listed) and some.count() == 20 + listed.filter("team = 'F'").count()


def test_similar_names_of_any_length(spark):
    long = "Al " + "b" * 200 + " O"
    stats = spark.createDataFrame([(1, long, 3), (2, "Zed O Bo", 4)], "ord int, name string, goals int")
    names = spark.createDataFrame([("Mr O",), ("Mr bbb",), ("Mr zzz",), (long,)], "player string")
    found = {r["player"]: r["stats_name"] for r in lookup.season_stats_of(names, stats).collect()}
    assert found == {"Mr O": long, "Mr bbb": long, "Mr zzz": None, long: long}


def test_held_pieces_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = ["", *(word(rng.randrange(1, 40)) for _ in range(40)), "ab" * 100]
    pieces = ["", *{word(rng.randrange(1, 10)) for _ in range(60)}, "ab" * 70, "ab" * 101]
    holders = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)] + [(0, 99, None)], "k int, i int, t string")
    asked = spark.createDataFrame([(p,) for p in pieces] + [(None,)], "piece string")
    met = lookup.held_pieces(holders, "t", asked)
    assert met.columns == ["k", "i", "piece"]
    wanted = {(i, p) for i, t in enumerate(texts) for p in pieces if p in t}
    assert {(r["i"], r["piece"]) for r in met.collect()} == wanted
    # Keys have to be equal too.
    keyed = lookup.held_pieces(holders, "t", asked.withColumn("k", F.lit(1)), ["k"])
    assert {(r["i"], r["piece"]) for r in keyed.collect()} == {(i, p) for i, p in wanted if i % 2}


def test_pieces_of_long_names_grow_with_their_length(spark):
    """A name of 200 letters makes some rows a letter, not one for every pair of places."""
    holders = spark.createDataFrame([(1, "x" * 200)], "i int, t string")
    stems = spark.createDataFrame([("x" * n,) for n in (1, 2, 4, 8, 16, 32, 64, 128)], "piece string")
    assert lookup.held_pieces(holders, "t", stems).count() <= 200 * 8


def test_suffixes_of_names_are_not_broadcast(spark):
    """A table of few names makes many suffixes, whose number Spark does not know."""
    holders = spark.range(1).select(F.lit("Harry Kane").alias("t"), F.lit(1).alias("ord"))
    pieces = spark.range(200).select(F.concat(F.lit("ane"), F.col("id").cast("string")).alias("piece"))
    met = lookup.held_pieces(holders, "t", pieces.unionAll(spark.createDataFrame([("ane",)], "piece string")))
    assert [tuple(r) for r in met.select("ord", "piece").collect()] == [(1, "ane")]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin .*, Inner", plan) and not re.search(r"BroadcastHashJoin .*, Inner", plan)


def test_surname_of_one_letter_meets_its_season_only(spark):
    estimates = spark.createDataFrame(
        [(1, 1, "Bo Rado", "F", 2, 1), (2, 1, "Olo", "F", 3, 1), (2, 1, "Zed", "F", 1, 2), (2, 1, "Olo", "G", 5, 3)],
        "season int, round int, name string, team string, estimate int, ord int",
    )
    counts = spark.createDataFrame([(1, 1, "Mr O", 7, 4), (2, 1, "Al Zed", 9, 1)], "season int, round int, player string, goals int, seen_at int")
    out = scorers.override(estimates, counts, ["season"], "F")
    found = {(r["season"], r["name"], r["team"]): (r["goals"], r["is_counted"]) for r in out.collect()}
    assert found == {
        (1, "Bo Rado", "F"): (7, True), (2, "Olo", "F"): (3, False), (2, "Zed", "F"): (9, True), (2, "Olo", "G"): (5, False),
    }


@pytest.mark.parametrize("games", [None, 6, 8])
def test_title_rounds(spark, games):
    """Against counting by hand what every team can still win; a season may stay open."""
    draw = random.Random(11)
    results, want = [], {}
    for year in range(6):
        points, played = dict.fromkeys("ABCD", 0), dict.fromkeys("ABCD", 0)
        for round_ in range(1, 7):
            order = draw.sample("ABCD", 4)
            for at in (0, 2):
                # The stronger of two teams wins the more often, the more the year is odd.
                home, away = order[at], order[at + 1]
                goals = (2, 0) if (home < away) == (draw.random() < 0.5 + 0.1 * year) else (0, 2)
                results.append((year, round_, round_ * 2 + at // 2, home, away, *goals))
                points[home if goals[0] else away] += 3
                played[home] += 1
                played[away] += 1
            first, *others = sorted(points, key=lambda t: -points[t])
            if year not in want and all(points[first] > points[t] + 3 * max((games or 6) - played[t], 0) for t in others):
                want[year] = round_
    matches = spark.createDataFrame(
        results, "season int, round int, place bigint, home_team string, away_team string, home_goals int, away_goals int",
    )
    table = standings.standings(matches, ["season"])
    found = {r["season"]: r["title_round"] for r in standings.title_rounds(table, ["season"], games).collect()}
    assert found == want
    if games == 6:
        assert 0 < len(want)
        totals = briefs.match_totals(
            spark.createDataFrame(
                [(place + 100 * year, h if hg else a, h, a, 1, 50) for year, _, place, h, a, hg, ag in results for _ in range(2)],
                "match_id bigint, team_fd string, home_fd string, away_fd string, is_goal int, minute int",
            ),
            spark.createDataFrame([(p + 100 * y, h, a) for y, _, p, h, a, *_ in results], "match_id bigint, home_fd string, away_fd string"),
        )
        rounds = spark.createDataFrame([(p + 100 * y, y, r) for y, r, p, *_ in results], "match_id bigint, season int, match_round int")
        assert {r["season"]: r["title_round"] for r in briefs.season_titles(totals, rounds, 6).collect()} == want


def test_by_alike_name(spark):
    stats = spark.createDataFrame(
        [(2, "Josip Stanisic", 5), (1, "JOSIP STANIŠIĆ", 6), (3, "Özil", 7), (4, None, 8)], "ord int, name string, goals int",
    )
    names = spark.createDataFrame([("josip stanišic",), ("Ozil",), ("Ozi",), (None,)], "player string")
    found = lookup.by_alike_name(names, stats, "player")
    assert found.columns == ["player", "alike_name", "goals"]
    assert {r["player"]: (r["alike_name"], r["goals"]) for r in found.collect()} == {
        "josip stanišic": ("JOSIP STANIŠIĆ", 6), "Ozil": ("Özil", 7), "Ozi": (None, None), None: (None, None),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
