"""Prompt-ready text of briefs: hooks, labels, moments and whole prompts.

The result of this module is a table of prompts; sending them anywhere is
left to the user.  All text is put together by column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.names import short_surname
from touchline.functions.text import ordinal, score_text
from touchline.operators.briefs import DEFAULT_SHOT_X, SIDE
from touchline.operators.joins import attach
from touchline.operators.sequence import RED_ITEM

# ---------------------------------------------------------------------------
# Phrases and limits.  {names} are filled with columns.
# ---------------------------------------------------------------------------

HOOK_LIMIT, HOOK_SCORERS = 4, 3
HOOKS = {
    "unbeaten": "This completes a whole season unbeaten for {focus}",
    "champion": "{focus} finish the season as champions",
    "title_run": "A win in the title run-in for {focus}, champions in the end",
    "ran_riot": "{focus} ran riot, winning {goals_for}-{goals_against}",
    "tight_win": "A tight {goals_for}-{goals_against} win — {focus} had to dig deep",
    "tight_loss": "A tight {goals_for}-{goals_against} defeat — {focus} fell just short",
    "has_red_card": "{red_card_team} reduced to ten men",
    "hattrick": "{hattrick_player} completed a hat-trick",
    "brace": "{brace_player} bagged a brace",
    "scorers": "goals from {scorer_names}",
    "none": "{focus} {goals_for}-{goals_against} {opponent}",
}

MOMENTS = {
    "opening": "opening goal — {focus} take the lead",
    "in_command": "making it {score_after} — {focus} in command",
    "winner": "the winner — final score will be {goals_for}-{goals_against}",
    "ahead": "{focus} go ahead, score now {score_after}",
    "goal": "goal for {focus}, score now {score_after}",
    "leads_won": "{opponent} take the lead — but {focus} recover to win {goals_for}-{goals_against}",
    "leads_drew": "{opponent} take the lead — but {focus} recover to draw {goals_for}-{goals_against}",
    "leads_lost": "{opponent} lead {score_after} — {focus} lose {goals_for}-{goals_against}",
    "levels_won": "{opponent} equalise — but {focus} go on to win {goals_for}-{goals_against}",
    "levels_drew": "{opponent} equalise — it ends {goals_for}-{goals_against}",
    "levels_lost": "{opponent} equalise — {focus} go on to lose {goals_for}-{goals_against}",
    "consolation": "consolation for {opponent}, making it {score_after} — {focus} win {goals_for}-{goals_against}",
    "pulls_back": "{opponent} pull one back, making it {score_after} — it ends {goals_for}-{goals_against}",
    "chance": "chance for {team_fd}, score {score_after}",
}

# Shot quality: least xG (exclusive), text inside the box, text outside.
BOX_LINE = 84
SHOT_QUALITY = [
    (0.60, "clinical from close range — in a dominant position", "clinical from close range — in a dominant position"),
    (0.30, "a good chance in the penalty area", "a good chance in the penalty area"),
    (0.10, "a difficult chance", "a decent effort from range"),
    (0.05, "a difficult angle inside the box", "a speculative effort from distance"),
]
SHOT_QUALITY_LEAST = (
    "an improbable finish from a near-impossible angle",
    "an audacious strike from well outside the box",
)

MILESTONES = {
    "hattrick_complete": "HAT-TRICK COMPLETE — this is the primary story, lead with it",
    "brace": "player's second goal of the night — mention brace",
    "hattrick_extend": "beyond a hat-trick — extraordinary night",
}

PLAYER_KNOWN = (
    "{player}: {player_note}. IMPORTANT: {season_goals} goals was their FINAL season total — "
    "use retrospective language: 'one of {season_goals} for the campaign'."
)
PLAYER_UNKNOWN = "{player}."

RED_IMPACT_OWN = "leaving {focus} a man down"
RED_IMPACT_OPPONENT = "leaving {opponent} with ten men"

LANGUAGE_LINE = 'After the English call, add "{goal_cry}"'
LANGUAGE_LINE_NOTED = 'After the English call, add "{goal_cry}" — {language_note}'

ENDING_UNBEATEN = (
    "IMPORTANT: This is the final matchday of the unbeaten season of {focus}. "
    "End with [reverently] and a single phrase about history."
)
ENDING = "End with [warmly] and a brief reflection connecting to the season story."

MATCH_LABELS = [
    ("ran_riot", "Ran riot — won by 5+"),
    ("easy_win", "Easy win — won by 4+"),
    ("action_packed", "Action-packed — 5+ goals, tight margin"),
    ("tight_game", "Tight game — few goals, 1-goal margin"),
    ("entertaining_draw", "Entertaining draw — 4+ goals"),
    ("dull_draw", "Goalless or tight draw"),
    ("final_round", "Final matchday"),
    ("final_unbeaten", "Unbeaten all season"),
    ("final_champion", "Champions"),
    ("title_run", "Title run-in of the later champions"),
    ("late_drama", "Late drama — goal after 85'"),
    ("early_goal", "Early goal — before 15'"),
    ("has_red_card", "Red card — {red_card_team} (min {red_minute})"),
    ("few_chances", "Very few chances — xG only {xg_for}"),
    ("dominant_xg", "Dominated xG: {xg_for} vs {xg_against}"),
    ("hattrick", "Hat-trick — {hattrick_player}"),
    ("brace", "Brace — {brace_player}"),
]
HIGHLIGHT_LABELS = [
    ("is_opener", "match opener"),
    ("is_equaliser", "{focus} equaliser"),
    ("is_go_ahead", "{focus} go-ahead"),
    ("is_consolation", "CONSOLATION for opponent"),
    ("opp_equaliser", "OPPONENT equalises"),
    ("opp_takes_lead", "OPPONENT takes lead"),
    ("is_screamer", "SCREAMER xG<0.05"),
    ("is_low_xg_goal", "low-xG goal"),
    ("is_high_xg_goal", "high-xG, dominant position"),
    ("late_drama", "LATE DRAMA"),
    ("brace", "BRACE (2nd goal)"),
    ("hattrick_complete", "HAT-TRICK COMPLETE!"),
    ("hattrick_extend", "4th goal or more!"),
    ("is_key_player", "{player_note} ({season_goals}G)"),
    ("early_red", "early dismissal, changed the game"),
]
LABEL_JOIN = " · "

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Frame:
    """Wording around the facts of the three kinds of prompt.

    The fact lines are the content of a prompt; how the reader is addressed
    is a matter of taste and may be replaced as a whole.
    """

    intro: str = (
        "Introduce this match for a football broadcast in two spoken sentences.\n"
        "Facts:\n"
        "- Result: {focus} {goals_for}-{goals_against} {opponent}, Round {match_round}\n"
        "- Storylines: {hooks}\n"
        "- Team nickname: {nickname}\n"
        "- Stadium: {stadium}\n"
        "Open quietly, build up with the storyline, use at most three voice tags "
        "and fifty words, and keep to the facts above."
    )
    highlight: str = (
        "Call this {kind} in at most thirty-five spoken words with voice tags.\n"
        "Facts:\n"
        "- Player: {player} ({team_fd})\n"
        "- Minute: the {minute_text}\n"
        "- Score: {score_before} → {score_after}\n"
        "- Final score: {focus} {goals_for}-{goals_against} {opponent}\n"
        "- This moment: {moment}\n"
        "- Shot quality: {shot_quality}\n"
        "- {player_context}\n"
        "{milestone_line}"
        "{context_line}"
        "Language: {language_line}\n"
        "Ending: {ending}\n"
        "{opponent_line}"
        "Keep to the facts above and never mention expected goals."
    )
    red_card: str = (
        "Describe this dismissal in one spoken sentence of at most twenty words.\n"
        "Facts: {player} ({side}) dismissed in minute {minute}. Score: {score_at}. {impact}.\n"
        "Sound shocked first and end with weight."
    )
    milestone_line: str = "- Milestone: {milestone}\n"
    context_line: str = "- Shot context: {shot_context}\n"
    opponent_line: str = "The other team scored: be exact about who did and what it means.\n"


def fill(template: str, **named: Column) -> Column:
    """Text with every ``{name}`` replaced by the column of that name.

    A missing value is written as nothing, so one null never empties a text.
    """
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}") and len(piece) > 2:
            column = named.get(piece[1:-1], F.col(piece[1:-1]))
            parts.append(F.coalesce(column.cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def _present(entries: list[tuple[Column, Column]]) -> Column:
    """Array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in entries]))


# --- match -----------------------------------------------------------------


def hooks(briefs: DataFrame, players: DataFrame) -> DataFrame:
    """Up to four story hooks per match and side, in order of weight.

    ``players`` is what ``hook_players`` makes of the scorers.
    """
    joined = briefs.join(players, SIDE, "left")
    flag = F.col
    three, two = flag("hattrick_player"), flag("brace_player")
    shown = F.transform("first_scorers", short_surname)
    entries = [
        (flag("final_round") & flag("unbeaten"), fill(HOOKS["unbeaten"])),
        (flag("final_round") & flag("champion"), fill(HOOKS["champion"])),
        (flag("title_round") & flag("champion") & flag("won"), fill(HOOKS["title_run"])),
        (flag("ran_riot"), fill(HOOKS["ran_riot"])),
        (flag("tight_game") & flag("won"), fill(HOOKS["tight_win"])),
        (flag("tight_game") & flag("lost"), fill(HOOKS["tight_loss"])),
        (flag("has_red_card"), fill(HOOKS["has_red_card"])),
        (three.isNotNull(), fill(HOOKS["hattrick"])),
        (three.isNull() & two.isNotNull(), fill(HOOKS["brace"])),
        (F.size("first_scorers") > 0, fill(HOOKS["scorers"], scorer_names=F.array_join(shown, ", "))),
    ]
    found = _present(entries)
    text = F.array_join(F.slice(found, 1, HOOK_LIMIT), "; ")
    return joined.withColumn("hooks", F.when(F.size(found) == 0, fill(HOOKS["none"])).otherwise(text))


def match_labels(briefs: DataFrame, players: DataFrame) -> DataFrame:
    """Labels of a match and side; ``players`` is what ``hook_players`` makes of the scorers."""
    three, two = F.col("hattrick_player"), F.col("brace_player")
    made = {
        "dull_draw": F.col("drew") & ~F.col("entertaining_draw"),
        "final_unbeaten": F.col("final_round") & F.col("unbeaten"),
        "final_champion": F.col("final_round") & F.col("champion"),
        "title_run": F.col("title_round") & F.col("champion") & F.col("won"),
        "hattrick": three.isNotNull(),
        "brace": three.isNull() & two.isNotNull(),
    }
    entries = [(made.get(name, F.col(name)), fill(text)) for name, text in MATCH_LABELS]
    joined = briefs.join(players, SIDE, "left")
    return joined.select(*SIDE, F.array_join(_present(entries), LABEL_JOIN).alias("labels"))


def brief_json(briefs: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """The brief of a side as one JSON text, without the season statistics."""
    joined = briefs if lists is None else briefs.join(lists, SIDE, "left")
    columns = [c for c in joined.columns if c != "scorer_context"]
    return joined.select(
        *SIDE, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("brief")
    )


def highlight_json(highlights: DataFrame) -> DataFrame:
    """The brief of a highlight as one JSON text."""
    whole = F.to_json(F.struct(*highlights.columns), {"ignoreNullFields": "false"})
    return highlights.select(*SIDE, "highlight_idx", whole.alias("brief"))


# --- highlight -------------------------------------------------------------


def score_before() -> Column:
    """Home-away score before the shot: one goal less for the scoring side."""
    minus_own = F.when(F.col("is_own_goal_for"), 1).otherwise(0)
    minus_other = F.when(F.col("is_goal_against"), 1).otherwise(0)
    own, other = F.col("own_score") - minus_own, F.col("other_score") - minus_other
    return F.when(F.col("focus_home"), score_text(own, other)).otherwise(score_text(other, own))


def _by_result(won: str, drew: str, lost: str) -> Column:
    """The phrase that is true of the final score."""
    final = F.col("goals_for") - F.col("goals_against")
    return F.when(final > 0, fill(MOMENTS[won])).when(final == 0, fill(MOMENTS[drew])).otherwise(fill(MOMENTS[lost]))


def moment() -> Column:
    """What a shot means; phrases that tell the result depend on it."""
    own, other = F.col("own_score"), F.col("other_score")
    decides = F.col("is_winner") & (F.col("goals_for") > F.col("goals_against"))
    return (
        F.when(
            F.col("is_own_goal_for"),
            F.when((own == 1) & (other == 0), fill(MOMENTS["opening"]))
            .when(own > other + 1, fill(MOMENTS["in_command"]))
            .when((own == other + 1) & decides, fill(MOMENTS["winner"]))
            .when(own == other + 1, fill(MOMENTS["ahead"]))
            .otherwise(fill(MOMENTS["goal"])),
        )
        .when(
            F.col("is_goal_against"),
            F.when(other > own, _by_result("leads_won", "leads_drew", "leads_lost"))
            .when(other == own, _by_result("levels_won", "levels_drew", "levels_lost"))
            .otherwise(_by_result("consolation", "pulls_back", "pulls_back")),
        )
        .otherwise(fill(MOMENTS["chance"]))
    )


def shot_quality(xg: Column, x: Column) -> Column:
    """Words for a chance by xG and by being inside the box.  A missing or zero x counts as 90."""
    inside = F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(DEFAULT_SHOT_X)) > BOX_LINE
    text = F.when(F.lit(False), F.lit(""))
    for least, in_box, outside in SHOT_QUALITY:
        text = text.when(xg > least, F.when(inside, in_box).otherwise(outside))
    in_box, outside = SHOT_QUALITY_LEAST
    return text.otherwise(F.when(inside, in_box).otherwise(outside))


def milestone() -> Column:
    text = F.when(F.lit(False), F.lit(""))
    for name, words in MILESTONES.items():
        text = text.when(F.col(name), words)
    return text.otherwise("")


def player_context() -> Column:
    known = F.col("player_note").isNotNull()
    return F.when(known, fill(PLAYER_KNOWN)).otherwise(fill(PLAYER_UNKNOWN))


def red_impact() -> Column:
    return F.when(F.col("is_opponent_red"), fill(RED_IMPACT_OPPONENT)).otherwise(fill(RED_IMPACT_OWN))


def highlight_labels(highlights: DataFrame) -> DataFrame:
    entries = [(F.col(name), fill(text)) for name, text in HIGHLIGHT_LABELS]
    return highlights.select(
        *SIDE, "highlight_idx", F.array_join(_present(entries), LABEL_JOIN).alias("labels")
    )


def highlight_texts(highlights: DataFrame) -> DataFrame:
    """The derived phrases of every shot and dismissal."""
    shot = F.col("item_type") != RED_ITEM
    return highlights.withColumns(
        {
            "minute_text": ordinal(F.col("minute")),
            "score_before": F.when(shot, score_before()),
            "moment": F.when(shot, moment()),
            "shot_quality": F.when(shot, shot_quality(F.col("xg"), F.col("x"))),
            "milestone": milestone(),
            "player_context": F.when(shot, player_context()),
            "impact": F.when(~shot, red_impact()),
        }
    )


# --- prompts ---------------------------------------------------------------


def language_line() -> Column:
    plain, noted = fill(LANGUAGE_LINE), fill(LANGUAGE_LINE_NOTED)
    return F.when(F.col("language_note").isNull(), plain).otherwise(noted)


def intro_prompts(
    with_hooks: DataFrame, nickname: str = "", stadium: str = "", frame: Frame = Frame()
) -> DataFrame:
    text = fill(frame.intro, nickname=F.lit(nickname), stadium=F.lit(stadium))
    return with_hooks.select(
        *SIDE,
        F.lit("intro").alias("content_type"),
        F.lit(-1).alias("highlight_idx"),
        F.lit("").alias("player"),
        F.lit(0).alias("minute"),
        F.lit(0).alias("is_goal"),
        F.lit("intro").alias("event_type"),
        text.alias("prompt"),
    )


def highlight_prompts(
    texts: DataFrame, briefs: DataFrame, cries: DataFrame, languages: DataFrame, frame: Frame = Frame()
) -> DataFrame:
    """Prompts of all highlights.

    ``texts`` may carry ``shot_context``; ``cries`` has one row per player,
    ``languages`` the note of a language.
    """
    noted = cries.join(
        languages.select(F.col("language").alias("goal_language"), "language_note"),
        "goal_language", "left",
    ).select("player", "goal_cry", "language_note")
    rows = attach(texts, noted, ["player"], ["match_id", "index"])
    endings = briefs.select(*SIDE, (F.col("final_round") & F.col("unbeaten")).alias("_unbeaten_end"))
    rows = attach(rows, endings, SIDE, ["index"])
    if "shot_context" not in rows.columns:
        rows = rows.withColumn("shot_context", F.lit(""))
    red = F.col("item_type") == RED_ITEM
    side = F.when(F.col("is_opponent_red"), F.col("opponent")).otherwise(F.col("focus"))
    has_context = F.coalesce(F.col("shot_context"), F.lit("")) != ""
    shot_text = fill(
        frame.highlight,
        kind=F.when(F.col("is_goal"), "GOAL").otherwise("shot"),
        milestone_line=F.when(F.col("milestone") != "", fill(frame.milestone_line)),
        context_line=F.when(has_context, fill(frame.context_line)),
        language_line=language_line(),
        ending=F.when(F.col("_unbeaten_end"), fill(ENDING_UNBEATEN)).otherwise(ENDING),
        opponent_line=F.when(F.col("team_fd") != F.col("focus"), F.lit(frame.opponent_line)),
    )
    return rows.select(
        *SIDE,
        F.lit("highlight").alias("content_type"),
        "highlight_idx",
        "player",
        "minute",
        F.col("is_goal").cast("int").alias("is_goal"),
        F.col("item_type").alias("event_type"),
        F.when(red, fill(frame.red_card, side=side)).otherwise(shot_text).alias("prompt"),
    )


def prompt_table(intros: DataFrame, highlights: DataFrame, briefs: DataFrame) -> DataFrame:
    """All prompts with the match they belong to."""
    facts = briefs.select(*SIDE, "home_fd", "away_fd", "match_round")
    return attach(intros.unionByName(highlights), facts, SIDE, ["highlight_idx"], "inner")
