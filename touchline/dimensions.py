"""Small lookup tables and the frames made of them.

Each row carries ``ord``, its position in the table: the lookups that take
the first fitting row depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values.  These must be exactly as given for results to agree.
# ---------------------------------------------------------------------------

# Team name in the event feed -> team name in the results file.
TEAM_NAMES = [
    ("Bayer Leverkusen", "Leverkusen"),
    ("1. FC Heidenheim 1846", "Heidenheim"),
    ("SV Darmstadt 98", "Darmstadt"),
    ("1. FSV Mainz 05", "Mainz"),
    ("Borussia Dortmund", "Dortmund"),
    ("RB Leipzig", "RB Leipzig"),
    ("VfB Stuttgart", "Stuttgart"),
    ("SC Freiburg", "Freiburg"),
    ("FC Bayern München", "Bayern Munich"),
    ("Eintracht Frankfurt", "Ein Frankfurt"),
    ("VfL Wolfsburg", "Wolfsburg"),
    ("1. FC Köln", "FC Koln"),
    ("TSG Hoffenheim", "Hoffenheim"),
    ("Werder Bremen", "Werder Bremen"),
    ("VfL Bochum 1848", "Bochum"),
    ("FC Augsburg", "Augsburg"),
    ("Borussia Mönchengladbach", "M'gladbach"),
    ("1. FC Union Berlin", "Union Berlin"),
]

# Season totals: player, team, goals.
SEASON_SCORERS = [
    ("Harry Kane", "Bayern Munich", 36),
    ("Serhou Guirassy", "Stuttgart", 28),
    ("Victor Boniface", "Leverkusen", 14),
    ("Benjamin Sesko", "RB Leipzig", 14),
    ("Donyell Malen", "Dortmund", 13),
    ("Niclas Fullkrug", "Dortmund", 12),
    ("Marvin Ducksch", "Werder Bremen", 12),
    ("Tim Kleindienst", "Heidenheim", 12),
    ("Omar Marmoush", "Ein Frankfurt", 12),
    ("Florian Wirtz", "Leverkusen", 11),
    ("Andrej Kramaric", "Hoffenheim", 11),
    ("Patrik Schick", "Leverkusen", 7),
    ("Granit Xhaka", "Leverkusen", 3),
    ("Alejandro Grimaldo", "Leverkusen", 10),
    ("Jeremie Frimpong", "Leverkusen", 9),
    ("Jonas Hofmann", "Leverkusen", 5),
    ("Kai Havertz", "Arsenal", 0),
    ("Luca Waldschmidt", "Wolfsburg", 10),
    ("Wout Weghorst", "Hoffenheim", 8),
    ("Kevin Volland", "Ein Frankfurt", 8),
    ("Dawid Kownacki", "Dusseldorf", 8),
    ("Christoph Baumgartner", "RB Leipzig", 9),
    ("Robert Andrich", "Leverkusen", 4),
    ("Amine Adli", "Leverkusen", 4),
    ("Exequiel Palacios", "Leverkusen", 4),
]

# Season statistics: player, goals, assists, appearances, xG, note.
SEASON_STATS = [
    ("Victor Okoh Boniface", 14, 8, 23, 16.99, "top scorer"),
    ("Florian Wirtz", 11, 11, 32, 9.36, "creative engine"),
    ("Alejandro Grimaldo Garcia", 10, 13, 33, 5.48, "attacking fullback"),
    ("Alex Grimaldo", 10, 13, 33, 5.48, "attacking fullback"),
    ("Jeremie Frimpong", 9, 7, 31, 10.86, "marauding fullback"),
    ("Patrik Schick", 7, 0, 20, 6.78, "clinical striker"),
    ("Jonas Hofmann", 5, 7, 32, 6.53, "consistent winger"),
    ("Nathan Tella", 5, 2, 24, 3.71, "impact sub"),
    ("Jonathan Tah", 4, 1, 31, 2.29, "commanding centre-back"),
    ("Robert Andrich", 4, 2, 28, 2.21, "driving midfielder"),
    ("Amine Adli", 4, 6, 23, 3.68, "creative wide player"),
    ("Exequiel Alejandro Palacios", 4, 4, 24, 3.47, "box-to-box midfielder"),
    ("Granit Xhaka", 3, 0, 33, 1.41, "midfield metronome"),
    ("Josip Stanisic", 3, 1, 20, 0.70, "versatile fullback"),
    ("Adam Hlozek", 2, 3, 23, 3.05, "energetic forward"),
    ("Odilon Kossonou", 1, 0, 22, 0.67, "powerful defender"),
    ("Piero Martin Hincapie Reyna", 1, 2, 26, 2.35, "composed defender"),
    ("Victor Boniface", 14, 8, 23, 16.99, "top scorer"),
    ("Florian Wirtz ⚽", 11, 11, 32, 9.36, "creative engine"),
]

# Goal celebrations: player, nationality, cry, language, flag.
GOAL_CRIES = [
    ("Florian Wirtz", "German", "TOOOOOR!", "German", "🇩🇪"),
    ("Jonathan Tah", "German", "TOOOOOR!", "German", "🇩🇪"),
    ("Jonas Hofmann", "German", "TOOOOOR!", "German", "🇩🇪"),
    ("Robert Andrich", "German", "TOOOOOR!", "German", "🇩🇪"),
    ("Victor Okoh Boniface", "Nigerian", "GOAL-O! Oya!", "Nigerian", "🇳🇬"),
    ("Victor Boniface", "Nigerian", "GOAL-O! Oya!", "Nigerian", "🇳🇬"),
    ("Alejandro Grimaldo Garcia", "Spanish", "GOLAZO!", "Spanish", "🇪🇸"),
    ("Alex Grimaldo", "Spanish", "GOLAZO!", "Spanish", "🇪🇸"),
    ("Jeremie Frimpong", "Dutch", "DOELPUNT!", "Dutch", "🇳🇱"),
    ("Patrik Schick", "Czech", "GÓL! Neuvěřitelné!", "Czech", "🇨🇿"),
    ("Adam Hlozek", "Czech", "GÓL!", "Czech", "🇨🇿"),
    ("Granit Xhaka", "Swiss", "TOR! Wunderbar!", "Swiss", "🇨🇭"),
    ("Odilon Kossonou", "Ivorian", "BUUUT!", "French", "🇨🇮"),
    ("Josip Stanisic", "Croatian", "GOL! Fenomenalno!", "Croatian", "🇭🇷"),
    ("Amine Adli", "French", "BUUUT!", "French", "🇫🇷"),
    ("Nathan Tella", "French", "BUUUT!", "French", "🇫🇷"),
    ("Exequiel Alejandro Palacios", "Argentine", "GOLAZO!", "Spanish", "🇦🇷"),
    ("Piero Martin Hincapie Reyna", "Ecuadorian", "GOOOOOL!", "Spanish", "🇪🇨"),
]
DEFAULT_CRY = ("GOAAAAAL!", "English", "🌍")

# Badge colours: team, background, text.
TEAM_COLOURS = [
    ("Bayern Munich", "#dc052d", "#ffffff"),
    ("Dortmund", "#fde100", "#000000"),
    ("RB Leipzig", "#dd0741", "#ffffff"),
    ("Leverkusen", "#e32221", "#000000"),
    ("Ein Frankfurt", "#e1000f", "#ffffff"),
    ("Stuttgart", "#e32221", "#ffffff"),
    ("Hoffenheim", "#1761a7", "#ffffff"),
    ("Wolfsburg", "#65b32e", "#ffffff"),
    ("Freiburg", "#e1000f", "#ffffff"),
    ("Werder Bremen", "#1d9f4f", "#ffffff"),
    ("Heidenheim", "#c0392b", "#ffffff"),
    ("Darmstadt", "#005ca9", "#ffffff"),
    ("M'gladbach", "#1a1a1a", "#ffffff"),
    ("Union Berlin", "#e32221", "#ffffff"),
    ("Bochum", "#005ca9", "#ffffff"),
    ("Augsburg", "#ba3733", "#ffffff"),
    ("Mainz", "#c3112d", "#ffffff"),
    ("FC Koln", "#e32221", "#ffffff"),
    ("Koln", "#e32221", "#ffffff"),
]
DEFAULT_COLOURS = ("#d20515", "#ffffff")

# Place of a position in a line-up, back to front.
POSITION_ORDER = [
    ("Goalkeeper", 0),
    ("Right Back", 1),
    ("Right Centre Back", 1),
    ("Centre Back", 1),
    ("Left Centre Back", 1),
    ("Left Back", 1),
    ("Right Wing Back", 2),
    ("Left Wing Back", 2),
    ("Right Defensive Midfield", 3),
    ("Centre Defensive Midfield", 3),
    ("Left Defensive Midfield", 3),
    ("Right Centre Midfield", 4),
    ("Centre Midfield", 4),
    ("Left Centre Midfield", 4),
    ("Right Midfield", 4),
    ("Left Midfield", 4),
    ("Right Attacking Midfield", 5),
    ("Centre Attacking Midfield", 5),
    ("Left Attacking Midfield", 5),
    ("Right Wing", 6),
    ("Left Wing", 6),
    ("Centre Forward", 7),
    ("Right Centre Forward", 7),
    ("Left Centre Forward", 7),
]
DEFAULT_POSITION_ORDER = 99

# Words added to the language line of a prompt; other languages add none.
LANGUAGE_NOTES = [
    ("German", "German football culture"),
    ("French", "French flair for a French player"),
    ("Dutch", "Dutch football culture"),
    ("Czech", "celebrating in Czech"),
    ("Croatian", "Croatian passion"),
]

# ---------------------------------------------------------------------------


def _frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    numbered = [(i, *row) for i, row in enumerate(rows, 1)]
    return spark.createDataFrame(numbered, f"ord int, {columns}")


def team_names(spark: SparkSession) -> DataFrame:
    return _frame(spark, TEAM_NAMES, "feed_name string, team string")


def season_scorers(spark: SparkSession) -> DataFrame:
    return _frame(spark, SEASON_SCORERS, "name string, team string, goals int")


def season_stats(spark: SparkSession) -> DataFrame:
    return _frame(
        spark, SEASON_STATS,
        "name string, goals int, assists int, apps int, xg double, note string",
    )


def goal_cries(spark: SparkSession) -> DataFrame:
    return _frame(
        spark, GOAL_CRIES,
        "name string, nationality string, cry string, language string, flag string",
    )


def team_colours(spark: SparkSession) -> DataFrame:
    return _frame(spark, TEAM_COLOURS, "team string, background string, foreground string")


def position_order(spark: SparkSession) -> DataFrame:
    return _frame(spark, POSITION_ORDER, "position string, place int")


def language_notes(spark: SparkSession) -> DataFrame:
    return _frame(spark, LANGUAGE_NOTES, "language string, language_note string")
