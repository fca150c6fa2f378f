"""The driver's tables seen as matches, events and texts.

``results`` are orders: one match each, thousands of rounds over several
seasons.  ``feed_*`` are events: 120 matches of six hours whose size grows
with the scale factor.  Each view exists twice, as a DataFrame and as a
named SQL block; ``sql`` puts the blocks a query needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import conform

FOCUS = "Team 3"
SEASON = ["season"]


# Columns in use, declared so that opening a table needs no job of its own.
COLUMNS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf}/{name}.parquet")


# --- matches out of orders -------------------------------------------------


def v_match(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    key, cust, nat = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    pairs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("match_id"),
        F.to_date("o_orderdate").alias("match_date"),
        F.year("o_orderdate").alias("season"),
        nat.alias("home_id"),
        ((nat + 1 + key % 24) % 25).cast("int").alias("away_id"),
        ((key * 7 + cust) % 5).cast("int").alias("home_goals"),
        ((key * 3 + cust) % 4).cast("int").alias("away_goals"),
    )
    home = nation.select(F.col("n_nationkey").alias("home_id"), F.col("n_name").alias("home_team"))
    away = nation.select(F.col("n_nationkey").alias("away_id"), F.col("n_name").alias("away_team"))
    return pairs.join(home, "home_id").join(away, "away_id").select(
        "match_id", "season", "match_date", "home_id", "away_id",
        "home_team", "away_team", "home_goals", "away_goals",
    )


def v_season(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with their round and their place in the list."""
    return conform.assign_round(v_match(spark, sf), SEASON, "match_date", "match_id")


def raw_results(spark: SparkSession, sf: str) -> DataFrame:
    """Matches as an all-text results file with gaps and misprints."""
    m = v_match(spark, sf)
    mid = F.col("match_id")

    def number(seed: int, limit: int):
        return (
            F.when(mid % 17 == seed, "N/A").when(mid % 19 == seed, "").when(mid % 23 == seed, "x")
            .otherwise(((mid * seed) % limit).cast("string"))
        )

    columns = {
        "Date": F.when(mid % 29 == 0, "31/02/1999").otherwise(F.date_format("match_date", "dd/MM/yyyy")),
        "HomeTeam": F.col("home_team"),
        "AwayTeam": F.col("away_team"),
        "FTHG": F.when(mid % 31 == 0, "").otherwise(F.col("home_goals").cast("string")),
        "FTAG": F.when(mid % 37 == 0, "N/A").otherwise(F.col("away_goals").cast("string")),
    }
    for seed, name in enumerate(
        ["HTHG", "HTAG", "HS", "AS", "HST", "AST", "HC", "AC", "HY", "AY", "HR", "AR"], 3
    ):
        columns[name] = number(seed, 4 + seed)
    for seed, name in enumerate(["PSH", "PSD", "PSA"], 5):
        odds = ((mid * seed) % 900 + 101) / 100
        columns[name] = F.when(mid % 13 == seed, "N/A").otherwise(odds.cast("string"))
    return m.select("match_id", "season", *[c.alias(n) for n, c in columns.items()])


# --- events ----------------------------------------------------------------


def player_name(user):
    return F.concat(F.lit("First"), (user % 7).cast("string"), F.lit(" Last"), user.cast("string"))


def home_number(match):
    return match % 25


def away_number(match):
    return (match % 25 + 1 + F.floor(match / 25) % 24) % 25


def feed_base(events: DataFrame, *extra: str) -> DataFrame:
    """Columns of the events table from which all feed columns are made."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return events.select(
        "event_id",
        (day * 4 + F.floor(F.hour("ts") / 6)).alias("match_id"),
        ((F.hour("ts") % 6) * 60 + F.minute("ts")).cast("int").alias("minute"),
        "user_id", "value", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        *extra,
    )


def feed_columns(base: DataFrame, *extra: str) -> DataFrame:
    k, user, match, kind = F.col("k"), F.col("user_id"), F.col("match_id"), F.col("event_type")
    shot, swap, error = kind == "purchase", kind == "signup", kind == "error"
    least = F.when(match % 3 == 0, 20).when(match % 3 == 1, 100).otherwise(200)
    card = F.when(k < 10, "Red Card").when(k < 15, "Second Yellow").when(k < 40, "Yellow Card")
    misconduct = error & (k % 2 == 0)
    foul = error & (k % 2 == 1)
    side = F.when(user % 2 == 0, home_number(match)).otherwise(away_number(match))
    return base.select(
        "match_id",
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("index"),
        F.when(F.col("minute") < 150, 1).when(F.col("minute") < 300, 2).otherwise(3).alias("period"),
        "minute",
        F.when(shot, "Shot").when(swap, "Substitution").when(misconduct, "Bad Behaviour")
        .when(foul, "Foul Committed").otherwise("Pass").alias("type"),
        F.concat(F.lit("NATION_"), side.cast("string")).alias("team"),
        F.when(k != 99, player_name(user)).alias("player"),
        F.when(shot & (k != 98), F.array((k * 6).cast("double") / 5, (k * 4).cast("double") / 5)).alias("location"),
        F.when(shot, F.col("value") / 500).alias("shot_xg"),
        F.when(shot, F.when(F.col("value") > least, "Goal").when(F.col("value") > 10, "Saved")
               .otherwise("Off T")).alias("shot_outcome"),
        F.when(shot, F.when(k % 4 == 0, "Volley").otherwise("Normal")).alias("shot_technique"),
        F.when(shot, F.when(k % 3 == 0, "Head").otherwise("Right Foot")).alias("shot_body_part"),
        F.when(shot & (k % 10 == 0), "Penalty").alias("shot_type"),
        F.when(shot, (F.col("event_id") - 1 - k % 3).cast("string")).alias("key_pass_id"),
        F.when(k % 5 == 0, "From Corner").otherwise("Regular Play").alias("play_pattern"),
        (k % 6 == 0).alias("pass_cross"),
        F.when(swap, player_name(user + 2)).alias("substitution_replacement"),
        F.when(misconduct, card).alias("bad_behaviour_card"),
        F.when(foul, card).alias("foul_committed_card"),
        *extra,
    )


def feed_events(spark: SparkSession, sf: str) -> DataFrame:
    return feed_columns(feed_base(table(spark, sf, "events")))


def team_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Feed name and own name of the teams; every fifth team is missing."""
    return table(spark, sf, "nation").filter(F.col("n_nationkey") % 5 != 4).select(
        F.col("n_nationkey").alias("ord"),
        F.col("n_name").alias("feed_name"),
        F.concat(F.lit("Team "), F.col("n_nationkey").cast("string")).alias("team"),
    )


def feed_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of the events, with final scores that count an own goal now and then."""
    goal = conform.is_goal(F.col("shot_outcome"))
    events = feed_events(spark, sf).select(
        "match_id", "team", "shot_outcome",
        F.concat(F.lit("NATION_"), home_number(F.col("match_id")).cast("string")).alias("home_team"),
        F.concat(F.lit("NATION_"), away_number(F.col("match_id")).cast("string")).alias("away_team"),
    )
    at_home = F.col("team") == F.col("home_team")
    extra = F.when(F.col("match_id") % 7 == 0, 1).otherwise(0)
    matches = events.groupBy("match_id", "home_team", "away_team").agg(
        F.count_if(goal & at_home).alias("_h"), F.count_if(goal & ~at_home).alias("_a")
    ).select(
        "match_id",
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("match_id") / 4).cast("int")).alias("match_date"),
        F.lit(2024).alias("season"),
        (F.floor(F.col("match_id") / 4) + 1).cast("int").alias("match_week"),
        "home_team", "away_team",
        (F.col("_h") + extra).cast("int").alias("home_score"),
        F.col("_a").cast("int").alias("away_score"),
    )
    return conform.conform_names(
        matches, team_dimension(spark, sf), {"home_team": "home_fd", "away_team": "away_fd"}
    )


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of the events without their scores, which need no event column but the time."""
    found = feed_base(table(spark, sf, "events")).select("match_id").distinct()
    named = found.select(
        "match_id",
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("match_id") / 4).cast("int")).alias("match_date"),
        F.year(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("match_id") / 4).cast("int"))).alias("season"),
        (F.floor(F.col("match_id") / 4) + 1).cast("int").alias("match_round"),
        F.concat(F.lit("NATION_"), home_number(F.col("match_id")).cast("string")).alias("home_team"),
        F.concat(F.lit("NATION_"), away_number(F.col("match_id")).cast("string")).alias("away_team"),
    )
    return conform.conform_names(
        named, team_dimension(spark, sf), {"home_team": "home_fd", "away_team": "away_fd"}
    )


# --- the same in SQL -------------------------------------------------------

BLOCKS = {
    "v_match": ([], """
      SELECT o_orderkey AS match_id, CAST(year(o_orderdate) AS INTEGER) AS season,
             CAST(o_orderdate AS DATE) AS match_date, c_nationkey AS home_id,
             CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS away_id,
             h.n_name AS home_team, a.n_name AS away_team,
             CAST((o_orderkey * 7 + o_custkey) % 5 AS INTEGER) AS home_goals,
             CAST((o_orderkey * 3 + o_custkey) % 4 AS INTEGER) AS away_goals
      FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation h ON h.n_nationkey = c_nationkey
      JOIN nation a ON a.n_nationkey = (c_nationkey + 1 + o_orderkey % 24) % 25"""),
    "v_season": (["v_match"], """
      SELECT *, CAST((row_number() OVER (PARTITION BY season ORDER BY match_date, match_id) - 1) // 9 + 1
                     AS INTEGER) AS round
      FROM v_match"""),
    "ev0": ([], """
      SELECT event_id,
             CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 4 + hour(ts) // 6 AS BIGINT) AS match_id,
             CAST((hour(ts) % 6) * 60 + minute(ts) AS INTEGER) AS minute,
             user_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
      FROM events"""),
    "ev": (["ev0"], """
      SELECT match_id, CAST(event_id AS VARCHAR) AS event_id, event_id AS index,
             CASE WHEN minute < 150 THEN 1 WHEN minute < 300 THEN 2 ELSE 3 END AS period, minute,
             CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'signup' THEN 'Substitution'
                  WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'Bad Behaviour' ELSE 'Foul Committed' END
                  ELSE 'Pass' END AS type,
             'NATION_' || CASE WHEN user_id % 2 = 0 THEN match_id % 25
                          ELSE (match_id % 25 + 1 + (match_id // 25) % 24) % 25 END AS team,
             'NATION_' || (match_id % 25) AS home_team,
             'NATION_' || ((match_id % 25 + 1 + (match_id // 25) % 24) % 25) AS away_team,
             CASE WHEN user_id % 2 = 0 THEN match_id % 25
                  ELSE (match_id % 25 + 1 + (match_id // 25) % 24) % 25 END AS team_no,
             CASE WHEN k <> 99 THEN 'First' || (user_id % 7) || ' Last' || user_id END AS player,
             CASE WHEN event_type = 'purchase' AND k <> 98 THEN CAST(k * 6 AS DOUBLE) / 5 END AS x,
             CASE WHEN event_type = 'purchase' AND k <> 98 THEN CAST(k * 4 AS DOUBLE) / 5 END AS y,
             CASE WHEN event_type = 'purchase' THEN value / 500 END AS shot_xg,
             CASE WHEN event_type = 'purchase' THEN
               CASE WHEN value > CASE match_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 100 ELSE 200 END THEN 'Goal'
                    WHEN value > 10 THEN 'Saved' ELSE 'Off T' END END AS shot_outcome,
             CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'Volley' ELSE 'Normal' END END AS shot_technique,
             CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'Head' ELSE 'Right Foot' END END AS shot_body_part,
             CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'Penalty' END AS shot_type,
             CASE WHEN event_type = 'purchase' THEN CAST(event_id - 1 - k % 3 AS VARCHAR) END AS key_pass_id,
             CASE WHEN k % 5 = 0 THEN 'From Corner' ELSE 'Regular Play' END AS play_pattern,
             k % 6 = 0 AS pass_cross,
             CASE WHEN event_type = 'signup' THEN 'First' || ((user_id + 2) % 7) || ' Last' || (user_id + 2) END
               AS substitution_replacement,
             CASE WHEN event_type = 'error' AND k % 2 = 0 THEN
               CASE WHEN k < 10 THEN 'Red Card' WHEN k < 15 THEN 'Second Yellow' WHEN k < 40 THEN 'Yellow Card' END END
               AS bad_behaviour_card,
             CASE WHEN event_type = 'error' AND k % 2 = 1 THEN
               CASE WHEN k < 10 THEN 'Red Card' WHEN k < 15 THEN 'Second Yellow' WHEN k < 40 THEN 'Yellow Card' END END
               AS foul_committed_card
      FROM ev0"""),
    "teams": ([], """
      SELECT n_nationkey AS ord, n_name AS feed_name, 'Team ' || n_nationkey AS team
      FROM nation WHERE n_nationkey % 5 <> 4"""),
    "fixtures": (["ev", "teams"], """
      SELECT m.*, coalesce(h.team, m.home_team) AS home_fd, coalesce(a.team, m.away_team) AS away_fd
      FROM (SELECT match_id, CAST(DATE '2024-01-01' + CAST(match_id // 4 AS INTEGER) AS DATE) AS match_date,
                   2024 AS season, CAST(match_id // 4 + 1 AS INTEGER) AS match_round, home_team, away_team,
                   CAST(count(*) FILTER (shot_outcome = 'Goal' AND team = home_team)
                        + CASE WHEN match_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS home_score,
                   CAST(count(*) FILTER (shot_outcome = 'Goal' AND team <> home_team) AS INTEGER) AS away_score
            FROM ev GROUP BY match_id, home_team, away_team) m
      LEFT JOIN teams h ON h.feed_name = m.home_team
      LEFT JOIN teams a ON a.feed_name = m.away_team"""),
    "shots": (["ev", "fixtures"], """
      SELECT e.match_id, f.home_fd, f.away_fd, f.match_date, e.index,
             CASE WHEN e.team = f.home_team THEN f.home_fd ELSE f.away_fd END AS team_fd,
             e.player, e.minute, e.x, e.y,
             CAST(round(CAST(e.shot_xg AS DECIMAL(18,6)), 4) AS DOUBLE) AS xg,
             CASE WHEN e.shot_outcome = 'Goal' THEN 1 ELSE 0 END AS is_goal,
             e.shot_outcome AS outcome, e.shot_technique AS technique, e.shot_body_part AS body_part,
             CAST(sum(CASE WHEN e.shot_outcome = 'Goal' AND e.team = e.home_team THEN 1 ELSE 0 END) OVER w AS INTEGER) AS home_score,
             CAST(sum(CASE WHEN e.shot_outcome = 'Goal' AND e.team <> e.home_team THEN 1 ELSE 0 END) OVER w AS INTEGER) AS away_score
      FROM ev e JOIN fixtures f ON e.match_id = f.match_id WHERE e.type = 'Shot'
      WINDOW w AS (PARTITION BY e.match_id ORDER BY e.index ROWS UNBOUNDED PRECEDING)"""),
    "keyev": (["ev", "fixtures"], """
      SELECT e.match_id, f.home_fd, f.away_fd, f.match_date, e.index,
             CASE WHEN e.type = 'Shot' THEN 'goal' ELSE 'red_card' END AS event_type,
             e.player, CASE WHEN e.team = f.home_team THEN f.home_fd ELSE f.away_fd END AS team_fd, e.minute,
             CASE WHEN e.type = 'Shot' THEN CAST(round(CAST(e.shot_xg AS DECIMAL(18,6)), 3) AS DOUBLE) ELSE 0.0 END AS xg
      FROM ev e JOIN fixtures f ON e.match_id = f.match_id
      WHERE (e.type = 'Shot' AND e.shot_outcome = 'Goal')
         OR (e.type = 'Bad Behaviour' AND e.bad_behaviour_card IN ('Red Card', 'Second Yellow'))
         OR (e.type = 'Foul Committed' AND e.foul_committed_card IN ('Red Card', 'Second Yellow'))"""),
}


def sql(body: str, *blocks: str) -> str:
    """``body`` with the named blocks, and those they need, put in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in BLOCKS[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for block in blocks:
        need(block)
    if not needed:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][1].strip()})" for n in needed) + "\n" + body.strip()
