"""Sports tables derived from the driver's star schema (no sports data is supplied).

A game is an order, a team is one of 96 clubs in 8 leagues, a box score is a game's line items, a
book quote is a line item priced by its supplier, and the quote log is the event stream. Every
table is defined twice with the same arithmetic: as Spark columns and as SQL for the oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def with_(names: str, body: str) -> str:
    """SQL with the named stand-in tables (and those they need) in front."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][0]:
            add(d)
        done.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ games
CTES["games"] = ((), """
  SELECT *, home_pts + away_pts AS total, home_1h + away_1h AS first_half, home_pts + away_pts - home_1h - away_1h AS second_half,
         line_close + ((game_key * 31) % 9 - 4) * 0.5e0 AS line_open, floor(line_close) / 2.0e0 AS line_2h,
         home_spread_close + (game_key % 3 - 1) * 0.5e0 AS home_spread_open
  FROM (SELECT *, 80 + cents % 41 + home % 5 AS home_pts, 78 + (cents // 41) % 41 + away % 5 AS away_pts,
               36 + cents % 17 AS home_1h, 35 + (cents // 17) % 17 AS away_1h,
               200 + ((game_key * 7919) % 21 - 10) * 0.5e0 + (home % 5 + away % 5) * 0.5e0 AS line_close,
               ((game_key * 13) % 41 - 20) * 0.5e0 AS home_spread_close
        FROM (SELECT o_orderkey AS game_key, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS season,
                     o_custkey % 8 AS league, o_custkey % 96 AS home,
                     (o_custkey % 96 + 8 * (1 + o_orderkey % 11)) % 96 AS away,
                     CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 9 = 0 AS neutral,
                     o_orderkey % 17 <> 0 AS ok_close, o_orderkey % 13 <> 0 AS ok_open,
                     o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0 AS ok_2h, true AS clean
              FROM orders))""")


def games(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    home = cust % 96
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    g = table(spark, sf, "orders").select(
        key.alias("game_key"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").cast("bigint").alias("season"),
        (cust % 8).alias("league"), home.alias("home"), ((home + 8 * (1 + key % 11)) % 96).alias("away"),
        cents.alias("cents"), (key % 9 == 0).alias("neutral"), (key % 17 != 0).alias("ok_close"),
        (key % 13 != 0).alias("ok_open"), ((key % 17 != 0) & (key % 5 != 0)).alias("ok_2h"), F.lit(True).alias("clean"))
    k, c, h, a = F.col("game_key"), F.col("cents"), F.col("home"), F.col("away")
    g = g.withColumns({
        "home_pts": 80 + c % 41 + h % 5, "away_pts": 78 + F.expr("(cents div 41) % 41") + a % 5,
        "home_1h": 36 + c % 17, "away_1h": 35 + F.expr("(cents div 17) % 17"),
        "line_close": 200 + ((k * 7919) % 21 - 10) * 0.5 + (h % 5 + a % 5) * 0.5,
        "home_spread_close": ((k * 13) % 41 - 20) * 0.5})
    return g.withColumns({
        "total": F.col("home_pts") + F.col("away_pts"), "first_half": F.col("home_1h") + F.col("away_1h"),
        "second_half": F.col("home_pts") + F.col("away_pts") - F.col("home_1h") - F.col("away_1h"),
        "line_open": F.col("line_close") + ((k * 31) % 9 - 4) * 0.5, "line_2h": F.floor("line_close") / 2.0,
        "home_spread_open": F.col("home_spread_close") + (k % 3 - 1) * 0.5})


# ------------------------------------------------------------------ box scores
STATS = ["fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "oreb", "dreb", "tov", "pf"]

CTES["side_rows"] = ((), """
  SELECT l_orderkey AS game_key, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS side,
         CAST(sum(l_quantity) AS BIGINT) AS q, CAST(count(*) AS BIGINT) AS m,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS e
  FROM lineitem GROUP BY 1, 2""")
CTES["side_box"] = (("side_rows",), """
  SELECT game_key, side, 70 + q % 30 AS fga, 28 + e % 19 AS fgm, 15 + e % 13 AS fg3a, 5 + (e // 13) % 8 AS fg3m,
         12 + (e // 7) % 17 AS fta, 6 + (e // 7) % 17 - (e // 11) % 6 AS ftm, 5 + (e // 3) % 11 AS oreb,
         20 + (e // 5) % 15 AS dreb, 8 + m % 9 AS tov, 12 + m % 11 AS pf
  FROM side_rows""")
CTES["box"] = (("games", "side_box"), """
  SELECT g.game_key, g.league, g.season, g.date, x.side, CASE WHEN x.side = 'home' THEN g.home ELSE g.away END AS team,
         CASE WHEN x.side = 'home' THEN g.away ELSE g.home END AS opp,
         CASE WHEN x.side = 'home' THEN g.home_pts ELSE g.away_pts END AS pts,
         CASE WHEN x.side = 'home' THEN g.away_pts ELSE g.home_pts END AS pts_opp,
         """ + ", ".join(f"x.{s}, y.{s} AS {s}_opp" for s in STATS) + """,
         0.5e0 * ((x.fga - x.oreb + x.tov + 0.44e0 * x.fta) + (y.fga - y.oreb + y.tov + 0.44e0 * y.fta)) AS poss
  FROM games g JOIN side_box x USING (game_key) JOIN side_box y ON y.game_key = x.game_key AND y.side <> x.side""")


def side_stats(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (game, side) with raw box counts."""
    r = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("game_key"),
        F.when(F.col("l_linenumber") % 2 == 1, "home").otherwise("away").alias("side")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("m"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("e"))
    return r.selectExpr(
        "game_key", "side", "70 + q % 30 AS fga", "28 + e % 19 AS fgm", "15 + e % 13 AS fg3a", "5 + (e div 13) % 8 AS fg3m",
        "12 + (e div 7) % 17 AS fta", "6 + (e div 7) % 17 - (e div 11) % 6 AS ftm", "5 + (e div 3) % 11 AS oreb",
        "20 + (e div 5) % 15 AS dreb", "8 + m % 9 AS tov", "12 + m % 11 AS pf")


def box(spark: SparkSession, sf: str) -> DataFrame:
    """Team box rows with the opponent's counts, games with both sides only."""
    from slatemill.operators.clean import possessions, with_opponent

    paired = with_opponent(side_stats(spark, sf), STATS)
    g = games(spark, sf).select("game_key", "league", "season", "date", "home", "away", "home_pts", "away_pts")
    is_home = F.col("side") == "home"
    pick = lambda a, b: F.when(is_home, F.col(a)).otherwise(F.col(b))
    b = g.join(paired, "game_key").select(
        "game_key", "league", "season", "date", "side", pick("home", "away").alias("team"), pick("away", "home").alias("opp"),
        pick("home_pts", "away_pts").alias("pts"), pick("away_pts", "home_pts").alias("pts_opp"),
        *STATS, *[f"{s}_opp" for s in STATS])
    return b.withColumn("poss", possessions(0.44))


# ------------------------------------------------------------------ book quotes of a game
CTES["book_quotes"] = ((), """
  SELECT game_key, book, q, d, t, 202 + ((game_key * 7919) % 21 - 10) * 0.5e0 + (q % 9 - 4) * 0.5e0 + CASE WHEN q % 23 = 0 THEN 7 ELSE 0 END AS open,
         202 + ((game_key * 7919) % 21 - 10) * 0.5e0 + (q % 5 - 2) * 0.5e0 AS close,
         CASE WHEN q % 31 = 0 THEN 0 WHEN d = 0 THEN 100 + q ELSE -(100 + 2 * d) END AS open_over,
         CASE WHEN t = 0 THEN 100 + q % 7 ELSE -(100 + 3 * t) END AS open_under
  FROM (SELECT game_key, book, q, d, t FROM (
          SELECT l_orderkey AS game_key, l_suppkey AS book, CAST(l_quantity AS BIGINT) AS q,
                 CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t,
                 row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_quantity DESC, l_discount DESC, l_tax DESC) AS rn
          FROM lineitem) WHERE rn = 1)""")


def book_quotes(spark: SparkSession, sf: str) -> DataFrame:
    pct = lambda c: F.round(F.col(c) * 100).cast("bigint")
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game_key"), F.col("l_suppkey").alias("book")).agg(
        F.max(F.struct(F.col("l_quantity").cast("bigint").alias("q"), pct("l_discount").alias("d"), pct("l_tax").alias("t"))).alias("x"))
    return r.select("game_key", "book", "x.*").selectExpr(
        "game_key", "book", "q", "d", "t",
        "CAST(202 + ((game_key * 7919) % 21 - 10) * 0.5D + (q % 9 - 4) * 0.5D + CASE WHEN q % 23 = 0 THEN 7 ELSE 0 END AS DOUBLE) AS open",
        "202 + ((game_key * 7919) % 21 - 10) * 0.5D + (q % 5 - 2) * 0.5D AS close",
        "CASE WHEN q % 31 = 0 THEN 0 WHEN d = 0 THEN 100 + q ELSE -(100 + 2 * d) END AS open_over",
        "CASE WHEN t = 0 THEN 100 + q % 7 ELSE -(100 + 3 * t) END AS open_under")


# ------------------------------------------------------------------ quote log
SHARP = "view"
SOFT = ["click", "purchase", "signup", "error"]

CTES["quotes"] = ((), """
  SELECT fixture_id, start, book, line, side, t, seq, active, incl_ot,
         1.9e0 + (line - 152.5e0) * 0.04e0 * CASE WHEN side = 'over' THEN 1 ELSE -1 END + (v % 40) / 100.0e0 - 0.2e0 AS price
  FROM (SELECT user_id AS fixture_id, TIMESTAMP '2024-01-10 00:00:00' + (user_id % 480) * INTERVAL 1 HOUR AS start,
               event_type AS book, ts AS t, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS v,
               CASE k % 3 WHEN 0 THEN 150.5e0 WHEN 1 THEN 152.5e0 ELSE 155.0e0 END AS line,
               CASE WHEN (k // 3) % 2 = 0 THEN 'over' ELSE 'under' END AS side, k % 10 <> 0 AS active, k % 7 <> 0 AS incl_ot
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
  WHERE t < start""")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-game price changes: (fixture, book, line, side, t) with price and active flag."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    e = e.select(
        F.col("user_id").alias("fixture_id"),
        (F.lit("2024-01-10 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("user_id") % 480).cast("int"))).alias("start"),
        F.col("event_type").alias("book"), F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("seq"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        F.when(F.col("k") % 3 == 0, 150.5).when(F.col("k") % 3 == 1, 152.5).otherwise(155.0).alias("line"),
        F.when(F.expr("(k div 3) % 2 = 0"), "over").otherwise("under").alias("side"),
        (F.col("k") % 10 != 0).alias("active"), (F.col("k") % 7 != 0).alias("incl_ot"))
    slope = F.when(F.col("side") == "over", 1).otherwise(-1)
    price = 1.9 + (F.col("line") - 152.5) * 0.04 * slope + (F.col("v") % 40) / 100.0 - 0.2
    return e.where(F.col("t") < F.col("start")).withColumn("price", price).drop("v")


CTES["finals"] = ((), "SELECT DISTINCT user_id AS fixture_id, 140 + (user_id * 37) % 25 AS final, 148.0e0 + user_id % 9 AS model FROM events")


def finals(spark: SparkSession, sf: str) -> DataFrame:
    """Results and model forecasts per fixture."""
    u = table(spark, sf, "events").select(F.col("user_id").alias("fixture_id")).distinct()
    return u.select("fixture_id", (140 + (F.col("fixture_id") * 37) % 25).alias("final"), (148.0 + F.col("fixture_id") % 9).alias("model"))


# ------------------------------------------------------------------ probability forecasts
CTES["forecasts"] = ((), """
  SELECT l.doc_id, d.lang, d.source, CAST(l.quality AS BIGINT) AS y, 0.05e0 + 0.9e0 * ((d.n_chars * 7919 + d.doc_id * 31) % 1000) / 1000.0e0 AS p,
         0.5e0 AS p_base, d.doc_id % 40 AS day
  FROM labels l JOIN documents d USING (doc_id)""")


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Binary outcomes with a forecast: one row per labelled document."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").cast("bigint").alias("y"),
        (0.05 + 0.9 * ((F.col("n_chars") * 7919 + F.col("doc_id") * 31) % 1000) / 1000.0).alias("p"),
        F.lit(0.5).alias("p_base"), (F.col("doc_id") % 40).alias("day"))


# ------------------------------------------------------------------ graded bets
CTES["bets"] = (("games",), """
  SELECT *, CASE WHEN outcome = line THEN 0 WHEN (outcome - line) * side > 0 THEN 1 ELSE -1 END AS sign,
         CASE WHEN outcome = line THEN 0.0e0 WHEN (outcome - line) * side > 0 THEN price - 1 ELSE -1.0e0 END AS pnl
  FROM (SELECT game_key, league, season, date, home, away, line_open AS line, line_close, total AS outcome, ok_close,
               CASE WHEN (game_key * 17) % 2 = 0 THEN 1 ELSE -1 END AS side, 0.45e0 + ((game_key * 7) % 41) / 200.0e0 AS p,
               1.8e0 + ((game_key * 3) % 31) / 100.0e0 AS price, home_pts, away_pts, neutral
        FROM games WHERE ok_open)""")


def bets(spark: SparkSession, sf: str) -> DataFrame:
    """One graded single per open-line game."""
    from slatemill.functions.odds import flat_profit, outcome_sign

    k = F.col("game_key")
    b = games(spark, sf).where("ok_open").select(
        "game_key", "league", "season", "date", "home", "away", F.col("line_open").alias("line"), "line_close",
        F.col("total").alias("outcome"), "ok_close", F.when((k * 17) % 2 == 0, 1).otherwise(-1).alias("side"),
        (0.45 + ((k * 7) % 41) / 200.0).alias("p"), (1.8 + ((k * 3) % 31) / 100.0).alias("price"), "home_pts", "away_pts", "neutral")
    b = b.withColumn("sign", outcome_sign(F.col("outcome"), F.col("line"), F.col("side")))
    return b.withColumn("pnl", flat_profit(F.col("sign"), F.col("price")))


# ------------------------------------------------------------------ player box
CTES["player_box"] = (("games",), """
  SELECT g.season, g.league, g.date, g.game_key AS game, l.l_suppkey AS player,
         CASE WHEN l.l_suppkey % 2 = 0 THEN g.home ELSE g.away END AS team,
         CAST(max(l.l_quantity) AS DOUBLE) AS minutes, CAST(max(CAST(round(l.l_extendedprice) AS BIGINT) % 31) AS DOUBLE) AS points
  FROM lineitem l JOIN games g ON g.game_key = l.l_orderkey GROUP BY ALL""")


def player_box(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).select("game_key", "season", "league", "date", "home", "away")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game_key"), F.col("l_suppkey").alias("player"), "l_quantity", "l_extendedprice")
    li = li.repartition("game_key").groupBy("game_key", "player").agg(                     # one shuffle serves the sums and the join
        F.max("l_quantity").alias("minutes"), F.max(F.round("l_extendedprice").cast("bigint") % 31).cast("double").alias("points"))
    return g.join(li, "game_key").select(
        "season", "league", "date", F.col("game_key").alias("game"), "player",
        F.when(F.col("player") % 2 == 0, F.col("home")).otherwise(F.col("away")).alias("team"), "minutes", "points")
