"""Season files: results XML with box JSON, and row-paired score sheets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatemill.functions.numbers import coerce_number
from slatemill.functions.text import paired_list
from slatemill.operators.running import running_max

RESULTS = ("gamecode string, date string, round string, hometeam string, awayteam string, homescore int, awayscore int, played boolean, referees string")
BOX = ("gamecode string, team string, fieldGoalsMade2 int, fieldGoalsAttempted2 int, fieldGoalsMade3 int, fieldGoalsAttempted3 int, freeThrowsMade int, "
       "freeThrowsAttempted int, offensiveRebounds int, defensiveRebounds int, turnovers int, fouls int")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "game").schema(RESULTS).load(path)


def parse_season(results: DataFrame, box: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Played games (one row each, referees split) and their team rows, from the results feed and the
    box feed joined on the game code."""
    g = results.where(F.coalesce("played", F.lit(False)) & F.col("homescore").isNotNull()).select(
        F.col("gamecode").alias("game_key"), F.to_date("date", "MMM d, yyyy").alias("date"), "round", F.col("hometeam").alias("home"), F.col("awayteam").alias("away"),
        F.col("homescore").alias("home_pts"), F.col("awayscore").alias("away_pts"), (F.col("homescore") + F.col("awayscore")).alias("total"),
        paired_list(F.col("referees")).alias("refs"))
    c = F.col
    b = box.select(c("gamecode").alias("game_key"), "team", (c("fieldGoalsMade2") + c("fieldGoalsMade3")).alias("fgm"), (c("fieldGoalsAttempted2") + c("fieldGoalsAttempted3")).alias("fga"),
                   c("fieldGoalsMade3").alias("fg3m"), c("fieldGoalsAttempted3").alias("fg3a"), c("freeThrowsMade").alias("ftm"), c("freeThrowsAttempted").alias("fta"),
                   c("offensiveRebounds").alias("oreb"), c("defensiveRebounds").alias("dreb"), c("turnovers").alias("tov"), c("fouls").alias("pf"))
    rows = g.select("game_key", F.explode(F.array(F.struct(F.lit("home").alias("side"), c("home").alias("team")), F.struct(F.lit("away").alias("side"), c("away").alias("team")))).alias("s"))
    return g, rows.select("game_key", "s.*").join(b, ["game_key", "team"])


def split_total(a: Column, b: Column, floor: float) -> tuple[Column, Column]:
    """Of two cells one holds the total (>= floor), the other the favourite's spread: returns the
    total and the home spread (b is the home row: its own number, else minus the other's)."""
    va, vb = coerce_number(a), coerce_number(b)
    big_a, big_b = F.coalesce(va >= floor, F.lit(False)), F.coalesce(vb >= floor, F.lit(False))
    small_a, small_b = F.coalesce(va < floor, F.lit(False)), F.coalesce(vb < floor, F.lit(False))
    total = F.when(big_a & ~big_b, va).when(big_b & ~big_a, vb)
    spread = F.when(small_b & ~small_a, vb).when(small_a & ~small_b, -va)
    return total, spread


def parse_paired_rows(rows: DataFrame, sheet: str = "season", chunk_rows: int = 65536) -> DataFrame:
    """Games from sheets whose consecutive rows (visitor, home) or (neutral, neutral) form a pair,
    resyncing past malformed rows. rows: `sheet` id, season ('2015-16'), row (0, 1, .. within the sheet),
    vh, mmdd, team, final, open, close.

    A row meets its successor by an equi-join on (sheet, row + 1). A V-H pair cannot overlap
    another; inside a run of N rows every second row starts a pair, and the run's start comes from a
    chunked running maximum, so a sheet of any length is split over tasks."""
    r = rows.withColumn("_break", F.when(F.col("vh") != "N", F.col("row")))
    r = running_max(r, [sheet], F.floor(F.col("row") / chunk_rows), ["row"], "_break", "_last")
    r = r.withColumn("_pos", F.col("row") - F.coalesce("_last", F.lit(-1)) - 1)
    nxt = rows.select(sheet, (F.col("row") - 1).alias("row"), F.col("vh").alias("vh_b"), *[F.col(c).alias(f"{c}_b") for c in ("team", "final", "open", "close")])
    p = r.join(nxt, [sheet, "row"])
    vis = (F.col("vh") == "V") & (F.col("vh_b") == "H")
    neu = (F.col("vh") == "N") & (F.col("vh_b") == "N") & (F.col("_pos") % 2 == 0)
    p = p.where(vis | neu)
    month, day = F.floor(F.col("mmdd") / 100).cast("int"), (F.col("mmdd") % 100).cast("int")
    year = F.substring("season", 1, 4).cast("int") + F.when(month >= 7, 0).otherwise(1)
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))
    t_open, s_open = split_total(F.col("open"), F.col("open_b"), 90)
    t_close, s_close = split_total(F.col("close"), F.col("close_b"), 90)
    out = p.select("season", date.alias("date"), (F.col("vh") == "N").alias("neutral"), F.trim("team").alias("away"), F.trim("team_b").alias("home"),
                   coerce_number(F.col("final")).alias("away_pts"), coerce_number(F.col("final_b")).alias("home_pts"), t_open.alias("line_open"),
                   t_close.alias("line_close"), s_open.alias("home_spread_open"), s_close.alias("home_spread_close"))
    return out.where(F.col("date").isNotNull())
