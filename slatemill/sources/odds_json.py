"""Bookmaker feeds: nested JSON to flat quote tables."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatemill.functions.dates import local_date, season_label

# Words of a market name or period that mean it covers part of a game.
PARTIAL_WORDS = ["half", "quarter", "period", "1st", "2nd", "3rd", "4th", "team", "player", "race", "odd", "even"]
FULL_PERIODS = ["", "result", "fulltime"]

BOOK = "struct<open double, open_over int, open_under int, close double, close_over int, close_under int>"
VIEW = ("struct<sportsbook string, openingLine struct<total double, overOdds int, underOdds int>, "
        "currentLine struct<total double, overOdds int, underOdds int>>")
GAME_ROWS = (f"gameRows array<struct<gameView struct<gameId bigint, startDate string, homeTeam struct<displayName string>, awayTeam struct<displayName string>, "
             f"homeTeamScore int, awayTeamScore int, gameStatusText string>, oddsViews array<{VIEW}>>>")
SNAPSHOT = "created string, price double, `limit` double, active boolean"
HISTORY = ("fixtureId string, tournamentId bigint, startTime string, participant1Name string, participant2Name string, "
           "bookmakers map<string, struct<markets map<string, struct<outcomes map<string, struct<players map<string, "
           "array<struct<createdAt string, price double, `limit` double, active boolean>>>>>>>>>")
CATALOGUE = ("marketId bigint, marketName string, marketType string, period string, handicap double, playerProp boolean, "
             "outcomes array<struct<outcomeId bigint, outcomeName string>>")
EVENTS = ("id string, commence_time timestamp, home_team string, away_team string, bookmakers array<struct<key string, last_update timestamp, "
          "markets array<struct<key string, outcomes array<struct<name string, point double, price double>>>>>>")


# ------------------------------------------------------------------ game rows with book views
def read_game_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GAME_ROWS).option("multiLine", True).json(path)


def parse_game_rows(raw: DataFrame, zone: str = "America/New_York", season_month: int = 7) -> DataFrame:
    """One row per game: names, scores, local date, season, a map of books and the median lines.
    Views are condensed inside the row (a game has at most a few dozen books), so nothing shuffles."""
    g = raw.select(F.explode("gameRows").alias("r")).select("r.gameView.*", F.col("r.oddsViews").alias("views"))
    ok = F.filter("views", lambda v: v["sportsbook"].isNotNull())
    line = lambda l: (l["total"], l["overOdds"], l["underOdds"])

    def entry(v: Column) -> Column:
        o, c = line(v["openingLine"]), line(v["currentLine"])
        return F.struct(v["sportsbook"].alias("key"), F.struct(
            o[0].alias("open"), o[1].alias("open_over"), o[2].alias("open_under"), c[0].alias("close"), c[1].alias("close_over"), c[2].alias("close_under")).alias("value"))

    start = F.to_timestamp("startDate")
    d = g.select(
        F.col("gameId").alias("game_key"), start.alias("start"), local_date(start, zone).alias("date"), F.col("homeTeam.displayName").alias("home_name"),
        F.col("awayTeam.displayName").alias("away_name"), F.col("homeTeamScore").alias("home_pts"), F.col("awayTeamScore").alias("away_pts"),
        F.col("gameStatusText").alias("status"), F.map_from_entries(F.transform(ok, entry)).alias("books"))
    return d.withColumns({"season": season_label(F.col("date"), season_month), "line_open": median_of(opens(F.col("books"), "open")),
                          "line_close": median_of(opens(F.col("books"), "close"))})


def opens(books: Column, field: str) -> Column:
    return F.array_sort(F.filter(F.transform(F.map_values(books), lambda b: b[field]), lambda x: x.isNotNull()))


def median_of(sorted_values: Column) -> Column:
    """Median of a sorted array; null when empty."""
    n = F.size(sorted_values)
    lo, hi = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.element_at(sorted_values, lo) + F.element_at(sorted_values, hi)) / 2)


def books_from_json(text: Column) -> Column:
    """books_json text to a map; malformed text is null."""
    return F.from_json(text, f"map<string,{BOOK}>")


# ------------------------------------------------------------------ market catalogue
def parse_catalogue(raw: DataFrame) -> DataFrame:
    """outcome id -> market kind, whole game or part, overtime included, line and side. The line is
    the explicit field, else the last number in the name."""
    name, kind, period = (F.lower(F.coalesce(c, F.lit(""))) for c in ("marketName", "marketType", "period"))
    numbers = F.regexp_extract_all(name, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    line = F.coalesce("handicap", F.when(F.size(numbers) > 0, F.element_at(numbers, -1)).try_cast("double"))
    named = (F.when((name.contains("over") & name.contains("under")) | name.contains("total"), "totals")
             .when(name.contains("handicap") | name.contains("spread"), "spreads").otherwise("other"))
    what = F.when(kind == "", named).when(kind == "totals", "totals").when(kind.startswith("spreads"), "spreads").otherwise(kind)
    part = F.exists(F.array(*[F.lit(w) for w in PARTIAL_WORDS]), lambda w: name.contains(w)) | ~period.isin(*FULL_PERIODS)
    d = raw.select("marketId", what.alias("kind"), (~part & ~F.coalesce("playerProp", F.lit(False))).alias("full_game"),
                   ((period == "result") | name.contains("overtime")).alias("incl_ot"), line.alias("line"), F.explode("outcomes").alias("o"))
    return d.select(F.col("o.outcomeId").alias("outcome_id"), F.col("marketId").alias("market_id"), "kind", "full_game", "incl_ot", "line",
                    F.lower(F.trim("o.outcomeName")).alias("side"))


# ------------------------------------------------------------------ odds history
def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("multiLine", True).json(path)


def parse_history(raw: DataFrame, catalogue: DataFrame, kind: str = "totals", player: str | None = "0", cutoff_minutes: float = 0.0) -> DataFrame:
    """Nested book -> market -> outcome -> player -> snapshot maps to one row per price change before
    the start. Unwanted outcomes go by a semi join before the snapshots are unfolded, and snapshots
    at or after the cutoff are dropped inside their array, so in-play rows are never materialised."""
    want = catalogue.where((F.col("kind") == kind) & F.col("full_game") & F.col("side").isin("over", "under")).dropDuplicates(["outcome_id"])
    start = F.to_timestamp("startTime")
    d = raw.select(F.col("fixtureId").alias("fixture_id"), F.col("tournamentId").alias("tid"), start.alias("start"), F.col("participant1Name").alias("home_name"),
                   F.col("participant2Name").alias("away_name"), F.explode("bookmakers").alias("book", "b"))
    base = ["fixture_id", "tid", "start", "home_name", "away_name", "book"]
    d = d.select(*base, F.explode("b.markets").alias("mid", "m")).select(*base, F.explode("m.outcomes").alias("oid", "o"))
    d = d.withColumn("outcome_id", F.col("oid").cast("bigint")).join(want.select("outcome_id", "incl_ot", "line", "side"), "outcome_id")
    d = d.select(*base, "incl_ot", "line", "side", F.explode("o.players").alias("player_id", "s"))
    if player is not None:
        d = d.where(F.col("player_id") == player)
    before = F.filter("s", lambda x: F.to_timestamp(x["createdAt"]) < F.col("start") - F.make_dt_interval(secs=F.lit(cutoff_minutes * 60.0)))
    d = d.select(*base, "incl_ot", "line", "side", "player_id", F.explode(before).alias("x"))
    t = F.to_timestamp("x.createdAt")
    return d.select(*base, "incl_ot", "line", "side", "player_id", t.alias("t"), F.unix_micros(t).alias("seq"), F.col("x.price").alias("price"),
                    F.coalesce("x.active", F.lit(True)).alias("active"), F.col("x.limit").alias("limit"))


# ------------------------------------------------------------------ polled snapshots
def parse_snapshots(raw: DataFrame, file_name: Column) -> DataFrame:
    """Totals quotes of polled snapshot files; the poll time is in the file name (YYYYMMDDThhmmss)."""
    t = F.to_timestamp(F.regexp_extract(file_name, r"(\d{8}T\d{6})", 1), "yyyyMMdd'T'HHmmss")
    d = raw.select("id", "commence_time", "home_team", "away_team", t.alias("t"), F.explode("bookmakers").alias("b"))
    d = d.select("id", "commence_time", "home_team", "away_team", "t", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).where("m.key = 'totals'")
    d = d.withColumn("o", F.explode("m.outcomes"))
    return d.select(F.col("id").alias("fixture_id"), F.col("commence_time").alias("start"), F.col("home_team").alias("home_name"), F.col("away_team").alias("away_name"),
                    "book", F.col("o.point").alias("line"), F.lower("o.name").alias("side"), "t", F.col("o.price").alias("price"),
                    F.lit(True).alias("active"), F.unix_micros("t").alias("seq"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(EVENTS).option("multiLine", True).json(path)
    return parse_snapshots(raw, F.col("_metadata.file_name"))


def latest_snapshot(quotes: DataFrame) -> DataFrame:
    """Rows of the newest poll."""
    newest = quotes.agg(F.max("t").alias("t"))                                        # one row
    return quotes.join(F.broadcast(newest), "t")


def newest_files(spark: SparkSession, path: str) -> list[str]:
    """The files of the newest poll, told from their names; nothing is opened. More than one where a poll wrote several."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    stamps = [(m[1], f.getPath().toString()) for f in found if (m := re.search(r"(\d{8}T\d{6})", f.getPath().getName()))]
    newest = max((s for s, _ in stamps), default=None)
    return sorted(p for s, p in stamps if s == newest)


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest poll of a folder, read from its files alone; no file, no rows."""
    files = newest_files(spark, path)
    raw = spark.read.schema(EVENTS).option("multiLine", True).json(files) if files else spark.createDataFrame([], EVENTS)
    return parse_snapshots(raw, F.col("_metadata.file_name") if files else F.lit(""))
