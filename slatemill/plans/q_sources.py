"""Queries that exercise the parsers on tables derived from the driver data."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.plans.registry import query, reals
from slatemill.plans.standins import book_quotes, games, table, with_
from slatemill.sources import ledger, odds_json, season_files


# Quotes folded into books_json text per game and read back
@query("books_json", with_("book_quotes", f"SELECT game_key, CAST(book AS VARCHAR) AS book, open_over, open_under, {reals(open='open', close='close')} FROM book_quotes"))
def books_json(spark, sf):
    one = F.struct(F.col("book").cast("string").alias("key"), F.struct("open", F.col("open_over").cast("int").alias("open_over"), F.col("open_under").cast("int").alias("open_under"), "close",
                                                                       F.lit(None).cast("int").alias("close_over"), F.lit(None).cast("int").alias("close_under")).alias("value"))
    text = book_quotes(spark, sf).groupBy("game_key").agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("books_json"))
    m = text.select("game_key", F.explode(odds_json.books_from_json(F.col("books_json"))).alias("book", "b"))
    return m.select("game_key", "book", F.col("b.open_over").alias("open_over"), F.col("b.open_under").alias("open_under"), F.col("b.open").alias("open"), F.col("b.close").alias("close"))


# Every game written as two sheet rows, some neutral, some malformed
@query("paired_rows", with_("games", f"""SELECT game_key % 7 = 0 AS neutral, count(*) AS n, {reals(line_open='avg(line_open)', line_close='avg(CASE WHEN ok_close THEN line_close END)', spread='avg(home_spread_close)', pts='avg(home_pts)')}
  FROM games WHERE abs(home_spread_close) < 90 AND game_key % 31 <> 0 GROUP BY 1"""))
def paired_rows(spark, sf):
    g, k = games(spark, sf), F.col("game_key")
    num = lambda c: F.format_string("%.1f", F.col(c).cast("double"))
    season = F.when(F.month("date") >= 7, F.year("date")).otherwise(F.year("date") - 1)
    base = g.select(F.concat(season, F.lit("-"), F.lpad(((season + 1) % 100).cast("string"), 2, "0")).alias("season"), k.alias("key"), (F.month("date") * 100 + F.dayofmonth("date")).alias("mmdd"),
                    *[c for c in ("home", "away", "home_pts", "away_pts", "ok_close")], num("line_open").alias("lo"), num("line_close").alias("lc"), num("home_spread_close").alias("sp"))
    neutral, broken = F.col("key") % 7 == 0, F.col("key") % 31 == 0
    row = lambda off, vh, team, pts, o, c: F.struct((F.col("key") * 3 + off).alias("row"), vh.alias("vh"), F.col(team).cast("string").alias("team"),
                                                    F.col(pts).cast("string").alias("final"), o.alias("open"), c.alias("close"))
    visit = F.when(broken, "X").when(neutral, "N").otherwise("V")
    sheet = base.select(F.lit("all").alias("sheet"), "season", "mmdd", F.explode(F.array(
        row(0, visit, "away", "away_pts", F.col("lo"), F.when(F.col("ok_close"), F.col("lc")).otherwise(F.lit("NL"))),
        row(1, F.when(neutral, "N").otherwise("H"), "home", "home_pts", F.lit("pk"), F.col("sp")),
        row(2, F.lit("-"), "home", "home_pts", F.lit(""), F.lit("")))).alias("r")).select("sheet", "season", "mmdd", "r.*")
    p = season_files.parse_paired_rows(sheet, "sheet")
    return p.groupBy("neutral").agg(F.count("*").alias("n"), F.avg("line_open").alias("line_open"), F.avg("line_close").alias("line_close"),
                                    F.avg("home_spread_close").alias("spread"), F.avg("home_pts").alias("pts"))


# The catalogue parser on market names built from parts
@query("market_catalogue", r"""SELECT p_partkey * 2 + s AS outcome_id, CASE WHEN p_partkey % 3 = 0 THEN 'totals' WHEN p_partkey % 3 = 1 THEN 'spreads' ELSE 'other' END AS kind, p_partkey % 5 <> 0 AS full_game, p_partkey % 7 = 0 AS incl_ot,
  CAST(p_size AS DOUBLE) + 0.5 AS line, CASE WHEN s = 0 THEN 'over' ELSE 'under' END AS side FROM part, (VALUES (0), (1)) t(s)""")
def market_catalogue(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "Over Under ").when(k % 3 == 1, "Handicap ").otherwise("Winner "), F.when(k % 5 == 0, "first quarter ").otherwise("game "),
                    F.when(k % 7 == 0, "incl. overtime ").otherwise(""), F.col("p_size"), F.lit(".5"))
    raw = table(spark, sf, "part").select(k.alias("marketId"), name.alias("marketName"), F.lit("").alias("marketType"), F.lit("").alias("period"), F.lit(None).cast("double").alias("handicap"),
                                          F.lit(False).alias("playerProp"), F.array(F.struct((k * 2).alias("outcomeId"), F.lit(" Over").alias("outcomeName")), F.struct((k * 2 + 1).alias("outcomeId"), F.lit("Under ").alias("outcomeName"))).alias("outcomes"))
    return odds_json.parse_catalogue(raw).select("outcome_id", "kind", "full_game", "incl_ot", "line", "side")


# The event log folded into nested history documents and flattened again
@query("odds_history", with_("quotes", "SELECT CAST(fixture_id AS VARCHAR) AS fixture_id, book, line, side, active, count(*) AS n FROM quotes GROUP BY ALL"))
def odds_history(spark, sf):
    from slatemill.plans.standins import quotes

    q = quotes(spark, sf)
    oid = (F.col("line") * 2).cast("int") * 2 + (F.col("side") == "under").cast("int")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    q = q.select(F.col("fixture_id").cast("string").alias("fixtureId"), iso("start").alias("startTime"), "book", oid.alias("oid"), "line", "side",
                 F.struct(iso("t").alias("createdAt"), "price", F.lit(None).cast("double").alias("limit"), "active").alias("s"))
    cells = q.groupBy("fixtureId", "startTime", "book", "oid").agg(F.collect_list("s").alias("snaps"))       # one cell's changes
    outs = cells.groupBy("fixtureId", "startTime", "book").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("oid").cast("string"), F.struct(F.create_map(F.lit("0"), F.col("snaps")).alias("players"))))).alias("outcomes"))
    books = outs.groupBy("fixtureId", "startTime").agg(F.map_from_entries(F.collect_list(F.struct("book", F.struct(F.create_map(F.lit("1"), F.struct("outcomes")).alias("markets"))))).alias("bookmakers"))
    docs = books.select("fixtureId", F.lit(None).cast("bigint").alias("tournamentId"), "startTime", F.lit("a").alias("participant1Name"), F.lit("b").alias("participant2Name"), "bookmakers")
    cat = q.select(F.col("oid").cast("bigint").alias("outcome_id"), "line", "side").distinct().withColumns({"kind": F.lit("totals"), "full_game": F.lit(True), "incl_ot": F.lit(True)})
    return odds_json.parse_history(docs, cat).groupBy("fixture_id", "book", "line", "side", "active").agg(F.count("*").alias("n"))


# S11, O5
@query("ledger_new_rows", with_("bets", "SELECT game_key, side FROM bets WHERE p >= 0.55 AND season > 1999"))
def ledger_new_rows(spark, sf):
    from slatemill.plans.standins import bets

    b = bets(spark, sf).where(F.col("p") >= 0.55).select("game_key", "season", "side")
    return ledger.new_rows(b, b.where("season <= 1999"), ["game_key", "side"]).select("game_key", "side")


# D19
@query("stale_seasons", with_("games", "SELECT season, count(*) AS n FROM games WHERE season >= (SELECT min(season) FROM games WHERE season = 1998 AND game_key % 97 = 0) GROUP BY 1"))
def stale_seasons(spark, sf):
    """A change in one season marks it and every later one."""
    from slatemill.operators.metrics import fingerprint

    g, cols = games(spark, sf), ["game_key", "date", "home", "away", "total"]
    old = fingerprint(g.withColumn("total", F.when((F.col("season") == 1998) & (F.col("game_key") % 97 == 0), F.col("total") + 1).otherwise(F.col("total"))), ["season"], cols)
    return ledger.stale_seasons(g, old, cols).select("season", "n")


def _new_path(spark) -> str:
    import uuid

    from slatemill.session import shared_folder

    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables/{uuid.uuid4().hex}"


# Every game written as headered CSV with some blank lines, and read back
@query("csv_slate", with_("games", f"SELECT game_key, strftime(date, '%Y-%m-%d') AS date, 'g' || home AS home, {reals(line='CASE WHEN game_key % 5 = 0 THEN 140.0 ELSE line_open END')}, 'main' AS league FROM games"))
def csv_slate(spark, sf):
    from pyspark.sql import types as T

    from slatemill.sources import tables

    path, k = _new_path(spark), F.col("game_key")
    out = games(spark, sf).select(k.alias("Game_Key"), F.col("date").alias("Date"), F.concat(F.lit("g"), "home").alias("Home"), F.when(k % 5 != 0, F.col("line_open")).alias("Line"))
    out.write.csv(path, header=True)
    schema = T.StructType([T.StructField(n, t) for n, t in (("Game_Key", T.LongType()), ("Date", T.DateType()), ("Home", T.StringType()), ("Line", T.DoubleType()))])
    return tables.scan_csv(spark, path, schema, {"line": 140.0, "league": "main"})


# Season partitions written and scanned again, with a repeated and a missing column
@query("season_scan", with_("games", "SELECT game_key, season, total, CAST(NULL AS DOUBLE) AS not_there FROM games"))
def season_scan(spark, sf):
    from slatemill.sources import tables

    path = _new_path(spark)
    tables.write_table(games(spark, sf).select("game_key", "season", "total"), path, ["season"])
    tables.write_table(games(spark, sf).where("game_key % 2 = 0").select("game_key", "season", "total"), path, ["season"], mode="append")
    return tables.scan(spark, [path], {"game_key": "bigint", "season": "bigint", "total": "bigint", "not_there": "double"}, ["game_key"])


# Two runs appended, the second of them twice
@query("ledger_append", with_("bets", f"SELECT game_key, CASE WHEN season <= 1996 THEN 'first' ELSE 'second' END AS run, {reals(price='price')} FROM bets WHERE p >= 0.55"))
def ledger_append(spark, sf):
    from slatemill.plans.standins import bets

    path, b = _new_path(spark), bets(spark, sf).where(F.col("p") >= 0.55).select("game_key", "season", "price")
    ledger.append_ledger(spark, b.where("season <= 1996").drop("season"), path, ["game_key"], "first")
    for _ in range(2):
        ledger.append_ledger(spark, b.drop("season"), path, ["game_key"], "second")
    return spark.read.parquet(path).select("game_key", "run", "price")
