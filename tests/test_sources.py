"""Feed parsers, sheets, ledgers and the snapshot stream on small files."""
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatemill.sources import ledger, odds_json, season_files, tables
from slatemill.streaming import snapshots


def test_history_drops_in_play_rows_and_unwanted_markets(spark, tmp_path):
    cat = [{"marketId": 1, "marketName": "Over Under 160.5", "outcomes": [{"outcomeId": 10, "outcomeName": "Over"}, {"outcomeId": 11, "outcomeName": "Under"}]},
           {"marketId": 2, "marketName": "1st half total 80.5", "outcomes": [{"outcomeId": 20, "outcomeName": "Over"}]}]
    hist = {"fixtureId": "f1", "startTime": "2024-01-10T18:00:00Z", "participant1Name": "A", "participant2Name": "B", "bookmakers": {"sharp": {"markets": {
        "1": {"outcomes": {"10": {"players": {"0": [{"createdAt": "2024-01-10T19:00:00Z", "price": 3.0}, {"createdAt": "2024-01-10T12:00:00Z", "price": 1.9}, {"createdAt": "2024-01-09T12:00:00Z", "price": 1.8, "active": False}]}}}},
        "2": {"outcomes": {"20": {"players": {"0": [{"createdAt": "2024-01-10T12:00:00Z", "price": 1.7}]}}}}}}}}
    (tmp_path / "cat.json").write_text(json.dumps(cat))
    (tmp_path / "h.json").write_text(json.dumps(hist))
    c = odds_json.parse_catalogue(spark.read.schema(odds_json.CATALOGUE).option("multiLine", True).json(str(tmp_path / "cat.json")))
    rows = {r["outcome_id"]: r for r in c.collect()}
    assert rows[10]["line"] == 160.5 and rows[10]["full_game"] and not rows[20]["full_game"] and rows[10]["side"] == "over"
    q = odds_json.parse_history(odds_json.read_history(spark, str(tmp_path / "h.json")), c).collect()
    assert sorted((r["price"], r["active"]) for r in q) == [(1.8, False), (1.9, True)]


def test_game_rows_medians(spark, tmp_path):
    view = lambda b, o: {"sportsbook": b, "openingLine": {"total": o, "overOdds": -110, "underOdds": -110}, "currentLine": {"total": o + 1, "overOdds": -105, "underOdds": -115}}
    doc = {"gameRows": [{"gameView": {"gameId": 5, "startDate": "2024-01-10T02:00:00Z", "homeTeam": {"displayName": "H"}, "awayTeam": {"displayName": "A"}, "homeTeamScore": 80, "awayTeamScore": 70},
                         "oddsViews": [view("x", 150.5), view("y", 151.5), view("z", 160.0), None]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    r = odds_json.parse_game_rows(odds_json.read_game_rows(spark, str(tmp_path / "g.json"))).first()
    assert r["line_open"] == 151.5 and r["line_close"] == 152.5 and str(r["date"]) == "2024-01-09" and r["season"] == "2023-24" and len(r["books"]) == 3


def snapshot(path, stamp, price):
    doc = [{"id": "e1", "commence_time": "2024-01-10T18:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "b", "markets": [
        {"key": "totals", "outcomes": [{"name": "Over", "point": 150.5, "price": price}]}, {"key": "h2h", "outcomes": [{"name": "H", "price": 1.5}]}]}]}]
    (path / f"snap_{stamp}.json").write_text(json.dumps(doc))


def test_snapshots_batch_and_stream_agree(spark, tmp_path):
    snapshot(tmp_path, "20240109T100000", 1.8)
    snapshot(tmp_path, "20240110T100000", 1.9)
    q = odds_json.read_snapshots(spark, str(tmp_path))
    assert q.count() == 2 and odds_json.latest_snapshot(q).first()["price"] == 1.9
    s = snapshots.latest_quotes(snapshots.stream_snapshots(spark, str(tmp_path)))
    run = s.writeStream.outputMode("complete").format("memory").queryName("latest").start()
    run.processAllAvailable()
    run.stop()
    assert [r["price"] for r in spark.table("latest").collect()] == [1.9]


def test_season_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text("""<results><game><gamecode>E1</gamecode><date>Oct 5, 2023</date><round>RS</round><hometeam>AAA</hometeam><awayteam>BBB</awayteam>
      <homescore>80</homescore><awayscore>70</awayscore><played>true</played><referees>ONE, A, TWO, B, SIX, C</referees></game>
      <game><gamecode>E2</gamecode><date>Oct 6, 2023</date><round>RS</round><hometeam>AAA</hometeam><awayteam>CCC</awayteam><played>false</played></game></results>""")
    box = spark.createDataFrame([("E1", t, 20, 40, 8, 20, 16, 20, 10, 25, 12, 20) for t in ("AAA", "BBB")], season_files.BOX)
    g, b = season_files.parse_season(season_files.read_results(spark, str(tmp_path / "r.xml")), box)
    r = g.collect()
    assert len(r) == 1 and r[0]["total"] == 150 and r[0]["refs"] == ["ONE, A", "TWO, B", "SIX, C"] and str(r[0]["date"]) == "2023-10-05"
    assert {(x["side"], x["team"], x["fgm"], x["fga"]) for x in b.collect()} == {("home", "AAA", 28, 60), ("away", "BBB", 28, 60)}


def test_paired_rows_resync(spark):
    vh = ["V", "H", "H", "N", "N", "N", "V", "H", "V"]
    rows = [("2015-16", i, v, 1231 if i < 5 else 105, f" t{i} ", str(70 + i), "150.5" if i % 2 == 0 else "pk", "3.5" if i % 2 == 0 else "151") for i, v in enumerate(vh)]
    d = spark.createDataFrame(rows, "season string, row bigint, vh string, mmdd int, team string, final string, open string, close string")
    g = {(r["away"], r["home"]): r for r in season_files.parse_paired_rows(d).collect()}
    assert set(g) == {("t0", "t1"), ("t3", "t4"), ("t6", "t7")}
    assert str(g[("t0", "t1")]["date"]) == "2015-12-31" and str(g[("t6", "t7")]["date"]) == "2016-01-05"
    assert g[("t0", "t1")]["line_open"] == 150.5 and g[("t0", "t1")]["home_spread_open"] == 0 and g[("t0", "t1")]["line_close"] == 151 and g[("t0", "t1")]["home_spread_close"] == -3.5
    assert g[("t3", "t4")]["neutral"]


def test_scan_adds_absent_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "y1"))
    spark.createDataFrame([(2, "b", 5.0), (1, "a", 4.0)], "id int, x string, z double").write.parquet(str(tmp_path / "y2"))
    d = tables.scan(spark, [str(tmp_path / "y1"), str(tmp_path / "y2")], {"id": "bigint", "z": "double", "w": "string"}, ["id"])
    assert d.count() == 2 and d.schema["w"].dataType == T.StringType()


def test_csv_defaults(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Home,Line\n2024-01-01,H,150.5\n2024-01-02,G,\n")
    d = tables.scan_csv(spark, str(tmp_path / "s.csv"), T.StructType([T.StructField("Date", T.DateType()), T.StructField("Home", T.StringType()), T.StructField("Line", T.DoubleType())]), {"line": 140.0, "league": "x"})
    assert [r["line"] for r in d.orderBy("date").collect()] == [150.5, 140.0] and d.first()["league"] == "x"


def test_sources_may_not_overlap(spark):
    a = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-03-01")], "k int, d string")
    with pytest.raises(ValueError):
        tables.union_sources({"a": a, "b": a}, "d")


def test_ledger_appends_only_new_keys(spark, tmp_path):
    p = str(tmp_path / "ledger")
    d = lambda *ks: spark.createDataFrame([(k, 1.9) for k in ks], "pick int, price double")
    ledger.append_ledger(spark, d(1, 2, 2), p, ["pick"], "a")
    ledger.append_ledger(spark, d(2, 3), p, ["pick"], "b")
    ledger.append_ledger(spark, d(2, 3), p, ["pick"], "b")
    assert sorted(r["pick"] for r in spark.read.parquet(p).collect()) == [1, 2, 3]


def test_refresh_rewrites_only_stale_seasons(spark, tmp_path):
    from slatemill.operators.metrics import fingerprint

    p = str(tmp_path / "f")
    g = spark.createDataFrame([(s, i, i) for s in (1, 2, 3) for i in range(4)], "season int, game_key int, total int")
    build = lambda d: d.withColumn("f", F.col("total") * 2)
    tables.write_table(build(g), p, ["season"])
    stored = fingerprint(g, ["season"], ["game_key", "total"])
    g2 = g.withColumn("total", F.when((F.col("season") == 2) & (F.col("game_key") == 1), 50).otherwise(F.col("total")))
    stale = ledger.stale_seasons(g2, stored, ["game_key", "total"])
    assert sorted(r["season"] for r in stale.collect()) == [2, 3]
    ledger.refresh_features(g2, build, p, stale, lead_in=1)
    out = spark.read.parquet(p)
    assert out.count() == 12 and out.where("season = 2 and game_key = 1").first()["f"] == 100


def test_newest_poll_reads_its_own_file_alone(spark, tmp_path):
    for day in range(1, 6):
        snapshot(tmp_path, f"2024010{day}T100000", 1.5 + day / 10)
    (tmp_path / "notes.json").write_text("not a poll")
    latest = odds_json.read_latest_snapshot(spark, str(tmp_path))
    assert len(latest.inputFiles()) == 1 and "20240105T100000" in latest.inputFiles()[0]
    assert [r["price"] for r in latest.collect()] == [2.0]
    (tmp_path / "none").mkdir()
    assert odds_json.read_latest_snapshot(spark, str(tmp_path / "none")).count() == 0


def test_jdbc_tables_are_read_in_spans(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/games"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for season, n in (("2020", 100), ("2021", 37), ("2022", 0)):
        d = spark.range(n).selectExpr("id * 3 AS GAME_KEY", "id % 7 AS TOTAL")
        d.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS GAME_KEY, CAST(99 AS BIGINT) AS TOTAL").limit(int(n > 50))).write.jdbc(url + ";create=true", f"G{season}", properties=driver)
    names = {s: f"G{s}" for s in ("2020", "2021", "2022")}
    got = tables.scan_jdbc(spark, url, names, key="GAME_KEY", parts=4, **driver)
    whole = tables.scan_jdbc(spark, url, names, **driver)
    rows = lambda d: sorted((r["season"], r["GAME_KEY"] if r["GAME_KEY"] is not None else -1, r["TOTAL"]) for r in d.collect())
    assert rows(got) == rows(whole) and len(rows(got)) == 138
    assert got.rdd.getNumPartitions() == 9 and whole.rdd.getNumPartitions() == 3


def test_boards_as_stream_state(spark, tmp_path):
    """The streamed board equals the batch board a minute before the start; when all starts have passed, no state is left."""
    from slatemill.operators import asof
    from slatemill.plans.standins import quotes
    from slatemill.streaming.snapshots import stream_boards

    q = quotes(spark, "/root/testdata/sf0.001").select("fixture_id", "start", "book", "line", "side", "t", "seq", "price", "active").where("fixture_id % 4 = 0")
    third = [r.t for r in q.selectExpr("percentile_approx(t, array(0.33, 0.66)) AS x").selectExpr("explode(x) AS t").collect()]
    for i, (lo, hi) in enumerate(zip([None, *third], [*third, None])):
        part = q.where((F.lit(lo is None) | (F.col("t") > F.lit(lo))) & (F.lit(hi is None) | (F.col("t") <= F.lit(hi))))
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    last = spark.sql("SELECT -1L AS fixture_id, timestamp'2031-01-01' AS start, 'end' AS book, 0.0D AS line, 'over' AS side, timestamp'2030-01-01' AS t, 0L AS seq, 2.0D AS price, true AS active")
    last.coalesce(1).write.parquet(str(tmp_path / "in/9"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = stream_boards(spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")))
        run = s.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).format("memory").queryName("boards").trigger(availableNow=True).start()
        run.awaitTermination(240)
        left = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    when = q.select("fixture_id", (F.col("start") - F.expr("INTERVAL 1 MINUTE")).alias("when")).distinct()
    want = sorted((r.fixture_id, r.book, r.line, r.side, r.t, r.price) for r in asof.board_at(q, when).collect())
    got = sorted((r.fixture_id, r.book, r.line, r.side, r.t, r.price) for r in spark.table("boards").collect())
    assert got == want and len(want) > 10
    assert left[-1] <= 1        # the end marker's own cell
