"""Studies on a hand-made log: voids, pushes, missing closes, ties, and books that post one side at a time."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slatemill.operators import asof, studies

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rows, seq = [], 0

    def post(fixture, book, line, side, hour, price, active=True):
        nonlocal seq
        seq += 1
        rows.append((fixture, T0 + timedelta(hours=24), book, line, side, T0 + timedelta(hours=hour), seq, active, price))

    for f in (1, 2, 3):
        post(f, "sharp", 150.5, "over", 1, 2.0)
        post(f, "soft", 150.5, "over", 2, 2.2)
        post(f, "sharp", 150.5, "under", 3, 2.0)
        post(f, "soft", 152.0, "under", 3.5, 9.0)      # the sharp book has no such line
        post(f, "soft", 150.5, "under", 4, 2.2)
        post(f, "soft", 151.5, "over", 5, 1.9)
        post(f, "soft", 151.5, "under", 6, 1.9)
    post(1, "sharp", 150.5, "over", 20, 1.6)
    post(1, "sharp", 150.5, "under", 20, 2.4)
    for side in ("over", "under"):
        post(2, "sharp", 150.5, side, 10, 2.0, active=False)
    return spark.createDataFrame(rows, "fixture_id long, start timestamp, book string, line double, side string, t timestamp, seq long, active boolean, price double")


@pytest.fixture(scope="module")
def finals(spark):
    return spark.createDataFrame([(1, 160), (2, 140)], "fixture_id long, final long")


def test_value_bets(spark, log, finals):
    board = asof.board_at(log, asof.decision_at(log, 15))                 # at hour 9
    prices = studies.on_sharp_lines(board, ["soft"], "sharp", ["fixture_id"])
    assert {(r.fixture_id, r.line, r.side) for r in prices.collect()} == {(f, 150.5, s) for f in (1, 2, 3) for s in ("over", "under")}
    got = {r.fixture_id: r for r in studies.graded_value(studies.best_value(prices, ["fixture_id"]), asof.close_board(log), finals, "sharp").collect()}
    assert all(r.side == "under" and r.price == 2.2 and abs(r.ev - 0.1) < 1e-12 for r in got.values())      # a tie goes to the under
    close = (1 / 2.4) / (1 / 1.6 + 1 / 2.4)
    assert (got[1].sign, got[1].pnl) == (-1, -1.0) and abs(got[1].clv - (close * 2.2 - 1)) < 1e-12
    assert (got[2].sign, got[3].sign, got[3].pnl) == (1, None, None) and abs(got[2].pnl - 1.2) < 1e-12
    assert studies.best_value(prices, ["fixture_id"], 0.2).count() == 0
    graded = studies.graded_value(studies.best_value(prices, ["fixture_id"]), asof.close_board(log), finals, "sharp").withColumn("h", F.lit(15))
    table = studies.value_summary(graded, "h", F.lit("w")).collect()
    assert len(table) == 3 and all((r.all_bets, r.bets, r.pushes, r.won) == (3, 2, 0, 0.5) and abs(r.roi - 0.1) < 1e-12 for r in table)
    per = studies.pricing_by_book(prices, []).collect()
    assert [(r.book, r.prices, r.above_fair, r.well_above) for r in per] == [("soft", 6, 1.0, 1.0)]


def test_gaps_start_when_both_books_have_both_sides(log, finals):
    when = {r.fixture_id: r.when for r in studies.both_posted(log, ["soft"], "sharp").collect()}
    assert when == {f: T0 + timedelta(hours=4, milliseconds=1) for f in (1, 2, 3)}
    gaps = {r.fixture_id: r for r in studies.opening_gaps(log, finals, ["soft"], "sharp").collect()}
    assert 3 not in gaps and gaps[1].line == 150.5 and abs(gaps[1].gap) < 1e-9


def test_closing_value_needs_a_later_price(spark, log, finals):
    at = lambda h: T0 + timedelta(hours=h)
    picks = spark.createDataFrame([(1, 150.5, "over", 2.2, at(5)), (1, 160.0, "over", 2.2, at(21)), (3, 150.5, "over", 2.2, at(2.5)), (9, 150.5, "over", 2.2, at(5))],
                                  "fixture_id long, line double, side string, price double, t timestamp")
    got = {(r.fixture_id, r.line): r for r in studies.closing_value(picks, log, finals, "sharp").collect()}
    p = (1 / 1.6) / (1 / 1.6 + 1 / 2.4)
    assert got[1, 150.5].result == "won" and abs(got[1, 150.5].close_p - p) < 1e-7 and abs(got[1, 150.5].clv - (p * 2.2 - 1)) < 1e-6
    assert (got[1, 160.0].result, got[1, 160.0].pnl, got[1, 160.0].close_p) == ("push", 0.0, None)       # recorded after the last move
    assert (got[3, 150.5].result, got[3, 150.5].pnl) == ("pending", None) and abs(got[3, 150.5].close_p - 0.5) < 1e-7
    assert (got[9, 150.5].result, got[9, 150.5].clv) == ("pending", None)


def test_empty_log(log, finals):
    none = log.limit(0)
    assert studies.opening_gaps(none, finals, ["soft"], "sharp").count() == 0
    assert studies.gap_table(studies.opening_gaps(none, finals, ["soft"], "sharp"), [0]).count() == 0
