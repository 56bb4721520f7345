"""Operators that key on teams, games, fixtures and seasons take them as numbers or as texts, with the same results."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slatemill.operators import calibrate, history, market, ratings, resolve

rnd = random.Random(11)
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
GAMES = [(1, 2019 + (i > 90), DAYS[i // 4], 1 + i % 5, 6 + (i * 7) % 5, i % 9 == 0, 60.0 + rnd.randrange(40), 60.0 + rnd.randrange(40), 70.0 + i % 7, 140.5) for i in range(160)]


def as_text(df, *columns):
    return df.withColumns({c: F.format_string("k%05d", F.col(c).cast("long")) for c in columns})


def rows(df, *drop):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.drop(*drop).collect()), key=str)


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(GAMES, "league long, season long, date date, home long, away long, neutral boolean, home_pts double, away_pts double, poss double, line double")


def test_ratings_and_states(games):
    keys = ["league", "home", "away", "season"]
    text = as_text(games, *keys)
    assert rows(as_text(ratings.daily_ratings(games), "league", "home", "away")) == rows(ratings.daily_ratings(text))
    assert rows(as_text(ratings.team_states(games), "league", "team", "season")) == rows(ratings.team_states(text))


def test_fixture_matching(spark):
    names = [("Alba Nord", "Rio Sud"), ("Monte Est", "Lago West"), ("Alba Nord", "Lago West")]
    left = spark.createDataFrame([(i, DAYS[i], *n) for i, n in enumerate(names)], "fixture_id long, date date, home_name string, away_name string")
    right = spark.createDataFrame([(10 * i + j, DAYS[i], *n) for i, n in enumerate(names) for j in (1, 2)], "game_key long, date date, home_name string, away_name string")
    num = resolve.match_fixtures(left, right)
    assert rows(as_text(num, "fixture_id", "game_key")) == rows(resolve.match_fixtures(as_text(left, "fixture_id"), as_text(right, "game_key")))
    assert [r.game_key for r in num.orderBy("fixture_id").collect()] == [1, 11, 21]          # of equal scores the smaller key


def test_pair_search_and_calibrators(spark):
    legs = spark.createDataFrame([(d, i, 1.5 + (i * 7 + d) % 10 / 10, 1.0 + (i * 3 + d) % 7 / 20) for d in range(3) for i in range(12)], "date long, fixture_id long, price double, v double")
    assert rows(as_text(market.best_pair(legs, ["date"]), "leg_a", "leg_b")) == rows(market.best_pair(as_text(legs, "fixture_id"), ["date"]))
    preds = spark.createDataFrame([(2010 + i % 4, DAYS[i % 40], 140.5, 140 + rnd.gauss(0, 12), rnd.gauss(0, 2), 12.0, True, 0.4 + (i % 21) / 100, float(rnd.random() < 0.5)) for i in range(800)],
                                  "season long, date date, line double, outcome double, mu double, sd double, eligible boolean, p double, y double")
    text = as_text(preds, "season")
    assert rows(as_text(calibrate.fit_latent(preds), "season"), "beta", "v") == rows(calibrate.fit_latent(text), "beta", "v")
    assert rows(as_text(calibrate.platt_by_season(preds, "p", "y"), "season")) == rows(calibrate.platt_by_season(text, "p", "y"))


def test_roster_continuity_follows_seasons_in_order(spark):
    m = [(f"20{y}-{y + 1}", t, p, DAYS[d], 20.0 + p) for y in (15, 16, 17) for t in ("A", "B") for d in (0, 1, 2) for p in range(6) if (p + y) % 4]
    text = spark.createDataFrame(m, "season string, team string, player long, date date, minutes double")
    num = text.withColumn("season", F.substring("season", 1, 4).cast("long"))
    season = F.concat(F.col("season"), F.lit("-"), (F.col("season") - 1999).cast("string"))
    assert rows(history.roster_continuity(num).withColumn("season", season)) == rows(history.roster_continuity(text))


def test_a_moved_start_counts_as_last_stated(spark):
    from slatemill.operators import asof

    t0 = dt.datetime(2024, 1, 1)
    q = spark.createDataFrame([(1, "b", 1.5, "over", t0 + dt.timedelta(hours=h), h, 0.0 if h == 4 else 1.9, True, t0 + dt.timedelta(hours=s)) for h, s in ((1, 10), (2, 20), (3, 15), (4, 15))],
                              "fixture_id long, book string, line double, side string, t timestamp, seq long, price double, active boolean, start timestamp")
    assert asof.decision_at(q, 5).first()["when"] == t0 + dt.timedelta(hours=10)
    ladder = asof.open_close_ladder(q).first()
    assert ladder.close_t == t0 + dt.timedelta(hours=3) and ladder.close_price == 1.9
