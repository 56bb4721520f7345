"""Boards, curves, legs, cards and settlement on small hand-made frames."""
import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slatemill.functions import odds
from slatemill.functions.probability import add_copula_joint, add_norm_cdf, add_norm_ppf
from slatemill.operators import asof, cards, clean, history, market, metrics, staking

T0 = dt.datetime(2024, 1, 10, 18, 0)
Q = "fixture_id bigint, start timestamp, book string, line double, side string, t timestamp, seq bigint, price double, active boolean"


def quote(fid, book, line, side, minutes, price, active=True, seq=None):
    t = T0 - dt.timedelta(minutes=minutes)
    return (fid, T0, book, line, side, t, seq if seq is not None else int(t.timestamp()), price, active)


def test_board_is_last_update_and_pulled_lines_vanish(spark):
    q = spark.createDataFrame([quote(1, "a", 150.5, "over", 300, 1.9), quote(1, "a", 150.5, "over", 120, 1.9, False), quote(1, "b", 150.5, "over", 400, 1.8), quote(1, "b", 150.5, "over", 30, 2.1)], Q)
    at = lambda h: {(r["book"], r["price"]) for r in asof.board_at(q, asof.decision_at(q, h)).collect()}
    assert at(3) == {("a", 1.9), ("b", 1.8)}
    assert at(1) == {("b", 1.8)}
    assert at(0.25) == {("b", 2.1)}


def test_close_keeps_lines_suspended_just_before_the_start(spark):
    q = spark.createDataFrame([quote(1, "a", 150.5, "over", 200, 1.9), quote(1, "a", 150.5, "over", 10, 1.9, False), quote(1, "a", 151.5, "over", 300, 1.8), quote(1, "a", 151.5, "over", 120, 1.8, False), quote(1, "a", 152.5, "over", 5, 2.0)], Q)
    assert {r["line"] for r in asof.close_board(q).collect()} == {150.5, 152.5}


def test_fair_curve_recovers_the_generator(spark):
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    rows = []
    for line in (158.5, 160.5, 162.5, 164.5):
        p = cdf((161.7 - line) / 14)
        rows += [(1, "sharp", line, "over", 0.96 / p), (1, "sharp", line, "under", 0.96 / (1 - p))]
    rows += [(2, "sharp", 150.5, "over", 1.9), (2, "sharp", 150.5, "under", 1.9), (3, "sharp", 151.0, "over", 1.9), (3, "sharp", 151.0, "under", 1.9)]
    b = spark.createDataFrame(rows, "fixture_id bigint, book string, line double, side string, price double")
    c = {r["fixture_id"]: r for r in market.fair_curve(b, "sharp").collect()}
    assert c[1]["fair_mu"] == pytest.approx(161.7, abs=1e-6) and 1 / c[1]["b"] == pytest.approx(14, abs=1e-6)
    assert c[2]["b"] == 1 / 16 and 3 not in c
    assert 3 in {r["fixture_id"] for r in market.fair_curve(b, "sharp", whole_lines=True).collect()}


def test_best_quotes_number_first_then_price_and_outlier_guard(spark):
    q = spark.createDataFrame([(1, 1, 140.5, -110, -110), (1, 2, 139.5, -120, 100), (1, 3, 139.5, -105, 0), (1, 4, 145.5, -110, -110), (1, 5, 141.5, -110, 105)],
                              "game_key bigint, book bigint, open double, open_over int, open_under int")
    r = market.best_quotes(q).first()
    assert (r["over_line"], r["over_book"]) == (139.5, 3) and r["over_price"] == pytest.approx(1 + 100 / 105)
    assert (r["under_line"], r["under_book"]) == (141.5, 5) and r["under_price"] == pytest.approx(2.05)


def legs_frame(seed, dates=6, n=9):
    r = np.random.default_rng(seed)
    rows = [(f"d{d}", d * 100 + i, float(1.3 + r.random()), float(r.normal(0.02, 0.08))) for d in range(dates) for i in range(n)]
    return pd.DataFrame(rows, columns=["date", "fixture_id", "price", "ev_now"]).assign(v=lambda x: 1 + x.ev_now)


def brute_pairs(x):
    p = [(a.v * b.v, min(a.fixture_id, b.fixture_id), max(a.fixture_id, b.fixture_id)) for a, b in itertools.combinations(x.itertuples(), 2) if a.price * b.price >= 2.5]
    return sorted(p, reverse=True)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_best_pair_equals_all_pairs(spark, seed):
    l = legs_frame(seed)
    got = {r["date"]: (r["leg_a"], r["leg_b"]) for r in market.best_pair(spark.createDataFrame(l), ["date"]).collect()}
    for d, x in l.groupby("date"):
        want = brute_pairs(x)
        assert (got.get(d) or None) == ((want[0][1], want[0][2]) if want else None)


def test_disjoint_cards_equal_greedy(spark):
    l = legs_frame(5)
    got = {(r["date"], r["leg_a"], r["leg_b"]) for r in market.disjoint_pairs(spark.createDataFrame(l), ["date"]).collect()}
    want = set()
    for d, x in l.groupby("date"):
        used = set()
        for j, a, b in brute_pairs(x):
            if j > 1 and not {a, b} & used:
                want.add((d, a, b))
                used |= {a, b}
    assert got == want


def test_settlement(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (-1, 1)], "a int, b int")
    got = [r[0] for r in d.select(odds.double_profit(F.col("a"), F.lit(1.6), F.col("b"), F.lit(1.6))).collect()]
    assert got == pytest.approx([1.56, 0.6, 0.0, -1.0])


def test_stakes_and_day_cap(spark):
    one = staking.capped_kelly(spark.createDataFrame([("x", 0.6, 1.909)], "day string, p double, price double"), ["day"], F.col("p"), F.col("price")).first()
    assert one["stake"] == pytest.approx((0.6 * 1.909 - 1) / 0.909 / 8)
    many = staking.capped_kelly(spark.createDataFrame([("x", 0.65, 1.909)] * 40, "day string, p double, price double"), ["day"], F.col("p"), F.col("price"))
    assert many.agg(F.sum("stake")).first()[0] == pytest.approx(0.25)


def test_normal_functions(spark):
    xs = [-8.0, -3.2, -0.5, 0.0, 0.7, 2.5, 7.5]
    d = add_norm_cdf(spark.createDataFrame([(x,) for x in xs], "x double"), "c", F.col("x")).toPandas()
    assert np.allclose(d.c, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-13)
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    q = add_norm_ppf(spark.createDataFrame([(p,) for p in ps], "p double"), "z", F.col("p")).toPandas()
    assert np.allclose([0.5 * math.erfc(-z / math.sqrt(2)) for z in q.z], ps, atol=1e-11)


def test_copula(spark):
    d = spark.createDataFrame([(0.6, 0.7, 0.0), (0.5, 0.5, 0.5), (0.5, 0.5, -0.3), (0.6, 0.7, 0.2)], "a double, b double, r double")
    j = add_copula_joint(d, "j", F.col("a"), F.col("b"), F.col("r")).toPandas().j.tolist()
    assert j[0] == pytest.approx(0.42) and j[1] == pytest.approx(1 / 3) and j[2] == pytest.approx(0.25 + math.asin(-0.3) / (2 * math.pi))
    assert j[3] > 0.42


def test_pair_dependence_equals_pairs(spark):
    r = np.random.default_rng(4)
    d = pd.DataFrame({"s": 1, "date": r.integers(0, 12, 80), "x": r.integers(0, 2, 80).astype(float), "z": r.normal(size=80)})
    got = metrics.pair_dependence(spark.createDataFrame(d), ["s"], "date", "x", "z").first()
    pairs = [(a.x, b.x, a.z, b.z) for _, g in d.groupby("date") for a, b in itertools.permutations(g.itertuples(), 2)]
    p = np.array(pairs)
    assert got["pairs"] == len(p) // 2 and got["over_corr"] == pytest.approx(np.corrcoef(p[:, 0], p[:, 1])[0, 1])
    assert got["z_corr"] == pytest.approx(np.corrcoef(p[:, 2], p[:, 3])[0, 1])


def test_skyline_keeps_the_best_pair(spark):
    r = np.random.default_rng(7)
    d = pd.DataFrame({"date": np.repeat(["a", "b", "c"], 25), "game_key": np.arange(75), "p_cal": r.random(75), "p_cons": r.random(75)})
    keep = cards.pair_skyline(spark.createDataFrame(d), "p_cal", "p_cons").toPandas()
    assert len(keep) < len(d)
    for t in (0.1, 0.3, 0.5):
        for _, g in d.groupby("date"):
            best = lambda x: max((a.p_cal * b.p_cal for a, b in itertools.combinations(x.itertuples(), 2) if a.p_cons * b.p_cons >= t), default=None)
            assert best(g) == best(keep[keep.date == g.date.iloc[0]])


def test_venue_factor(spark):
    day = lambda s, i: dt.date(2000 + s, 11, 1) + dt.timedelta(days=i)
    rows = [(2010, dt.date(2010, 11, 1), "h", False, 160.0, 150.0), (2010, dt.date(2010, 11, 5), "h", False, 155.0, 150.0), (2010, dt.date(2010, 11, 9), "h", True, 190.0, 150.0),
            (2010, dt.date(2010, 11, 20), "h", False, 150.0, 150.0), (2010, dt.date(2010, 11, 1), "other", False, 150.0, 150.0)]
    g = spark.createDataFrame([(*r, True, True) for r in rows], "season int, date date, home string, neutral boolean, total double, line_close double, ok_close boolean, clean boolean")
    v = {(r["home"], r["date"].day): r["venue_factor"] for r in history.venue_factor(g).collect()}
    assert v[("h", 20)] == pytest.approx(15 / 42) and v[("h", 1)] == 0 and v[("other", 1)] == 0
    assert day(0, 0)


def test_quality_flags_ignore_results(spark):
    g = spark.createDataFrame([(i, dt.date(2020, 1, 1), 150.0, 3.0, 150.0, 70, 150) for i in range(3)] + [(9, dt.date(2020, 1, 1), 400.0, 3.0, 150.0, 70, 150)],
                              "game_key int, date date, line_close double, home_spread_close double, line_open double, first_half int, total int")
    f = {r["game_key"]: r["quality_flags"] for r in clean.quality_flags(g, 95, 250, 20).collect()}
    assert f[0] == "placeholder" and f[9] == "line_range;move"


def test_grade_cards_follow_settlement(spark):
    legs = spark.createDataFrame([(1, "a", 150.0, 1, 1.6), (1, "b", 150.0, -1, 1.6), (2, "a", 151.0, 1, 1.6), (2, "c", 150.0, 1, 2.0), (3, "c", 150.0, 1, 2.0), (3, "b", 141.0, 1, 2.0)],
                                 "card int, game string, line double, side int, price double")
    f = spark.createDataFrame([("a", 151.0), ("b", 141.0)], "game string, total double")
    g = {r["card"]: (r["status"], r["profit"]) for r in staking.grade_cards(legs, f, ["game"]).collect()}
    assert g[1][0] == "won" and g[1][1] == pytest.approx(1.56) and g[2] == ("pending", None) and g[3] == ("pending", None)


def test_matching_with_ties_and_equal_prices(spark):
    r = np.random.default_rng(9)
    rows = [(f"d{d}", i, float(r.choice([1.4, 1.5, 1.7, 2.0, 3.0])), float(r.choice([0.9, 1.0, 1.1, 1.25]))) for d in range(4) for i in range(60)]
    l = pd.DataFrame(rows, columns=["date", "fixture_id", "price", "v"])
    got = {(x["date"], x["leg_a"], x["leg_b"]) for x in market.disjoint_pairs(spark.createDataFrame(l), ["date"]).collect()}
    want = set()
    for d, x in l.groupby("date"):
        pairs = sorted((-a.v * b.v, a.fixture_id, b.fixture_id) for a, b in itertools.combinations(x.itertuples(), 2) if a.price * b.price >= 2.5)
        used = set()
        for j, a, b in pairs:
            if j < -1 and not {a, b} & used:
                want.add((d, a, b))
                used |= {a, b}
    assert got == want and len(want) > 20


def test_every_partner_is_asked_a_bounded_number_of_times():
    r = np.random.default_rng(1)
    n, asked = 3000, [0]
    best = market.BestPartners.best

    def counted(self, leg):
        asked[0] += 1
        return best(self, leg)

    market.BestPartners.best = counted
    try:
        pairs = market.greedy_matching(1.3 + r.random(n), 1 + r.random(n), 2.5)
    finally:
        market.BestPartners.best = best
    assert asked[0] < 4 * n and len({x for p in pairs for x in p}) == 2 * len(pairs)


@pytest.mark.parametrize("rho", [0.0, 0.12, -0.2])
def test_qualifying_pairs_equal_a_double_loop(spark, rho):
    from slatemill.functions.probability import joint_normal
    from slatemill.operators.cards import qualifying_pairs

    r = np.random.default_rng(3)
    rows = [(d, float(np.round(x, 3)), rho) for d in range(3) for x in r.uniform(0.3, 1.0, 60)] + [(3, 0.7, rho)] * 5 + [(4, 0.99, rho), (5, 1.0, rho), (5, 0.6, rho)]
    got = {x["date"]: x["n_qualifying"] for x in qualifying_pairs(spark.createDataFrame(rows, "date int, p double, rho_lo double"), "p", F.col("rho_lo"), 0.42).collect()}
    for d in range(6):
        p = np.clip([x[1] for x in rows if x[0] == d], 1e-6, 1 - 1e-6)
        pairs = [joint_normal(np.array([a]), np.array([b]), np.array([rho]))[0] >= 0.42 for a, b in itertools.combinations(p, 2)]
        assert got.get(d, 0) == sum(pairs)


def test_fingerprint_sees_repeated_rows(spark):
    from slatemill.operators.metrics import fingerprint

    f = lambda rows: {x["k"]: (x["hash"], x["n"]) for x in fingerprint(spark.createDataFrame(rows, "k int, a string, b int"), ["k"], ["a", "b"]).collect()}[1]
    assert f([(1, "x", 1), (1, "x", 1)]) != f([(1, "y", 2), (1, "y", 2)])
    assert f([(1, "x", 1), (1, "y", 2)]) == f([(1, "y", 2), (1, "x", 1)])
    assert f([(1, None, 1)]) != f([(1, "", 1)]) and f([(1, "1", 11)]) != f([(1, "11", 1)])
