"""Team states against a plain ordered fold, cut into blocks of any size."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slatemill.operators.states import BOX_RATES, decayed_before, expected_points, team_states


def ew(state, total, n, d):
    v, w = state
    w *= d ** n
    return ((0.0 if v is None else v) * w + total) / (w + n), w + n


def plain_fold(games, k=0.08, halflife=10.0, prior=5.0, regress=0.4):
    """Every date is emitted from the state at its start, then its pairings are folded one after another."""
    d = 0.5 ** (1 / halflife)
    out = {}
    for league, all_ in games.groupby("league"):
        lg, ll, adv, lb = (200.0, 1.0), (200.0, 1.0), (0.0, 50.0), [(None, 0.0)] * 13
        state, last = {}, None
        for date, day in all_.groupby("date"):
            rows = []
            for key, g in day.groupby(["home", "away", "season"]):
                ok = g[g.box_home.notna() & g.box_away.notna()]
                rows.append((*key, len(g), g.home_pts.sum(), g.away_pts.sum(), g.line.sum(), len(ok), np.sum(ok.box_home.tolist(), axis=0), np.sum(ok.box_away.tolist(), axis=0)))
            for h, a, season, *_ in rows:
                for t in (h, a):
                    s = state.setdefault(t, {"season": None, "off": 0.0, "dfn": 0.0, "n": 0, "nb": 0, "box": None, **{x: (0.0, 0.0) for x in ("lt", "ou", "pf", "pa")}})
                    if s["season"] not in (None, season):
                        s["off"] *= 1 - regress
                        s["dfn"] *= 1 - regress
                        for x in ("lt", "ou", "pf", "pa"):
                            v, w = s[x]
                            s[x] = (v * (1 - regress) if x in ("lt", "ou") else v, min(w, prior))
                        if s["box"]:
                            s["box"] = [(v if z[0] is None else (1 - regress) * v + regress * z[0], min(w, prior)) for (v, w), z in zip(s["box"], lb)]
                        s["n"] = s["nb"] = 0
                    s["season"] = season
                    out[league, date, t] = (s["off"], s["dfn"], s["n"], s["lt"][0], s["ou"][0], s["pf"][0] if s["pf"][1] else None, s["pa"][0] if s["pa"][1] else None,
                                            lg[0], ll[0], adv[0], s["nb"], *([v for v, _ in s["box"]] if s["box"] else [None] * 13), *[v for v, _ in lb], last)
            snap = {t: (s["off"], s["dfn"]) for t, s in state.items()}
            base, edge, line0, league_box = lg[0] / 2, adv[0] / 2, ll[0], list(lb)
            for h, a, season, n, hp, ap, ln, nb, bh, ba in rows:
                eh, ea = hp - n * (base + edge + snap[h][0] + snap[a][1]), ap - n * (base - edge + snap[a][0] + snap[h][1])
                for s, e1, e2, pf, pa, b in ((state[h], eh, ea, hp, ap, bh), (state[a], ea, eh, ap, hp, ba)):
                    s["off"] += k * e1
                    s["dfn"] += k * e2
                    s["n"] += n
                    for x, total in (("lt", ln - n * line0), ("ou", hp + ap - ln), ("pf", pf), ("pa", pa)):
                        s[x] = ew(s[x], total, n, d)
                    if nb:
                        if s["box"] is None:
                            s["box"] = [(b[i] / nb if z[0] is None else z[0], prior / 2) for i, z in enumerate(league_box)]
                        s["box"] = [ew(v, b[i], nb, d) for i, v in enumerate(s["box"])]
                        s["nb"] += nb
                        lb = [ew(v, b[i], nb, 0.5 ** (1 / 150)) for i, v in enumerate(lb)]
                adv = ew(adv, eh - ea + n * adv[0], n, 0.5 ** (1 / 500))
                lg, ll = ew(lg, hp + ap, n, 0.5 ** (1 / 150)), ew(ll, ln, n, 0.5 ** (1 / 150))
            last = date
    return out


def random_games(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for league, teams, dates in ((1, 6, 90), (2, 4, 30)):
        for i in range(dates):
            date = dt.date(2019, 9, 1) + dt.timedelta(days=9 * i)
            for _ in range(int(r.integers(1, 5))):
                h, a = r.choice(teams, 2, replace=False)
                # some pairings play very often on a date
                for _ in range(int(r.choice([1, 1, 2, 40])) if league == 1 else 1):
                    box = [r.uniform(0, 1, 13).tolist() if i > 3 and r.random() < 0.7 else None for _ in range(2)]
                    rows.append((league, date.year + (date.month >= 9), date, 10 * league + int(h), 10 * league + int(a), int(r.integers(80, 130)), int(r.integers(80, 130)), float(r.integers(190, 230)), *box))
    return pd.DataFrame(rows, columns=["league", "season", "date", "home", "away", "home_pts", "away_pts", "line", "box_home", "box_away"])


SCHEMA = "league long, season long, date date, home long, away long, home_pts long, away_pts long, line double, box_home array<double>, box_away array<double>"


@pytest.mark.parametrize("block_rows", [7, 16_384])
def test_blocks_equal_the_plain_fold(spark, block_rows):
    games = random_games()
    df = spark.createDataFrame(games.to_dict("records"), SCHEMA)
    states = team_states(df, block_rows=block_rows)
    want = plain_fold(games)
    got = {(r.league, r.date, r.team): (r.off, r.dfn, r.games, r.line_tend, r.ou_trend, r.pts_for, r.pts_against, r.lg_total, r.lg_line, r.home_adv, r.box_games,
                                        *[r[f"b_{x}"] for x in BOX_RATES], *[r[f"lb_{x}"] for x in BOX_RATES], r.asof) for r in states.collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        for i, (x, y) in enumerate(zip(got[key], w)):
            assert (x is None) == (y is None) and (x is None or x == y or abs(x - y) <= 1e-9 * max(1.0, abs(y))), (key, i, x, y)
    e = expected_points(df, states).where("box_exp_total IS NOT NULL").first()
    pace = e.home_pace * e.away_pace / e.lb_pace
    assert e.box_exp_total == pytest.approx(pace * (e.home_ortg * e.away_drtg + e.away_ortg * e.home_drtg) / e.lb_ortg / 100)


def test_without_box_and_text_keys(spark):
    games = random_games(4).drop(columns=["box_home", "box_away"])
    df = spark.createDataFrame(games.to_dict("records"), SCHEMA.split(", box_home")[0])
    a = team_states(df)
    b = team_states(df.withColumns({c: F.col(c).cast("string") for c in ("league", "season", "home", "away")}), block_rows=11)
    rows = lambda x: sorted((str(r.league), r.date, str(r.team), float(f"{r.off:.7g}"), float(f"{r.dfn:.7g}"), r.games) for r in x.collect())
    assert rows(a) == rows(b) and team_states(df.limit(0)).count() == 0


def test_decayed_sums_over_many_chunks(spark):
    r = np.random.default_rng(0)
    n = r.choice([1, 1, 3, 500], 400).astype(float)
    rows, upto, sums = [], 0.0, []
    s = 0.0
    for i in range(400):
        x = float(r.normal())
        sums.append(s)
        s = s * 0.5 ** (n[i] / 2) + x
        upto += n[i]
        rows.append((1, i, float(n[i]), float(upto), x))
    d = spark.createDataFrame(rows, "k long, i long, n double, upto double, x double")
    got = {q.i: q.d_x for q in decayed_before(d, ["k"], ["i"], "n", "upto", {"x": F.col("x")}, 2.0).collect()}
    assert np.allclose([got[i] for i in range(400)], sums, atol=1e-12)
