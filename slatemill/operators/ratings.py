"""Opponent-adjusted daily ratings; sequential team states are in `states`.

Both start from one small table: per (league, date, home, away, neutral) the number of games and
the sums of points. However many rows a league holds, that table is bounded by teams and days, and
it carries everything the normal equations and the state updates need.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.functions.dates import day_number
from slatemill.operators.states import BOX_RATES, expected_points, schema_text, spread, team_states, with_box_rates  # noqa: F401


def pair_days(games: DataFrame) -> DataFrame:
    """Sufficient sums per league day and pairing (one shuffle, combined map-side)."""
    has = F.col("poss").isNotNull()
    per100 = lambda c: F.sum(F.when(has, 100.0 * F.col(c) / F.col("poss")))
    return games.groupBy("league", "season", "date", "home", "away", "neutral").agg(
        F.count("*").cast("double").alias("n"), F.sum("home_pts").cast("double").alias("hp"), F.sum("away_pts").cast("double").alias("ap"),
        F.count("poss").cast("double").alias("nb"), F.sum("poss").alias("ps"), per100("home_pts").alias("he"), per100("away_pts").alias("ae"))


def _system(sides: list[tuple], y: list[np.ndarray], n: np.ndarray, size: int, teams: int, ridge: float) -> np.ndarray:
    """Solve sum w (x'b - y)^2 + ridge |b_teams|^2 from grouped rows. `sides` lists, for each view of
    a row, its (column index, value) pairs; `y` the weighted target sums; `n` the weighted counts."""
    ata, aty = np.zeros((size, size)), np.zeros(size)
    for cols, target in zip(sides, y):
        for ci, vi in cols:
            np.add.at(aty, ci, vi * target)
            for cj, vj in cols:
                np.add.at(ata, (ci, cj), n * vi * vj)
    reg = np.zeros(size)
    reg[:teams] = ridge
    return np.linalg.solve(ata + np.diag(reg + 1e-9), aty)


RATING_COLUMNS = ("league", "date", "home", "away", "neutral", "asof", "n_home", "n_away", "pts_home", "pts_away", "poss", "oe_home", "oe_away", "eff_total")


def _rate_block(d: pd.DataFrame, league, block: int, half_life: float, previous: float, ridge: float, lookback: int,
                venue_tempo: bool, min_games: int, block_days: int) -> pd.DataFrame:
    """Ratings of a block's dates from its pair-days and those before. All rows of a pairing (home, away, venue) enter the normal
    equations alike, so a date's weighted rows are summed by pairing first and the systems are built from pairings."""
    d = d.sort_values(["day", "home", "away", "neutral"]).reset_index(drop=True)
    day, date, season, n = d.day.to_numpy(), d.date.to_numpy(), d.season.to_numpy(), d.n.to_numpy()
    start, stop = np.searchsorted(day, [block * block_days, (block + 1) * block_days])
    teams = {t: i for i, t in enumerate(sorted(set(d.home) | set(d.away)))}
    k = len(teams)
    hi, ai, venue = d.home.map(teams).to_numpy(), d.away.map(teams).to_numpy(), 1.0 - d.neutral.to_numpy(float)
    pairings, at = np.unique((hi * k + ai) * 2 + (venue > 0), return_inverse=True)
    h, a, v = pairings // 2 // k, pairings // 2 % k, (pairings % 2).astype(float)
    o = np.ones(len(pairings))
    hp, ap, nb, ps, he, ae = (d[c].fillna(0.0).to_numpy() for c in ("hp", "ap", "nb", "ps", "he", "ae"))
    found = {c: np.full(stop - start, np.nan) for c in RATING_COLUMNS[6:]}
    seen = np.full(stop - start, None, dtype=object)
    for dn in np.unique(day[start:stop]):
        here = slice(*np.searchsorted(day, [dn, dn + 1]))
        past = slice(np.searchsorted(day, dn - lookback), here.start)        # rows are in order of days
        if n[past].sum() < min_games:
            continue
        to = slice(here.start - start, here.stop - start)
        cur = season[past] == season[here.start]
        w = np.where(cur, 0.5 ** ((dn - day[past]) / half_life), previous)
        of = lambda x: np.bincount(at[past], weights=w * x[past], minlength=len(pairings))
        mu, hb, ab = 2 * k, 2 * k + 1, 2 * k + 2
        b = _system([[(h, o), (k + a, o), (np.full(len(h), mu), o), (np.full(len(h), hb), v)],
                     [(a, o), (k + h, o), (np.full(len(h), mu), o), (np.full(len(h), ab), v)]],
                    [of(hp), of(ap)], of(n), 2 * k + 3, 2 * k, ridge)
        played = np.bincount(hi[past], weights=n[past] * cur, minlength=k) + np.bincount(ai[past], weights=n[past] * cur, minlength=k)
        th, ta, tv = hi[here], ai[here], venue[here]
        seen[to] = date[past][-1]
        found["n_home"][to], found["n_away"][to] = played[th], played[ta]
        found["pts_home"][to] = b[mu] + b[th] + b[k + ta] + b[hb] * tv
        found["pts_away"][to] = b[mu] + b[ta] + b[k + th] + b[ab] * tv
        if nb[past].sum() >= min_games:
            wb = of(nb)
            m, hv = 2 * k, 2 * k + 1
            e = _system([[(h, o), (k + a, o), (np.full(len(h), m), o), (np.full(len(h), hv), v)],
                         [(a, o), (k + h, o), (np.full(len(h), m), o), (np.full(len(h), hv), -v)]],
                        [of(he), of(ae)], wb, 2 * k + 2, 2 * k, ridge)
            t = _system([[(h, o), (a, o), (np.full(len(h), k), o), (np.full(len(h), k + 1), v)]], [of(ps)], wb, k + 2, k, ridge)
            poss = t[k] + t[th] + t[ta] + (t[k + 1] * tv if venue_tempo else 0.0)
            oh, oa = e[m] + e[th] + e[k + ta] + e[hv] * tv, e[m] + e[ta] + e[k + th] - e[hv] * tv
            found["poss"][to], found["oe_home"][to], found["oe_away"][to], found["eff_total"][to] = poss, oh, oa, poss * (oh + oa) / 100.0
    own = d[list(RATING_COLUMNS[1:5])].iloc[start:stop].reset_index(drop=True)
    return own.assign(league=league, asof=seen, **found)[list(RATING_COLUMNS)]


def daily_ratings(games: DataFrame, half_life: float = 45.0, previous: float = 0.15, ridge: float = 3.0, lookback: int = 400,
                  venue_tempo: bool = False, min_games: int = 30, block_days: int = 60) -> DataFrame:
    """Expected points, possessions and efficiency of every pairing from games strictly before its
    date: this season weighted by 0.5^(age / half_life), earlier ones within `lookback` days by a
    constant. Leagues are cut into blocks of days; a block receives the pair-days it can look back
    on, so blocks solve independently and a large league is spread over many tasks. Joins back on
    (league, date, home, away, neutral). games: league, season, date, home, away, neutral, home_pts,
    away_pts, poss (nullable)."""
    p = pair_days(games).withColumn("day", day_number(F.col("date")))
    first = F.floor(F.col("day") / block_days)
    last = F.floor((F.col("day") + lookback) / block_days)
    p = p.withColumn("block", F.explode(F.sequence(first, last)))

    def solve(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        return _rate_block(d, key[0], key[1], half_life, previous, ridge, lookback, venue_tempo, min_games, block_days)

    return spread(p, "league", "block").groupBy("league", "block").applyInPandas(solve, schema_text(games, RATING_COLUMNS, {"away": "home"}))
