"""The joined feature frames: what they saw, and their derived columns against pandas."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from slatemill.operators import history, spine
from slatemill.plans.q_history import HIST, STYLE, long_history, style
from slatemill.plans.q_models import rated_games
from slatemill.plans.standins import games
from slatemill.session import cut_lineage

SF = "/root/testdata/sf0.001"


def frame(spark, g=None, hist=None, st=None, rated=None):
    return spine.spine(games(spark, SF) if g is None else g, long_history(spark, SF) if hist is None else hist, style(spark, SF) if st is None else st, HIST, STYLE, rated)


def test_no_builder_has_seen_its_own_date(spark):
    d = cut_lineage(frame(spark, rated=rated_games(spark, SF)))
    history.assert_no_leakage(d)
    seen = d.where("asof IS NOT NULL")
    assert seen.count() > 1000 and seen.where("rating_asof IS NOT NULL").count() > 500


@pytest.mark.parametrize("builder", ["history", "league"])
def test_a_builder_that_sees_its_own_date_is_caught(spark, monkeypatch, builder):
    past = history._past

    def leaky(keys, date, n=None):
        if (keys == ["league"]) == (builder == "league"):
            start = Window.unboundedPreceding if n is None else -n
            return Window.partitionBy(*keys).orderBy(date).rowsBetween(start, 0)
        return past(keys, date, n)

    monkeypatch.setattr(history, "_past", leaky)
    with pytest.raises(AssertionError):
        history.assert_no_leakage(frame(spark))


def test_rating_columns_follow_from_the_frame(spark):
    f = cut_lineage(frame(spark, rated=rated_games(spark, SF)))
    d = spine.market_spine(f).select("league", "market", "date", "full_line", "rt_pts_home", "rt_pts_away", "rt_poss", "rt_n_home", "rt_n_away", "implied_home", "implied_away",
                                     "x_pts", "x_poss", "x_home_tt", "x_tt_absdiff", "early", "log_games", "x_poss_early").toPandas()
    assert d.x_pts.notna().sum() > 500
    assert np.allclose(d.x_pts, d.rt_pts_home + d.rt_pts_away - d.full_line, equal_nan=True)
    tempo = d.groupby(["league", "market", "date"]).rt_poss.mean().reset_index()
    tempo["trail"] = tempo.groupby(["league", "market"]).rt_poss.transform(lambda s: s.rolling(30, min_periods=1).mean().shift(1))
    j = d.merge(tempo[["league", "market", "date", "trail"]], on=["league", "market", "date"])
    assert np.allclose(j.x_poss, j.rt_poss - j.trail, equal_nan=True) and np.allclose(j.x_home_tt, j.rt_pts_home - j.implied_home, equal_nan=True)
    few = np.minimum(d.rt_n_home, d.rt_n_away)
    assert (d.early == (few < 6).astype(int)).all() and np.allclose(d.log_games, np.log1p(few.fillna(0)))


def test_later_results_move_no_earlier_row(spark):
    cut = dt.date(1998, 6, 1)
    late = F.col("date") >= F.lit(cut).cast("date")
    move = lambda d, cols: d.withColumns({c: F.when(late, F.col(c) + 1 + F.pmod(F.xxhash64(F.lit(c), "game_key"), F.lit(9))).otherwise(F.col(c)) for c in cols})
    cols = ["game_key", "market", "date", "lg_drift", "open_bias_sum", "move_hist_sum", "vol_sum", "m_pace", "m_efg"]
    plain = spine.market_spine(frame(spark)).select(cols).toPandas()
    moved = spine.market_spine(frame(spark, move(games(spark, SF), ["total"]), move(long_history(spark, SF), HIST), move(style(spark, SF), STYLE))).select(cols).toPandas()
    a, b = (x.sort_values(["game_key", "market"]).reset_index(drop=True) for x in (plain, moved))
    same = np.isclose(a[cols[3:]].fillna(-9), b[cols[3:]].fillna(-9)).all(axis=1)
    early = pd.to_datetime(a["date"]).dt.date <= cut
    assert same[early].all() and not same[~early].all()


def test_rungs_of_the_ladder():
    assert spine.feature_set("F0_market_only") == [] and spine.feature_set("F2_ratings") == ["x_naive", "x_rating"]
    assert len(spine.feature_set("F8_trends")) == 19 and not set(spine.feature_set("F8_trends", box=False)) & spine.BOX_FEATURES
