"""Chunked running operators against plain NumPy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slatemill.operators import running, staking
from slatemill.operators.calibrate import neighbourhood_bound, pit_bounds
from slatemill.functions.probability import beta_cdf, beta_quantile_array


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    n = 400
    return pd.DataFrame({"g": r.integers(0, 2, n), "i": np.arange(n), "pnl": r.choice([0.9, -1.0, 0.0], n, p=[0.45, 0.5, 0.05]), "p": np.round(r.random(n), 2), "y": r.integers(0, 2, n).astype(float)})


def chunk():
    return F.floor(F.col("i") / 37)


def test_drawdown_and_run(spark, rows):
    d = spark.createDataFrame(rows)
    dd = {x["g"]: x for x in running.drawdown(d, ["g"], chunk(), ["i"], "pnl").collect()}
    lr = {x["g"]: x["run"] for x in running.longest_run(d, ["g"], chunk(), ["i"], F.col("pnl") < 0, "run").collect()}
    for g, x in rows.groupby("g"):
        eq = np.concatenate([[0], x.pnl.cumsum()])
        assert dd[g]["max_drawdown"] == pytest.approx((np.maximum.accumulate(eq) - eq).max())
        best = cur = 0
        for v in x.pnl:
            cur = cur + 1 if v < 0 else 0
            best = max(best, cur)
        assert lr[g] == best


def test_running_total_and_max(spark, rows):
    d = spark.createDataFrame(rows)
    t = running.running_total(d, ["g"], chunk(), ["i"], "pnl", "t").toPandas().sort_values("i")
    m = running.running_max(d, ["g"], chunk(), ["i"], "p", "m").toPandas().sort_values("i")
    assert np.allclose(t.t, rows.groupby("g").pnl.cumsum())
    assert np.allclose(m.m, rows.groupby("g").p.cummax())


@pytest.mark.parametrize("steps", [2, 10, 200])
def test_quantiles_are_exact(spark, rows, steps):
    q = running.grid_quantiles(spark.createDataFrame(rows), ["g"], "p", steps).toPandas()
    for g, x in rows.groupby("g"):
        got = q[q.g == g].sort_values("i")
        assert np.allclose(got.q, np.quantile(x.p, np.linspace(0, 1, steps + 1)))


def test_neighbourhood_bound_widens_downward(spark, rows):
    d = spark.createDataFrame(rows)
    got = neighbourhood_bound(d, d, ["g"], "p", "y", width=0.02, min_n=30).toPandas()
    for g, x in rows.groupby("g"):
        hp = np.sort(x.p.to_numpy())
        for r in got[got.g == g].itertuples():
            lo, hi = np.searchsorted(hp, r.p - 0.02, "left"), np.searchsorted(hp, r.p + 0.02, "right")
            if hi - lo < 30:
                lo = max(0, hi - 30)
            assert r.n == hi - lo
            if lo == 0 or hp[lo - 1] < hp[lo]:                      # no tie at the edge: wins are exact
                assert r.wins == pytest.approx(x.y[(x.p >= hp[lo]) & (x.p <= hp[hi - 1])].sum())
            assert r.bound == pytest.approx(beta_quantile_array(0.05, np.array([1 + r.wins]), np.array([1 + r.n - r.wins]))[0])


def test_pit_bounds_bracket(spark, rows):
    d = spark.createDataFrame(rows)
    b = pit_bounds(d, d, ["g"], "p").toPandas()
    assert (b.lo < b.hi).all() and b.lo.between(0, 1).all()


def test_beta_quantile_inverts():
    a, b = np.array([1.5, 30.0, 400.0]), np.array([2.0, 12.0, 380.0])
    assert np.allclose(beta_cdf(beta_quantile_array(0.05, a, b), a, b), 0.05)
    assert beta_cdf(np.array([0.3]), np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.3)


def test_doubling_levels(spark, rows):
    got = staking.doubling_levels(spark.createDataFrame(rows), ["g"], chunk(), ["i"]).toPandas().sort_values("i").set_index("i").level
    for _, x in rows.groupby("g"):
        lvl = 0
        for r in x.itertuples():
            assert got[r.i] == lvl
            if r.pnl != 0:
                lvl = 0 if r.pnl > 0 or lvl == 2 else lvl + 1


def test_ranges_hold_about_equal_numbers_of_rows(spark):
    """Equal widths would put nearly all of a heavy-tailed column into one chunk."""
    r = np.random.default_rng(11)
    v = np.concatenate([r.lognormal(0, 3, 40_000), [1e12, -1e12]])
    d = spark.createDataFrame(pd.DataFrame({"k": "g", "v": v}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = [x["count"] for x in running.in_ranges(d, ["k"], "v").groupBy("_chunk").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(chunks) > 1 and max(chunks) <= 2 * sum(chunks) / len(chunks)
    q = {x["i"]: x["q"] for x in running.grid_quantiles(d, ["k"], "v", 20).collect()}
    assert np.allclose([q[i] for i in range(21)], np.quantile(v, np.linspace(0, 1, 21)))
