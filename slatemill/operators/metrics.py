"""Bet, forecast and card metrics as aggregates."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip
from slatemill.functions.probability import wilson_interval
from slatemill.operators.clean import bin_index
from slatemill.operators.running import drawdown, longest_run, quantile_edges


# ------------------------------------------------------------------ forecast scores
def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss_row(p: Column, y: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def two_sided_log_loss_row(p_over: Column, p_under: Column, sign_over: Column) -> Column:
    """Loss of the probability the model gave to what happened, pushes excluded (null)."""
    q = clip(p_over / (p_over + p_under), 1e-6, 1 - 1e-6)
    return F.when(sign_over == 1, -F.log(q)).when(sign_over == -1, -F.log(1 - q))


def reliability(df: DataFrame, keys: list[str], p: str, y: str, bucket: Column) -> DataFrame:
    d = df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    k, n = F.sum(y), F.count("*")
    lo, hi = wilson_interval(F.col("k"), F.col("n"))
    g = d.groupBy(*keys, "bucket").agg(n.alias("n"), k.alias("k"), F.avg(p).alias("pred"))
    return g.select(*keys, "bucket", "n", "pred", (F.col("k") / F.col("n")).alias("actual"), lo.alias("ci_lo"), hi.alias("ci_hi"),
                    (F.col("k") / F.col("n") - F.col("pred")).alias("cal_err"))


def quantile_bins(df: DataFrame, keys: list[str], col: str, steps: int, weight: str | None = None) -> DataFrame:
    """Equal-frequency bin index of `col`; the edges are at most steps + 1 numbers per key. `weight` counts rows already added up."""
    e = quantile_edges(df, keys, col, steps, weight)
    j = df.join(e, keys) if keys else df.join(F.broadcast(e))                # no keys: one short array
    return j.withColumn("bin", bin_index(F.col(col), F.col("edges"))).drop("edges")


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-frequency bins [edge, next edge)."""
    e = quantile_edges(df, [], p, bins)
    j = df.join(F.broadcast(e))                                              # one row: bins + 1 edges
    idx = F.least(F.size(F.filter("edges", lambda x: x <= F.col(p))) - 1, F.size("edges") - 2)
    g = j.groupBy(F.greatest(idx, F.lit(0)).alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


# ------------------------------------------------------------------ bet summaries
def bet_aggregates(p: str = "p", sign: str = "sign", pnl: str = "pnl") -> list[Column]:
    """Bets, wins, pushes, win rate without pushes, mean forecast, ROI, units and its standard error."""
    won, settled = F.count_if(F.col(sign) == 1), F.nullif(F.count_if(F.col(sign) != 0), F.lit(0))
    return [F.count("*").alias("bets"), won.alias("wins"), F.count_if(F.col(sign) == 0).alias("pushes"),
            (won / settled).alias("win_rate"), F.avg(p).alias("avg_pred"),
            (won / settled - F.avg(F.when(F.col(sign) != 0, F.col(p)))).alias("cal_err"),
            F.avg(pnl).alias("roi"), F.sum(pnl).alias("units"), (F.stddev_samp(pnl) / F.sqrt(F.count(pnl))).alias("roi_se")]


def with_wilson(df: DataFrame, k: str = "wins", n: Column | None = None) -> DataFrame:
    lo, hi = wilson_interval(F.col(k), F.col("bets") - F.col("pushes") if n is None else n)
    return df.withColumn("ci_lo", lo).withColumn("ci_hi", hi)


def with_pooled(df: DataFrame, key: str, aggs: list[Column], label: str = "POOLED") -> DataFrame:
    """Per-key rows and one pooled row from a single rollup."""
    g = df.rollup(key).agg(F.grouping_id().alias("_all"), *aggs)
    return g.withColumn(key, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(key).cast("string"))).drop("_all")


def slice_table(df: DataFrame, dims: dict[str, Column], extra: list[str], aggs: list[Column]) -> DataFrame:
    """Every dimension's slices in one pass: dimensions are unfolded to (dim, value) rows and grouped
    once, so the bets are read and shuffled once however many dimensions there are."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), c.cast("string").alias("value")) for n, c in dims.items()])
    return df.withColumn("_s", F.explode(pairs)).select("*", "_s.*").drop("_s").groupBy("dim", "value", *extra).agg(*aggs)


def equity_report(df: DataFrame, keys: list[str], chunk: Column, order: list[str], pnl: str = "pnl") -> DataFrame:
    """Units, deepest drawdown and longest losing run per key."""
    dd = drawdown(df, keys, chunk, order, pnl)
    run = longest_run(df, keys, chunk, order, F.col(pnl) < 0, "losing_run")
    return dd.join(run, keys)


# ------------------------------------------------------------------ clustered bootstrap
def poisson_weight(seed: int, *ids: Column) -> Column:
    """Poisson(1) draw from a hash, so resamples do not depend on partitioning."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(2 ** 40)).cast("double") + 0.5) / float(2 ** 40)
    cdf, acc = [], 0.0
    for k in range(12):
        acc += math.exp(-1) / math.factorial(k)
        cdf.append(acc)
    out = F.lit(len(cdf))
    for k in range(len(cdf) - 1, -1, -1):
        out = F.when(u < cdf[k], F.lit(k)).otherwise(out)
    return out


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, top: Column, bottom: Column, n_boot: int = 1000,
                      seed: int = 0) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom), resampling whole clusters. Rows reduce to one
    pair of sums per cluster first; each cluster then carries `n_boot` weights, which combine map-side."""
    sums = df.groupBy(*keys, cluster).agg(F.sum(top).alias("t"), F.sum(bottom).alias("b"))
    reps = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    w = poisson_weight(seed, F.col("rep"), F.col(cluster).cast("string"))
    r = reps.withColumn("w", w).groupBy(*keys, "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("t")), F.sum(F.col("w") * F.col("b"))).alias("r"))
    ci = r.groupBy(*keys).agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("r").alias("boot_mean"))
    point = sums.groupBy(*keys).agg(F.try_divide(F.sum("t"), F.sum("b")).alias("value"), F.count("*").alias("clusters"))
    out = point.join(ci, keys) if keys else point.join(F.broadcast(ci))      # one row each
    return out.select(*keys, "value", "clusters", "boot_mean", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"))


def paired_day_sums(a: DataFrame, b: DataFrame, day: str, profit: str) -> DataFrame:
    """Profit and count of two arms on every day that either has: (day, profit_a, n_a, profit_b, n_b), zero where an arm rests."""
    arm = lambda d, s: d.select(day, *[(F.col(profit) if s == x else F.lit(0.0)).cast("double").alias(f"profit_{x}") for x in "ab"],
                                *[F.lit(int(s == x)).alias(f"n_{x}") for x in "ab"])
    names = ["profit_a", "n_a", "profit_b", "n_b"]
    return arm(a, "a").unionByName(arm(b, "b")).groupBy(day).agg(*[F.sum(c).alias(c) for c in names])


def paired_day_difference(a: DataFrame, b: DataFrame, day: str, profit: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Return per bet of two arms and their difference with a percentile interval; whole days are resampled, both arms
    together. One row."""
    d = paired_day_sums(a, b, day, profit)
    w = poisson_weight(seed, F.col("rep"), F.col(day).cast("string"))
    roi = lambda x, k=None: F.sum(F.col(f"profit_{x}") * k if k is not None else F.col(f"profit_{x}")) / F.greatest(
        F.sum(F.col(f"n_{x}") * k if k is not None else F.col(f"n_{x}")), F.lit(1))
    reps = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("w", w)
    reps = reps.groupBy("rep").agg((roi("b", F.col("w")) - roi("a", F.col("w"))).alias("diff"))
    ci = reps.agg(F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("diff") > 0).cast("double")).alias("share_b_better"))
    point = d.agg(F.count("*").alias("days"), roi("a").alias("roi_a"), roi("b").alias("roi_b"))
    return point.join(F.broadcast(ci)).select("days", "roi_a", "roi_b", (F.col("roi_b") - F.col("roi_a")).alias("diff"),      # one row each
                                              F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "share_b_better")


# ------------------------------------------------------------------ signal screen
def signal_screen(df: DataFrame, signals: dict[str, Column], target: str, era: str, min_n: int = 30) -> DataFrame:
    """Slope t-statistic of the target on each signal per era, from regression sums of one pass."""
    arr = F.array(*[F.struct(F.lit(n).alias("signal"), c.cast("double").alias("x")) for n, c in signals.items()])
    long = df.select(era, F.col(target).cast("double").alias("y"), F.explode(arr).alias("s")).select(era, "y", "s.*")
    g = long.groupBy("signal", era).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"), F.regr_count("y", "x").alias("n"))
    sxx = F.nullif(F.col("sxx"), F.lit(0.0))
    rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / sxx, F.lit(0.0))
    t = F.when((F.col("n") >= min_n) & (F.col("sxx") > 0), F.try_divide(F.col("slope"), F.sqrt(rss / (F.col("n") - 2) / sxx)))
    return g.select("signal", era, "slope", "n", t.alias("t"))


def signal_leads(screen: DataFrame, era: str, discovery: str, validation: str) -> DataFrame:
    """A signal leads if |t| >= 2 in discovery and the same sign with |t| >= 1.5 in validation."""
    pick = lambda e, c: F.max(F.when(F.col(era) == e, F.col(c)))
    g = screen.groupBy("signal").agg(pick(discovery, "t").alias("t_disc"), pick(validation, "t").alias("t_val"),
                                     pick(discovery, "n").alias("n_disc"), pick(validation, "n").alias("n_val"))
    lead = (F.abs("t_disc") >= 2) & (F.signum("t_disc") == F.signum("t_val")) & (F.abs("t_val") >= 1.5)
    return g.withColumn("lead", F.coalesce(lead, F.lit(False)))


# ------------------------------------------------------------------ same-slate dependence without pairs
def slate_sums(df: DataFrame, keys: list[str], slate: str, x: str, z: str) -> DataFrame:
    """One row per slate with what its pair statistics need.

    With S = sum and Q = sum of squares of a slate of n, the sum over pairs of x_i x_j is
    (S^2 - Q) / 2, and with both orders of a pair counted the two margins are the same: their sum is
    (n - 1) S and their sum of squares (n - 1) Q. So no pair is ever formed.
    """
    s = df.groupBy(*keys, slate).agg(
        F.count("*").cast("double").alias("n"), F.sum(x).cast("double").alias("sx"), F.sum(F.col(x) * F.col(x)).cast("double").alias("qx"),
        F.sum(z).alias("sz"), F.sum(F.col(z) * F.col(z)).alias("qz")).where("n >= 2")
    n = F.col("n")
    half = {"m": n * (n - 1) / 2}
    for t in ("x", "z"):
        half |= {f"c{t}": (F.col(f"s{t}") ** 2 - F.col(f"q{t}")) / 2, f"m{t}": (n - 1) * F.col(f"s{t}") / 2, f"v{t}": (n - 1) * F.col(f"q{t}") / 2}
    return s.select(*keys, slate, *[c.alias(k) for k, c in half.items()])


def _pair_corr(t: str) -> Column:
    mean = F.col(f"m{t}") / F.col("m")
    return F.try_divide(F.col(f"c{t}") / F.col("m") - mean * mean, F.col(f"v{t}") / F.col("m") - mean * mean)


PAIR_SUMS = ["m", "cx", "mx", "vx", "cz", "mz", "vz"]


def pair_dependence(df: DataFrame, keys: list[str], slate: str, x: str, z: str) -> DataFrame:
    """Correlations of outcomes and errors over all unordered same-slate pairs."""
    g = slate_sums(df, keys, slate, x, z).groupBy(*keys).agg(F.count("*").alias("slates"), *[F.sum(c).alias(c) for c in PAIR_SUMS])
    joint, mean = F.col("cx") / F.col("m"), F.col("mx") / F.col("m")
    return g.select(*keys, F.col("m").cast("long").alias("pairs"), "slates", _pair_corr("x").alias("over_corr"), _pair_corr("z").alias("z_corr"),
                    joint.alias("joint_rate"), (joint - mean * mean).alias("joint_minus_product"))


def earlier_season_dependence(df: DataFrame, season: str, slate: str, x: str, z: str, n_boot: int = 200, seed: int = 0,
                              min_pairs: int = 2000, fallback: tuple[float, float] = (0.0, -0.05)) -> DataFrame:
    """Per season, error correlation over earlier seasons' slates with its bootstrap 2.5% bound; too
    little history falls back to a cautious pair. Slates, not rows, are resampled."""
    from slatemill.operators.models import expand_to_later_seasons, later_seasons

    s = expand_to_later_seasons(slate_sums(df, [season], slate, x, z), season, later_seasons(df, season))
    s = s.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(n_boot - 1))))
    w = F.when(F.col("rep") < 0, F.lit(1)).otherwise(poisson_weight(seed, F.col("rep"), F.col(slate).cast("string")))
    g = s.withColumn("w", w).groupBy("for_season", "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in PAIR_SUMS]).where("m > 0")
    r = g.select("for_season", "rep", "m", _pair_corr("z").alias("r"))
    b = r.groupBy(F.col("for_season").alias(season)).agg(
        F.max(F.when(F.col("rep") < 0, F.col("r"))).alias("rho"), F.max(F.when(F.col("rep") < 0, F.col("m"))).alias("pairs"),
        F.percentile(F.when(F.col("rep") >= 0, F.col("r")), F.lit(0.025)).alias("rho_lo"))
    ok = F.col("pairs") >= min_pairs
    out = df.select(season).distinct().join(b, season, "left")
    return out.select(season, F.when(ok, F.col("rho")).otherwise(fallback[0]).alias("rho"), F.when(ok, F.col("rho_lo")).otherwise(fallback[1]).alias("rho_lo"))


# ------------------------------------------------------------------ table fingerprint
def fingerprint(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Order-free content hash and row count per key: two sums of row hashes. A sum counts a repeated row as often
    as it occurs, where an exclusive or would cancel pairs of them. Nulls differ from empty texts."""
    text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    d = df.withColumn("_m", F.md5(F.concat(*text)))
    part = lambda start: F.sum(F.conv(F.substring("_m", start, 15), 16, 10).cast("decimal(28,0)")).cast("string")
    return d.groupBy(*keys).agg(F.concat_ws("-", part(1), part(16)).alias("hash"), F.count("*").alias("n"))
