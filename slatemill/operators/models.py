"""Walk-forward models from sufficient statistics, and the probabilities they imply."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip
from slatemill.functions.probability import add_norm_cdf
from slatemill.operators.running import chunk_sums, in_ranges
from slatemill.session import cut_lineage


# ------------------------------------------------------------------ seasons
def later_seasons(df: DataFrame, season: str) -> DataFrame:
    """One row: the sorted list of seasons present."""
    return df.select(season).distinct().agg(F.sort_array(F.collect_list(season)).alias("_all"))


def expand_to_later_seasons(df: DataFrame, season: str, all_seasons: DataFrame) -> DataFrame:
    """Each row once per later season it may train (`for_season`); `all_seasons` is a one-row list."""
    j = df.join(F.broadcast(all_seasons))
    return j.withColumn("for_season", F.explode(F.filter("_all", lambda x: x > F.col(season)))).drop("_all")


# ------------------------------------------------------------------ imputation
def medians_of_earlier_seasons(df: DataFrame, season: str, cols: list[str]) -> DataFrame:
    """Exact median per column over all earlier seasons, keyed by the season it serves. Every distinct value carries its
    counts before each season, so one scan and one aggregate serve all seasons and no row is repeated for later
    ones; running sums of the counts along the values, in ranges, tell where every median lies."""
    seasons = sorted(r[0] for r in df.select(season).distinct().collect())               # a short list
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(season, F.explode(arr).alias("x")).select(season, "x.*").where("v IS NOT NULL")
    if len(seasons) < 2:
        return long.select(F.col(season), *[F.lit(None).cast("double").alias(f"med_{c}") for c in cols]).limit(0)
    names = {f"n{i}": s for i, s in enumerate(seasons[1:])}
    counts = long.groupBy("col", "v").agg(*[F.count_if(F.col(season) < s).alias(n) for n, s in names.items()])
    r = chunk_sums(in_ranges(counts, ["col"], "v"), ["col"], ["v"], list(names))
    sizes = r.groupBy("col").agg(*[F.max(f"c_{n}").alias(f"s_{n}") for n in names])
    r = r.join(F.broadcast(sizes), "col")                                                # one row per column
    holds = lambda n, rank: (rank >= F.col(f"c_{n}") - F.col(n)) & (rank < F.col(f"c_{n}"))
    pick = lambda n, rank: F.max(F.when(holds(n, rank), F.col("v")))
    med = r.groupBy("col").agg(*[((pick(n, F.floor((F.col(f"s_{n}") - 1) / 2)) + pick(n, F.ceil((F.col(f"s_{n}") - 1) / 2))) / 2).alias(n) for n in names])
    by_season = med.select("col", F.explode(F.array(*[F.struct(F.lit(s).alias(season), F.col(n).alias("m")) for n, s in names.items()])).alias("x")).select("col", "x.*").where("m IS NOT NULL")
    return cut_lineage(by_season.groupBy(season).agg(*[F.max(F.when(F.col("col") == c, F.col("m"))).alias(f"med_{c}") for c in cols]))     # one row per season


def impute_from_earlier_seasons(df: DataFrame, season: str, cols: list[str]) -> DataFrame:
    med = medians_of_earlier_seasons(df, season, cols)
    j = df.join(F.broadcast(med), season, "left")                                     # one row per season
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"med_{c}")) for c in cols}).drop(*[f"med_{c}" for c in cols])


# ------------------------------------------------------------------ normal probabilities
def add_over_probability(df: DataFrame, mu: Column, line: Column, sd: Column) -> DataFrame:
    """p_over (no push) and p_push for integer totals: an Over needs floor(line) + 1."""
    whole = line == F.floor(line)
    d = add_norm_cdf(df, "_f", (F.floor(line) + 0.5 - line - mu) / sd)
    d = add_norm_cdf(add_norm_cdf(d, "_hi", (F.lit(0.5) - mu) / sd), "_lo", (F.lit(-0.5) - mu) / sd)
    d = d.withColumn("p_push", F.when(whole, F.col("_hi") - F.col("_lo")).otherwise(0.0))
    p = (1 - F.col("_f")) / F.greatest(1 - F.col("p_push"), F.lit(1e-9))
    return d.withColumn("p_over", clip(p, 1e-4, 1 - 1e-4)).drop("_f", "_hi", "_lo")


# ------------------------------------------------------------------ ridge from sufficient statistics
def _design(feats: list[str], target: str) -> list[Column]:
    """1, the target, each feature with 0 for missing, and each feature's missing flag."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats]
    miss = [F.col(f).isNull().cast("double") for f in feats]
    return [F.lit(1.0), F.col(target).cast("double"), *x, *miss]


#: More products than this are summed as matrix products of Arrow batches: aggregates of that many columns are not compiled.
MOST_COLUMNS = 100


def cross_products(df: DataFrame, by: list[str], feats: list[str], target: str, weight: Column | None = None) -> DataFrame:
    """Sums of all pairwise products of the design per group: everything a ridge fit needs, in one
    map-side-combining pass. Missing flags are part of the design, so the sums stay valid whatever
    value is imputed later. With `weight` the unweighted sums are kept beside the weighted ones as `plain`."""
    v = _design(feats, target)
    pairs = [v[i] * v[j] for i in range(len(v)) for j in range(i, len(v))]
    if len(pairs) > MOST_COLUMNS:
        return _products_of_batches(df, by, v, weight)
    if weight is None:
        return df.groupBy(*by).agg(F.array(*[F.sum(x) for x in pairs]).alias("xx")).withColumn("plain", F.col("xx"))
    return df.withColumn("_w", weight).groupBy(*by).agg(F.array(*[F.sum(F.col("_w") * x) for x in pairs]).alias("xx"), F.array(*[F.sum(x) for x in pairs]).alias("plain"))


def _products_of_batches(df: DataFrame, by: list[str], v: list[Column], weight: Column | None) -> DataFrame:
    """A task adds up one matrix per group, the matrices of all tasks are added by entry. A missing target adds nothing."""
    names = [f"_v{i}" for i in range(len(v))]
    v = [v[0], F.coalesce(v[1], F.lit(0.0)), *v[2:]]
    d = df.select(*by, (F.lit(1.0) if weight is None else weight).cast("double").alias("_w"), *[c.alias(n) for c, n in zip(v, names)])
    upper, weighted = np.triu_indices(len(v)), weight is not None

    def add(batches):
        sums: dict[tuple, list] = {}
        for b in batches:
            for key, g in b.groupby(by, sort=False, dropna=False):
                x, w = g[names].to_numpy(float), g["_w"].to_numpy(float)
                plain = x.T @ x
                both = [(x * w[:, None]).T @ x if weighted else plain, plain]
                old = sums.get(key)
                sums[key] = both if old is None else [p + q for p, q in zip(old, both)]
        for key, (xx, plain) in sums.items():
            yield pd.DataFrame({**{c: [k] for c, k in zip(by, key)}, "xx": [xx[upper]], "plain": [plain[upper]]})

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in by)
    parts = d.mapInPandas(add, f"{kinds}, xx array<double>, plain array<double>")
    entry = parts.select(*by, F.posexplode(F.arrays_zip("xx", "plain")).alias("i", "p")).groupBy(*by, "i").agg(F.sum("p.xx").alias("v"), F.sum("p.plain").alias("u"))
    packed = entry.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v", "u"))).alias("p"))
    return packed.select(*by, F.transform("p", lambda x: x["v"]).alias("xx"), F.transform("p", lambda x: x["u"]).alias("plain"))


def _imputed(xx: np.ndarray, med: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Unpack cross products with missing values set to `med`: sums, n, feature means, covariance."""
    d = len(med)
    m = 2 + 2 * d
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = xx
    full = full + np.triu(full, 1).T
    t = np.zeros((2 + d, m))                     # maps the raw design to (1, y, imputed features)
    t[0, 0] = t[1, 1] = 1
    for j in range(d):
        t[2 + j, 2 + j], t[2 + j, 2 + d + j] = 1, med[j]
    s = t @ full @ t.T
    mean = s[0, 2:] / s[0, 0]
    return s, s[0, 0], mean, s[2:, 2:] / s[0, 0] - np.outer(mean, mean)


def solve_ridge(xx: np.ndarray, med: np.ndarray, alpha: float, plain: np.ndarray | None = None
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Ridge on standardised features. With row weights in `xx`, the feature scale still comes from
    the unweighted sums `plain`."""
    d = len(med)
    s, n, mean, cov = _imputed(xx, med)
    spread = cov if plain is None else _imputed(plain, med)[3]
    sd = np.sqrt(np.clip(np.diag(spread), 0, None))
    sd = np.where(sd > 1e-12, sd, 1.0)
    ybar = s[0, 1] / n
    zz = n * cov / np.outer(sd, sd)
    zy = n * (s[1, 2:] / n - mean * ybar) / sd
    coef = np.linalg.solve(zz + alpha * np.eye(d), zy) if d else np.zeros(0)
    y_sd = float(np.sqrt(max(s[1, 1] / n - ybar * ybar, 0.0)))
    return coef, mean, sd, float(ybar), y_sd


def ridge_coefficients(stats: DataFrame, key: str, meds: DataFrame, feats: list[str], alpha: float) -> DataFrame:
    """Coefficient table (one row per season): coef, mean, sd arrays, intercept, target sd."""
    @F.pandas_udf("struct<coef array<double>, mean array<double>, sd array<double>, intercept double, y_sd double>")
    def fit(xx: pd.Series, plain: pd.Series, med: pd.Series) -> pd.DataFrame:
        rows = [solve_ridge(np.asarray(a, float), np.asarray(b, float), alpha, np.asarray(u, float)) for a, u, b in zip(xx, plain, med)]
        return pd.DataFrame({"coef": [r[0].tolist() for r in rows], "mean": [r[1].tolist() for r in rows],
                             "sd": [r[2].tolist() for r in rows], "intercept": [r[3] for r in rows], "y_sd": [r[4] for r in rows]})

    med = F.array(*[F.coalesce(F.col(f"med_{f}"), F.lit(0.0)) for f in feats]) if feats else F.expr("cast(array() as array<double>)")
    j = stats.join(F.broadcast(meds), key, "left") if feats else stats        # one row per season
    plain = F.col("plain") if "plain" in stats.columns else F.col("xx")
    # every caller reads the table more than once; it holds one row per season
    return cut_lineage(j.withColumn("med", med).withColumn("m", fit(F.col("xx"), plain, F.col("med"))).select(key, "med", "m.*"))


def linear_prediction(feats: list[str]) -> Column:
    """intercept + sum coef * (x - mean) / sd, missing features at their training median."""
    out: Column = F.col("intercept")
    for i, f in enumerate(feats):
        x = F.coalesce(F.col(f).cast("double"), F.col("med")[i])
        out = out + F.col("coef")[i] * (x - F.col("mean")[i]) / F.col("sd")[i]
    return out


def earlier_sums(stats: DataFrame, season: str, decay: float | None = None) -> DataFrame:
    """Add up the packed sums of all earlier seasons (one short row per season); with `decay` older
    seasons fade by decay^(age - 1) in `xx`, while `plain` stays unweighted."""
    stats = cut_lineage(stats)        # one row per season, read three times: the data is scanned once
    every = later_seasons(stats, season)
    e = expand_to_later_seasons(stats, season, every).join(F.broadcast(every))            # one row
    age = F.array_position("_all", F.col("for_season")) - F.array_position("_all", F.col(season))
    w = F.lit(1.0) if decay is None else F.pow(F.lit(decay), F.greatest(age - 1, F.lit(0)))
    both = F.transform("xx", lambda x, i: F.struct((x * w).alias("v"), F.get("plain", i).alias("u")))
    pos = e.select("for_season", F.posexplode(both).alias("i", "p")).groupBy("for_season", "i").agg(F.sum("p.v").alias("v"), F.sum("p.u").alias("u"))
    packed = pos.groupBy(F.col("for_season").alias(season)).agg(F.array_sort(F.collect_list(F.struct("i", "v", "u"))).alias("p"))
    return packed.select(season, F.transform("p", lambda x: x["v"]).alias("xx"), F.transform("p", lambda x: x["u"]).alias("plain"))


def contribution_columns(feats: list[str]) -> dict[str, Column]:
    """Each feature's push on the forecast relative to its training median."""
    return {f"c_{f}": F.col("coef")[i] * (F.coalesce(F.col(f).cast("double"), F.col("med")[i]) - F.col("med")[i]) / F.col("sd")[i]
            for i, f in enumerate(feats)}


def fit_mean_models(train: DataFrame, feats: list[str], target: str = "resid", alpha: float = 50.0, decay: float | None = None) -> DataFrame:
    """Per season, the ridge fitted on all earlier seasons: one scan serves every refit."""
    stats = earlier_sums(cross_products(train, ["season"], feats, target), "season", decay)
    meds = medians_of_earlier_seasons(train, "season", feats) if feats else None
    return ridge_coefficients(stats, "season", meds, feats, alpha)


def fit_nested_models(train: DataFrame, sets: dict[str, list[str]], target: str = "resid", alpha: float = 50.0) -> dict[str, DataFrame]:
    """`fit_mean_models` of several sets of features that the largest set holds: its sums and medians serve all of them."""
    feats = max(sets.values(), key=len)
    stats = cut_lineage(earlier_sums(cross_products(train, ["season"], feats, target), "season"))        # one row per season
    meds = medians_of_earlier_seasons(train, "season", feats)
    at = {p: i for i, p in enumerate(zip(*np.triu_indices(2 + 2 * len(feats))))}
    out = {}
    for name, few in sets.items():
        cols = [0, 1, *[2 + feats.index(f) for f in few], *[2 + len(feats) + feats.index(f) for f in few]]
        entries = [at[min(cols[i], cols[j]), max(cols[i], cols[j])] for i in range(len(cols)) for j in range(i, len(cols))]
        part = lambda c: F.transform(F.array(*[F.lit(int(e)) for e in entries]), lambda e: F.get(c, e)).alias(c)
        out[name] = ridge_coefficients(stats.select("season", part("xx"), part("plain")), "season", meds, few, alpha)
    return out


MODEL = ["med", "coef", "mean", "sd", "intercept", "y_sd"]


def allowed_seasons(df: DataFrame, min_train: int) -> DataFrame:
    """Seasons that may be predicted, with their index (one row per season)."""
    order = Window.partitionBy().orderBy("season")
    return df.select("season").distinct().withColumn("_i", F.row_number().over(order) - 1).where(F.col("_i") >= min_train)


def _refit_rows(train: DataFrame, model: DataFrame, all_seasons: DataFrame, decay: float | None) -> DataFrame:
    """Training rows paired with every later season's model inside the map stage (the models are one
    row per season); `_w` is the season weight. Reduced to sums before any shuffle."""
    idx = all_seasons.select("season", F.row_number().over(Window.partitionBy().orderBy("season")).alias("_n"))       # one row per season
    m = model.join(idx, "season").withColumnsRenamed({"season": "for_season", "_n": "_to"})
    e = train.join(F.broadcast(idx), "season").join(F.broadcast(m), F.col("season") < F.col("for_season"))
    w = F.lit(1.0) if decay is None else F.pow(F.lit(decay), F.greatest(F.col("_to") - F.col("_n") - 1, F.lit(0)))
    return e.withColumn("_w", w).drop("_n", "_to")


def _spread_models(res: DataFrame, feats: list[str], meds: DataFrame | None, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Ridge on log(res^2 + 1) per refit, and the factor that makes standardised residuals unit."""
    res = res.withColumn("_log", F.log(F.col("_res") * F.col("_res") + 1))
    v = cross_products(res, ["for_season"], feats, "_log", F.col("_w")).withColumnRenamed("for_season", "season")
    m = ridge_coefficients(v, "season", meds, feats, alpha)
    b = F.broadcast(m.withColumnRenamed("season", "for_season"))             # one row per season
    scale = (res.join(b, "for_season").withColumn("_raw", F.exp(linear_prediction(feats))).groupBy(F.col("for_season").alias("season"))
             .agg(F.sqrt(F.avg(F.col("_res") * F.col("_res") / F.col("_raw"))).alias("_scale")))
    return m, cut_lineage(scale)


def _predict(p: DataFrame, model: DataFrame, out: str, value: Column) -> DataFrame:
    return p.join(F.broadcast(model), "season").withColumn(out, value).drop(*MODEL)                # one row per season


def walk_forward(df: DataFrame, mean_feats: list[str], var_feats: list[str], alpha: float = 50.0,
                 min_train: int = 2, decay: float | None = None, close: str | None = None) -> DataFrame:
    """Train on seasons < s, predict s: mean and spread of the residual, and the market-only
    reference. df needs season, resid, eligible, the features and, with `close`, `move`.

    Means come from summed cross products. The spread model's target depends on each refit, so
    training rows are paired with the (few) later seasons they serve inside the map stage and reduce
    to cross products again before any shuffle.

    close="target"  : the mean is the predicted open-to-close move plus the mean leftover residual
    close="feature" : the predicted move enters the mean model as one more feature
    """
    train = df.where("eligible")
    everything = cut_lineage(df.select("season").distinct())                  # one row per season
    allowed = allowed_seasons(everything, min_train)
    meds = medians_of_earlier_seasons(train, "season", list(dict.fromkeys(mean_feats + var_feats)))
    mkt = ridge_coefficients(earlier_sums(cross_products(train, ["season"], [], "resid"), "season"), "season", None, [], alpha)
    first_target = "resid" if close is None else "move"
    fit_rows = train if close is None else train.where(F.col("move").isNotNull())
    lead = fit_mean_models(fit_rows, mean_feats, first_target, alpha, decay).join(F.broadcast(allowed.select("season")), "season", "left_semi")
    e = _refit_rows(train, lead, everything, decay).withColumn("_mu", linear_prediction(mean_feats)).drop(*MODEL)
    p = _predict(df, lead, "mu", linear_prediction(mean_feats))
    if close == "target":
        shift = e.groupBy(F.col("for_season").alias("season")).agg(F.avg(F.col("resid") - F.col("_mu")).alias("_shift"))
        e = e.join(F.broadcast(shift.withColumnRenamed("season", "for_season")), "for_season").withColumn("_mu", F.col("_mu") + F.col("_shift"))
        p = p.join(F.broadcast(shift), "season").withColumn("mu", F.col("mu") + F.col("_shift")).drop("_shift")
    elif close == "feature":
        feats = mean_feats + ["mu_move"]
        e, p = e.withColumnRenamed("_mu", "mu_move"), p.withColumnRenamed("mu", "mu_move")
        s = cross_products(e, ["for_season"], feats, "resid", F.col("_w")).withColumnRenamed("for_season", "season")
        m2 = ridge_coefficients(s, "season", meds.withColumn("med_mu_move", F.lit(0.0)), feats, alpha)
        e = e.join(F.broadcast(m2.withColumnRenamed("season", "for_season")), "for_season").withColumn("_mu", linear_prediction(feats)).drop(*MODEL)
        p = _predict(p, m2, "mu", linear_prediction(feats))
    spread_m, scale = _spread_models(e.withColumn("_res", F.col("resid") - F.col("_mu")), var_feats, meds, alpha)
    p = _predict(p, spread_m, "_raw", F.exp(linear_prediction(var_feats)))
    p = p.join(F.broadcast(scale), "season").withColumn("sd", F.sqrt("_raw") * F.col("_scale")).drop("_raw", "_scale")
    m = mkt.select("season", F.col("intercept").alias("mu_mkt"), F.col("y_sd").alias("sd_mkt"))
    return p.join(F.broadcast(m), "season")


# ------------------------------------------------------------------ points forecast
def spread_by_level(df: DataFrame, keys: list[str], mu: str, resid: str, weight: str, bins: int = 20) -> DataFrame:
    """sd = a + b sqrt(mu), fitted on the residual spread of equal-frequency bins of the forecast; `weight` counts equal rows."""
    from slatemill.operators.metrics import quantile_bins

    w, r = F.when(F.col(resid).isNotNull(), F.col(weight)), F.col(resid)
    b = quantile_bins(df, keys, mu, bins, weight).groupBy(*keys, "bin").agg(
        F.sum(w).alias("n"), F.sum(w * r).alias("s1"), F.sum(w * r * r).alias("s2"), F.sqrt(F.sum(F.col(weight) * F.col(mu)) / F.sum(weight)).alias("x"))
    b = b.withColumn("s", F.sqrt(F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0))))
    return b.groupBy(*keys).agg(F.regr_intercept("s", "x").alias("a"), F.regr_slope("s", "x").alias("b"))


def level_forecasts(p: DataFrame, outcome: str, mu: str, line: str) -> DataFrame:
    """Spread and chance of more than a line for out-of-sample forecasts. A season's spread (by level) and residual shape come
    from the forecasts of earlier seasons alone, each of which was made before its own season; a season with none drops out.
    Rows of equal season, forecast and residual are counted before they are repeated for later seasons, and a chance is
    worked out once per season, forecast and line. p: season, outcome, mu, line. Adds sd and p_over."""
    seasons = p.select(F.col("season").alias("for_season")).distinct()                       # one row per season
    counted = cut_lineage(p.groupBy("season", mu, (F.col(outcome) - F.col(mu)).alias("_res")).agg(F.count("*").alias("_n")))
    past = counted.join(F.broadcast(seasons), F.col("season") < F.col("for_season")).drop("season")
    level = F.broadcast(cut_lineage(spread_by_level(past, ["for_season"], mu, "_res", "_n")))      # one row per season
    sd = F.col("a") + F.col("b") * F.sqrt(mu)
    z = past.join(level, "for_season").select("for_season", (F.col("_res") / sd).alias("_z"), "_n")
    asked = p.select(F.col("season").alias("for_season"), mu, line).distinct().join(level, "for_season").withColumn("sd", sd)
    asked = cut_lineage(asked.withColumn("_z", (F.col(line) - F.col(mu)) / F.col("sd")).drop("a", "b"))
    over = asked.join(empirical_exceedance(z, asked, ["for_season"], "_z", weight="_n").withColumnRenamed("p", "p_over"), ["for_season", "_z"])
    return p.join(over.select(F.col("for_season").alias("season"), mu, line, "sd", "p_over"), ["season", mu, line])


def empirical_exceedance(hist: DataFrame, asks: DataFrame, keys: list[str], z: str, reach: float = 64.0, weight: str | None = None) -> DataFrame:
    """P(Z > z) from a sample per key: rows (keys, z, p). Residuals are mapped to [0, 1] for the
    chunked count (values beyond +-reach share the end chunks, which stays exact). `weight` counts rows of the
    sample that the caller has already added up."""
    from slatemill.operators.running import counts_below

    unit = lambda d: d.withColumn("_u", (F.col(z) + reach) / (2 * reach))
    a = unit(asks.select(*keys, z).distinct()).withColumns({"closed": F.lit(True), "id": F.col(z).cast("string")})
    c = counts_below(unit(hist).withColumn("_one", F.lit(1.0)), a, keys, "_u", "_one", weight)
    n = hist.groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    j = c.join(n, keys) if keys else c.join(F.broadcast(n))                               # no keys: one row
    return j.select(*keys, F.col("id").cast("double").alias(z), (1 - F.col("below") / F.col("n")).alias("p"))


def information_test(df: DataFrame, y: str, base: Column, model: Column) -> DataFrame:
    """Logit of the outcome on two forecasts: how much the model adds to the market, with standard
    errors (columns term, weight, se)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GeneralizedLinearRegression

    from slatemill.functions.probability import logit

    d = df.select(F.col(y).cast("double").alias("label"), array_to_vector(F.array(logit(base), logit(model) - logit(base))).alias("features"))
    m = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-10).fit(d)
    se = m.summary.coefficientStandardErrors
    rows = [("market", float(m.coefficients[0]), float(se[0])), ("model_minus_market", float(m.coefficients[1]), float(se[1])), ("intercept", float(m.intercept), float(se[2]))]
    return df.sparkSession.createDataFrame(rows, "term string, weight double, se double")


def out_of_sample_gain(df: DataFrame, base: list[str], extra: list[str], target: str = "resid") -> DataFrame:
    """Mean squared error with and without extra features, each season predicted from earlier ones,
    plus a pooled row (least squares is a ridge with no penalty)."""
    m0 = fit_mean_models(df, base, target, 1e-9)
    m1 = fit_mean_models(df, base + extra, target, 1e-9)
    p = _predict(_predict(df, m0, "p0", linear_prediction(base)), m1, "p1", linear_prediction(base + extra))
    sq = lambda c: F.avg((F.col(target) - F.col(c)) ** 2)
    g = p.rollup("season").agg(F.grouping_id().alias("_all"), F.count("*").alias("n"), sq("p0").alias("mse_base"), sq("p1").alias("mse_full"))
    return g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("season").cast("string")).alias("season"), "n", "mse_base", "mse_full",
                    (100 * (1 - F.col("mse_full") / F.col("mse_base"))).alias("reduction_pct"))


# ------------------------------------------------------------------ residual shape
def student_t_df(z: DataFrame, by: list[str], col: str, grid: list[float]) -> DataFrame:
    """Degrees of freedom of a unit-scale t by likelihood over a grid: one pass, one sum per value.
    Constants of the density come from lgamma on the (short) grid."""
    import math

    logs = [F.sum(F.lit(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi))
                  - F.lit((v + 1) / 2) * F.log1p(F.col(col) * F.col(col) / v)) for v in grid]
    pick = F.array(*[F.struct(s.alias("ll"), F.lit(v).alias("df")) for s, v in zip(logs, grid)])
    g = z.groupBy(*by).agg(F.array_max(pick).alias("best"))
    return g.select(*by, F.col("best.df").alias("t_df"), F.col("best.ll").alias("log_likelihood"))
