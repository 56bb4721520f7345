"""Probability calibration from earlier out-of-sample predictions only."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip
from slatemill.functions.probability import beta_quantile, logit
from slatemill.operators.running import counts_below, grid_quantiles, running_max, running_total
from slatemill.session import cut_lineage

# Buffers of the pseudo-bets and the one-sided 95% normal quantile.
BUFFERS = [-6, -3, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18]
Z95 = 1.6449
TERMS = {"base": 5, "side": 6, "side_buffer": 8}
FEW_CELLS = 10_000      # distinct forecasts and fractions up to which equal games of a date are counted before they become bets


# ------------------------------------------------------------------ edge-aware latent calibrator
def pseudo_bets(hist: DataFrame) -> DataFrame:
    """Every game as 40 bets: both sides at 20 buffers from the half-point grid (no pushes)."""
    bets = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(float(k)).alias("k")) for s in (1, -1) for k in BUFFERS])
    d = hist.withColumn("_b", F.explode(bets)).select("*", "_b.*").drop("_b")
    thr = F.floor("line") + 0.5 - F.col("side") * F.col("k")
    return d.withColumns({"s_model": F.col("side") * F.col("mu") / F.col("sd"), "s_buf": F.col("side") * (F.col("line") - thr) / F.col("sd"),
                          "win": (F.col("side") * (F.col("outcome") - thr) > 0).cast("double")})


def _type(df: DataFrame, name: str) -> str:
    """Type of a column as schema text; seasons may be years or texts such as 2015-16."""
    return df.schema[name].dataType.simpleString()


def design(terms: str, s_model: Column, s_buf: Column, side: Column) -> list[Column]:
    x = [F.lit(1.0), s_model, s_buf, s_buf * s_buf, s_model * s_buf]
    if terms in ("side", "side_buffer"):
        x.append(side.cast("double"))
    if terms == "side_buffer":
        x += [side * s_buf, side * s_buf * s_buf]
    return x


def fit_latent(preds: DataFrame, seed_seasons: int = 2, terms: str = "base", decay: float | None = None,
               mu: str = "mu", sd: str = "sd", max_steps: int = 50) -> DataFrame:
    """Weighted logistic fit of pseudo-bet wins for each season on all earlier seasons, with a
    date-clustered sandwich covariance: rows (season, beta, v).

    Newton steps are the only driver loop: each is one aggregate giving, for all seasons together,
    a gradient and a Hessian (a few dozen numbers per season). What a bet expects depends on the forecast and on the
    fraction of the line alone, so steps run over the distinct ones with their counts, and what was won, which no step changes,
    is summed once. Pass predictions whose lineage is already cut: rows are read for the cells, the wins and the covariance.
    """
    rows = preds.where("eligible").select("season", "date", "line", "outcome", F.col(mu).alias("mu"), F.col(sd).alias("sd"))
    seasons = sorted(r[0] for r in preds.select("season").distinct().collect())       # short list of years
    targets = seasons[seed_seasons:]
    idx = F.create_map(*[F.lit(v) for i, s in enumerate(seasons) for v in (s, i)])
    later = F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: t > F.col("season"))
    k = TERMS[terms]

    def bets(of: DataFrame, *keep: str) -> DataFrame:
        x = design(terms, F.col("s_model"), F.col("s_buf"), F.col("side"))
        return pseudo_bets(of).select(*keep, *[c.alias(f"x{i}") for i, c in enumerate(x)])

    def fitted(of: DataFrame) -> DataFrame:
        """Once for every later season, with the weight there."""
        age = idx[F.col("fit")] - idx[F.col("season")]
        return of.withColumn("fit", F.explode(later)).withColumn("w", F.lit(1.0) if decay is None else F.pow(F.lit(decay), F.greatest(age - 1, F.lit(0))))

    cols = [F.col(f"x{i}") for i in range(k)]
    beta = {s: np.zeros(k) for s in targets}
    # a whole line less changes no bet
    whole = F.floor("line")
    rows = rows.where("outcome IS NOT NULL").withColumns({"line": F.col("line") - whole, "outcome": F.col("outcome") - whole, "n": F.lit(1)})
    cells = rows.groupBy("season", "line", "mu", "sd").agg(F.count("*").alias("n"))
    # small in bytes, heavy in work: a fixed number of tasks
    tasks = 4 * preds.sparkSession.sparkContext.defaultParallelism
    cells = cut_lineage(cells.repartition(tasks, "line", "mu", "sd"))
    if cells.count() <= FEW_CELLS:
        rows = rows.groupBy("season", "date", "line", "outcome", "mu", "sd").agg(F.count("*").alias("n"))
        rows = cut_lineage(rows.repartition(tasks, "date", "outcome"))
    d = fitted(bets(cells.withColumn("outcome", F.lit(0.0)), "season", "n")).withColumn("w", F.col("w") * F.col("n"))
    won = bets(rows, "season", "win", "n").groupBy("season").agg(*[F.sum(F.col("n") * F.col("win") * c).alias(f"x{i}") for i, c in enumerate(cols)])
    won = fitted(cut_lineage(won)).groupBy("fit").agg(F.array(*[F.sum(F.col("w") * c) for c in cols]).alias("g"))
    won = {r["fit"]: np.array(r["g"], float) for r in won.collect()}                  # one row per season

    def eta() -> Column:
        coef = F.create_map(*[v for s in targets for v in (F.lit(s), F.array(*[F.lit(float(b)) for b in beta[s]]))])[F.col("fit")]
        out = coef[0] * cols[0]
        for i in range(1, k):
            out = out + coef[i] * cols[i]
        return out

    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def hessians() -> dict:
        e = d.withColumn("p", 1 / (1 + F.exp(-eta())))
        q = F.col("w") * F.col("p") * (1 - F.col("p"))
        g = e.groupBy("fit").agg(F.array(*[F.sum(q * cols[i] * cols[j]) for i, j in upper]).alias("h"),
                                 F.array(*[F.sum(F.col("w") * F.col("p") * c) for c in cols]).alias("g"))
        out = {}
        for r in g.collect():                                                         # one row per season
            h = np.zeros((k, k))
            for (i, j), v in zip(upper, r["h"]):
                h[i, j] = h[j, i] = v
            out[r["fit"]] = (h, won[r["fit"]] - np.array(r["g"], float))
        return out

    for _ in range(max_steps):
        biggest = 0.0
        for s, (h, g) in hessians().items():
            step = np.linalg.solve(h + 1e-6 * np.eye(k), g)
            beta[s] = beta[s] + step
            biggest = max(biggest, float(np.abs(step).max()))
        if biggest < 1e-8:
            break
    else:
        raise RuntimeError(f"the latent fit still moved by {biggest} after {max_steps} steps")
    final = hessians()
    e = fitted(bets(rows, "season", "date", "win", "n")).withColumn("r", F.col("w") * F.col("n") * (F.col("win") - 1 / (1 + F.exp(-eta()))))
    score = e.groupBy("fit", "date").agg(*[F.sum(F.col("r") * c).alias(f"g{i}") for i, c in enumerate(cols)])
    meat = score.groupBy("fit").agg(F.array(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")) for i, j in upper]).alias("m"))
    table = []
    for r in meat.collect():                                                          # one row per season
        m = np.zeros((k, k))
        for (i, j), v in zip(upper, r["m"]):
            m[i, j] = m[j, i] = v
        inv = np.linalg.inv(final[r["fit"]][0])
        table.append((r["fit"], [float(b) for b in beta[r["fit"]]], [float(v) for v in (inv @ m @ inv).ravel()]))
    return preds.sparkSession.createDataFrame(table, f"season {_type(preds, 'season')}, beta array<double>, v array<double>")


def add_latent_probability(df: DataFrame, out: str, s_model: Column, s_buf: Column, side: Column, terms: str = "base",
                           z: float | None = Z95) -> DataFrame:
    """Adds the calibrated probability and, with z, its one-sided lower bound `<out>_cons`.
    df carries the season's `beta` and `v`."""
    d = df.withColumns({"_sm": s_model, "_sb": s_buf, "_sd": side})
    x = design(terms, F.col("_sm"), F.col("_sb"), F.col("_sd"))
    k = len(x)
    eta = sum((F.col("beta")[i] * x[i] for i in range(1, k)), F.col("beta")[0] * x[0])
    var = F.lit(0.0)
    if z is not None:
        for i in range(k):
            for j in range(i, k):
                var = var + (1 if i == j else 2) * F.col("v")[i * k + j] * x[i] * x[j]
    d = d.withColumns({"_eta": eta, "_se": F.sqrt(var)})
    d = d.withColumn(out, 1 / (1 + F.exp(-F.col("_eta"))))
    if z is not None:
        d = d.withColumn(f"{out}_cons", 1 / (1 + F.exp(-(F.col("_eta") - z * F.col("_se")))))
    return d.drop("_sm", "_sb", "_sd", "_eta", "_se")


# ------------------------------------------------------------------ Platt and isotonic maps
def _newton(compact: DataFrame, targets: list, steps: int = 60) -> dict:
    """Two-parameter logistic fits with unit penalty on the slope, all `targets` in one aggregate a step until each stands
    still. compact: fits (the targets a row serves), x, n, s (rows and hits at x)."""
    beta = {t: (1.0, 0.0) for t in targets}
    moving = set(targets)
    for _ in range(steps):
        if not moving:
            return beta
        d = compact.withColumn("fit", F.explode(F.filter("fits", lambda f: f.isin(*sorted(moving)))))
        m = F.create_map(*[v for t in sorted(moving) for v in (F.lit(t), F.array(*map(F.lit, beta[t])))])[F.col("fit")]
        e = d.withColumn("q", 1 / (1 + F.exp(-(m[0] * F.col("x") + m[1]))))
        x, w, r = F.col("x"), F.col("n") * F.col("q") * (1 - F.col("q")), F.col("s") - F.col("n") * F.col("q")
        rows = e.groupBy("fit").agg(*[F.sum(c).alias(k) for k, c in (("hxx", w * x * x), ("hx", w * x), ("h", w), ("gx", r * x), ("g", r))]).collect()     # one row a fit
        moving &= {k["fit"] for k in rows}          # a fit without rows stays at the start
        for k in rows:
            a, b = beta[k["fit"]]
            step = np.linalg.solve(np.array([[k["hxx"] + 1.0, k["hx"]], [k["hx"], k["h"] + 1e-12]]), np.array([k["gx"] - a, k["g"]]))
            beta[k["fit"]] = (float(a + step[0]), float(b + step[1]))
            if np.abs(step).max() < 1e-10:
                moving.discard(k["fit"])
    raise RuntimeError(f"the logistic fits of {sorted(moving)} still moved after {steps} steps")


def fit_platt(hist: DataFrame, p: str, y: str) -> tuple[float, float]:
    """Logistic map of the logit with unit inverse penalty: (slope, intercept). One pass counts rows and hits per
    distinct forecast; the steps read only these."""
    d = hist.groupBy(logit(F.col(p)).alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    return _newton(cut_lineage(d.withColumn("fits", F.array(F.lit(0)))), [0])[0]


def platt(p: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(slope * logit(p) + intercept)))


def platt_by_season(preds: DataFrame, p: str, y: str, seed_seasons: int = 2, steps: int = 60) -> DataFrame:
    """Platt map of every season on earlier seasons' predictions: rows (season, slope, icept). A
    two-parameter logistic with unit penalty on the slope. One pass counts rows and hits per season and distinct
    forecast; all seasons that still move share each Newton step over these."""
    seasons = sorted(r[0] for r in preds.select("season").distinct().collect())           # short list of years
    targets = seasons[seed_seasons:]
    later = F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: t > F.col("season"))
    d = preds.where("eligible").groupBy("season", logit(F.col(p)).alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    beta = _newton(cut_lineage(d.withColumn("fits", later)), targets, steps)
    return preds.sparkSession.createDataFrame([(s, a, b) for s, (a, b) in beta.items()], f"season {_type(preds, 'season')}, slope double, icept double")


def walk_forward_calibrated(preds: DataFrame, p: str, y: str, q: float = 0.05, seed_seasons: int = 2) -> DataFrame:
    """Calibrated and conservative probability of each season from earlier seasons' predictions.
    preds: season, eligible, p, y. Adds p_cal and p_cons; seed seasons drop out."""
    m = platt_by_season(preds, p, y, seed_seasons)
    b = F.broadcast(m)                                                                  # one row per season
    cal = 1 / (1 + F.exp(-(F.col("slope") * logit(F.col(p)) + F.col("icept"))))
    out = preds.join(b, "season").withColumn("p_cal", cal).drop("slope", "icept")
    hist = preds.where("eligible").withColumnRenamed("season", "_s").join(F.broadcast(m), F.col("_s") < F.col("season")).withColumn("p_cal", cal)
    bound = neighbourhood_bound(hist, out, ["season"], "p_cal", y, q=q)
    return out.join(bound.select("season", F.col("p").alias("p_cal"), F.col("bound").alias("p_cons")), ["season", "p_cal"], "left")


def fit_isotonic(hist: DataFrame, p: str, y: str):
    """Monotone map. Equal forecasts are merged to one weighted row first, so the model sees distinct
    forecast values, not rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    d = hist.groupBy(F.col(p).alias("x")).agg(F.avg(y).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(weightCol="weight").fit(d.withColumn("features", array_to_vector(F.array("x"))))


def isotonic(df: DataFrame, model, p: str, out: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    d = model.setPredictionCol("_iso").transform(df.withColumn("features", array_to_vector(F.array(p))))
    return d.withColumn(out, clip(F.col("_iso"), 0.01, 0.99)).drop("features", "_iso")


# ------------------------------------------------------------------ neighbourhood lower bound
def neighbourhood_bound(hist: DataFrame, asks: DataFrame, keys: list[str], p: str, win: str, width: float = 0.02,
                        min_n: int = 30, q: float = 0.05) -> DataFrame:
    """q-quantile of Beta(1 + wins, 1 + losses) over history within +-width of each distinct asked
    probability; thin neighbourhoods widen downward to `min_n` rows. Counting uses one shared axis
    per key (see counts_below), so no history is gathered. Rows (keys, p, n, wins, bound)."""
    a = asks.select(*keys, F.col(p).alias("p")).distinct()
    ident = F.col("p").cast("string")
    edges = a.select(*keys, F.explode(F.array(
        F.struct((F.col("p") - width).alias(p), F.lit(False).alias("closed"), F.concat(F.lit("L"), ident).alias("id")),
        F.struct((F.col("p") + width).alias(p), F.lit(True).alias("closed"), F.concat(F.lit("H"), ident).alias("id")))).alias("e")).select(*keys, "e.*")
    c = counts_below(hist, edges, keys, p, win)
    c = c.withColumn("p", F.substring("id", 2, 64).cast("double")).withColumn("edge", F.substring("id", 1, 1))
    side = lambda e, v: F.max(F.when(F.col("edge") == e, F.col(v)))
    g = c.groupBy(*keys, "p").agg(side("L", "below").alias("lo"), side("H", "below").alias("hi"),
                                  side("L", "below_value").alias("wlo"), side("H", "below_value").alias("whi"))
    g = g.withColumn("start", F.when(F.col("hi") - F.col("lo") < min_n, F.greatest(F.col("hi") - min_n, F.lit(0))).otherwise(F.col("lo")))
    # wins below the widened start, looked up on the rank axis of distinct values (ties share their mean)
    d = hist.groupBy(*keys, F.col(p).alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(win).cast("double").alias("w"))
    chunk = F.floor(F.least(F.greatest("x", F.lit(0.0)), F.lit(1.0)) * 512)
    r = running_total(running_total(d, keys, chunk, ["x"], "n", "cn"), keys, chunk, ["x"], "w", "cw")
    # the value whose rows hold the start: laid on one axis of row positions, it is the last one before
    first = F.col("cn") - F.col("n")
    held = r.select(*keys, first.cast("double").alias("pos"), F.lit(0).alias("ask"), F.lit(None).cast("double").alias("p"),
                    F.struct(first.cast("double").alias("c0"), (F.col("cw") - F.col("w")).alias("w0"), "n", "w").alias("v"))
    asked = g.where(F.col("start") < F.col("lo")).select(*keys, F.col("start").cast("double").alias("pos"), F.lit(1).alias("ask"), "p",
                                                       F.lit(None).cast(held.schema["v"].dataType).alias("v"))
    axis = running_max(held.unionByName(asked), keys, F.floor(F.col("pos") / 4096), ["pos", "ask"], "v", "at").where("ask = 1")
    hit = axis.select(*keys, "p", (F.col("at.w0") + (F.col("pos") - F.col("at.c0")) * F.col("at.w") / F.col("at.n")).alias("wst"))
    g = g.join(hit, keys + ["p"], "left").withColumn("wins", F.col("whi") - F.coalesce("wst", "wlo")).withColumn("n", F.col("hi") - F.col("start"))
    pairs = g.select("wins", "n").distinct().withColumn("bound", F.when(F.col("n") > 0, beta_quantile(q, 1 + F.col("wins"), 1 + F.col("n") - F.col("wins"))).otherwise(0.0))
    return g.join(pairs, ["wins", "n"]).select(*keys, "p", "n", "wins", "bound")


# ------------------------------------------------------------------ PIT calibrator
def pit_knots(hist: DataFrame, keys: list[str], u: str, knots: int = 200) -> DataFrame:
    """G as `knots` + 1 exact quantiles of past CDF values per key: two short arrays."""
    g = grid_quantiles(hist, keys, u, knots)
    g = g.groupBy(*keys, "q").agg(F.min("i").alias("i"))              # repeated quantiles keep the first
    a = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("q").alias("x"), (F.col("i") / knots).alias("y")))).alias("k"))
    ends = lambda v: F.struct(F.lit(v).alias("x"), F.lit(v).alias("y"))
    return a.select(*keys, F.concat(F.array(ends(0.0)), "k", F.array(ends(1.0))).alias("knots"))


def pit_map(u: Column, knots: Column) -> Column:
    """Linear interpolation of G at u."""
    v = clip(u, 0.0, 1.0)
    lo = F.array_max(F.filter(knots, lambda k: k["x"] <= v))
    hi = F.array_min(F.filter(knots, lambda k: k["x"] > v))
    return F.when(hi.isNull(), lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (v - lo["x"]) / (hi["x"] - lo["x"]))


def pit_bounds(hist: DataFrame, asks: DataFrame, keys: list[str], u: str, q: float = 0.05) -> DataFrame:
    """One-sided Beta bounds on G at each distinct u: rows (keys, u, lo, hi)."""
    a = asks.select(*keys, F.col(u)).distinct()
    c = counts_below(hist.withColumn("_one", F.lit(1.0)), a.withColumns({"closed": F.lit(True), "id": F.col(u).cast("string")}), keys, u, "_one")
    n = hist.groupBy(*keys).agg(F.count("*").alias("n"))
    j = c.join(n, keys) if keys else c.join(F.broadcast(n))                         # no keys: one row
    pairs = j.select(F.col("below").alias("k"), "n").distinct()
    pairs = pairs.withColumns({"lo": beta_quantile(q, F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5),
                               "hi": beta_quantile(1 - q, F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5)})
    return j.join(pairs, (j["below"] == pairs["k"]) & (j["n"] == pairs["n"])).select(*keys, F.col("id").cast("double").alias(u), "lo", "hi")
