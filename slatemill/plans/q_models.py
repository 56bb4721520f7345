"""Queries for walk-forward models, ratings and calibration."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.operators import boosting, calibrate, models, ratings
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import CTES, box, forecasts, games, with_
from slatemill.session import cut_lineage

MEAN_FEATS = ["f_home", "f_away", "f_move", "f_rest"]
VAR_FEATS = ["f_spread", "f_home"]

CTES["train"] = (("games",), """SELECT game_key, league, season, date, line_open AS line, line_close, total AS outcome, total - line_open AS resid, game_key % 10 <> 0 AS eligible,
  CAST(home % 5 AS DOUBLE) AS f_home, CAST(away % 5 AS DOUBLE) AS f_away, CASE WHEN ok_close THEN line_close - line_open END AS f_move,
  CAST(game_key % 4 AS DOUBLE) AS f_rest, abs(home_spread_close) AS f_spread FROM games WHERE ok_open""")


def training(spark, sf):
    g, d = games(spark, sf).where("ok_open"), lambda c: (F.col(c) % 5).cast("double")
    return g.select("game_key", "league", "season", "date", F.col("line_open").alias("line"), "line_close", F.col("total").cast("double").alias("outcome"),
                    (F.col("total") - F.col("line_open")).alias("resid"), (F.col("game_key") % 10 != 0).alias("eligible"), d("home").alias("f_home"), d("away").alias("f_away"),
                    F.when(F.col("ok_close"), F.col("line_close") - F.col("line_open")).alias("f_move"), (F.col("game_key") % 4).cast("double").alias("f_rest"), F.abs("home_spread_close").alias("f_spread"))


# M5
@query("market_only", with_("train", "").rstrip() + f""", s AS (SELECT DISTINCT season FROM train) SELECT s.season, count(*) AS n, {reals(mu='avg(t.resid)', sd='stddev_pop(t.resid)')} FROM s JOIN train t ON t.season < s.season AND t.eligible GROUP BY 1""")
def market_only(spark, sf):
    """Prefix mean and spread per season from per-season sums."""
    t = training(spark, sf).where("eligible").withColumn("one", F.lit(1.0))
    st = models.earlier_sums(models.cross_products(t, ["season"], [], "resid"), "season")
    m = models.ridge_coefficients(st, "season", None, [], 1.0)
    return m.join(st.select("season", F.col("xx")[0].cast("long").alias("n")), "season").select("season", "n", F.col("intercept").alias("mu"), F.col("y_sd").alias("sd"))


# M1: the slope of a one-feature ridge has a closed form in SQL
@query("ridge_one_feature", with_("train", "").rstrip() + f""", s AS (SELECT DISTINCT season FROM train), a AS (SELECT s.season, count(*) AS n, avg(f_home) AS mx, stddev_pop(f_home) AS sx, avg(resid) AS my, covar_pop(f_home, resid) AS c FROM s JOIN train t ON t.season < s.season AND t.eligible GROUP BY 1)
  SELECT season, {reals(coef='n * (c / sx) / (n + 50.0)', mean='mx', sd='sx', intercept='my')} FROM a""")
def ridge_one_feature(spark, sf):
    m = models.fit_mean_models(training(spark, sf).where("eligible"), ["f_home"])
    return m.select("season", F.col("coef")[0].alias("coef"), F.col("mean")[0].alias("mean"), F.col("sd")[0].alias("sd"), "intercept")


# M1 on several features, medians filled, against the normal equations
@query("ridge_coefficients")
def ridge_coefficients(spark, sf):
    m = models.fit_mean_models(training(spark, sf).where("eligible"), MEAN_FEATS)
    return m.select("season", "intercept", *[F.col("coef")[i].alias(f"c_{f}") for i, f in enumerate(MEAN_FEATS)])


# M15
@query("feature_contributions", with_("train", "").rstrip() + f""", s AS (SELECT DISTINCT season FROM train), a AS (SELECT s.season, count(*) AS n, stddev_pop(f_home) AS sx, median(f_home) AS md, covar_pop(f_home, resid) AS c FROM s JOIN train t ON t.season < s.season AND t.eligible GROUP BY 1)
  SELECT game_key, {reals(c_f_home='n * (c / sx) / (n + 50.0) * (f_home - md) / sx')} FROM train JOIN a USING (season)""")
def feature_contributions(spark, sf):
    t = training(spark, sf)
    m = models.fit_mean_models(t.where("eligible"), ["f_home"])
    return t.join(F.broadcast(m), "season").withColumns(models.contribution_columns(["f_home"])).select("game_key", "c_f_home")   # one row per season


# M1, M2, M5, M12
def predictions(spark, sf):
    return models.walk_forward(training(spark, sf), MEAN_FEATS, VAR_FEATS)


@query("walk_forward")
def walk_forward(spark, sf):
    return predictions(spark, sf).select("game_key", "season", "mu", "sd", "mu_mkt", "sd_mkt")


# M1, M2, M5, M12 with one feature each, where every fit has a closed form: the same operator, row by row
def _one_feature_sql(target: bool) -> str:
    """Mean on f_home (of the move, with the mean leftover, if `target`), spread on f_spread, market reference."""
    y, rows = ("f_move", "AND t.f_move IS NOT NULL") if target else ("resid", "")
    shift = "avg(t.resid - (my + n * (c / sx) / (n + 50.0) * (t.f_home - mx) / sx))" if target else "0.0"
    return f"""{{head}}, ss AS (SELECT season, row_number() OVER (ORDER BY season) - 1 AS i FROM (SELECT DISTINCT season FROM train)), s AS (SELECT season FROM ss WHERE i >= 2),
  a AS (SELECT s.season, count(*) AS n, avg(f_home) AS mx, stddev_pop(f_home) AS sx, avg({y}) AS my, covar_pop(f_home, {y}) AS c FROM s JOIN train t ON t.season < s.season AND t.eligible {rows} GROUP BY 1),
  sh AS (SELECT a.season, {shift} AS shift FROM a JOIN train t ON t.season < a.season AND t.eligible GROUP BY a.season{', my, n, c, sx, mx' if not target else ''}),
  e AS (SELECT a.season, t.f_spread AS g, t.resid - (my + n * (c / sx) / (n + 50.0) * (t.f_home - mx) / sx + shift) AS r FROM a JOIN sh USING (season) JOIN train t ON t.season < a.season AND t.eligible),
  b AS (SELECT season, count(*) AS n, avg(g) AS mg, stddev_pop(g) AS sg, avg(ln(r * r + 1)) AS ml, covar_pop(g, ln(r * r + 1)) AS cl FROM e GROUP BY 1),
  sc AS (SELECT e.season, sqrt(avg(r * r / exp(ml + n * (cl / sg) / (n + 50.0) * (g - mg) / sg))) AS scale FROM e JOIN b USING (season) GROUP BY 1),
  m AS (SELECT s.season, avg(resid) AS mm, stddev_pop(resid) AS sm FROM s JOIN train t ON t.season < s.season AND t.eligible GROUP BY 1)
  SELECT game_key, {reals(mu='my + a.n * (c / sx) / (a.n + 50.0) * (f_home - mx) / sx + shift', sd='sqrt(exp(ml + b.n * (cl / sg) / (b.n + 50.0) * (f_spread - mg) / sg)) * scale', mu_mkt='mm', sd_mkt='sm')}
  FROM train JOIN a USING (season) JOIN sh USING (season) JOIN b USING (season) JOIN sc USING (season) JOIN m USING (season)""".replace("{head}", with_("train", "").rstrip())


@query("walk_forward_one_feature", _one_feature_sql(False))
def walk_forward_one_feature(spark, sf):
    return models.walk_forward(training(spark, sf), ["f_home"], ["f_spread"]).select("game_key", "mu", "sd", "mu_mkt", "sd_mkt")


@query("walk_forward_move_one_feature", _one_feature_sql(True))
def walk_forward_move_one_feature(spark, sf):
    t = training(spark, sf).withColumn("move", F.col("f_move"))
    return models.walk_forward(t, ["f_home"], ["f_spread"], close="target").select("game_key", "mu", "sd", "mu_mkt", "sd_mkt")


@query("out_of_sample_gain_one_feature", with_("train", "").rstrip() + f""", s AS (SELECT DISTINCT season FROM train WHERE eligible), a AS (SELECT s.season, avg(resid) AS my, avg(f_home) AS mx, covar_pop(f_home, resid) / var_pop(f_home) AS b FROM s JOIN train t ON t.season < s.season AND t.eligible GROUP BY 1),
  p AS (SELECT season, resid, my AS p0, my + b * (f_home - mx) AS p1 FROM train JOIN a USING (season) WHERE eligible), g AS (SELECT coalesce(CAST(season AS VARCHAR), 'all') AS season, count(*) AS n, avg((resid - p0) ** 2) AS m0, avg((resid - p1) ** 2) AS m1 FROM p GROUP BY ROLLUP (season))
  SELECT season, n, {reals(mse_base='m0', mse_full='m1', reduction_pct='100 * (1 - m1 / m0)')} FROM g""")
def out_of_sample_gain_one_feature(spark, sf):
    return models.out_of_sample_gain(training(spark, sf).where("eligible"), [], ["f_home"])


# M4
@query("residual_shape", with_("train", "").rstrip() + f", z AS (SELECT season, resid / 17.0 AS z FROM train WHERE eligible) SELECT season, {reals(log_likelihood='sum(-0.5 * ln(pi() * 8) + lgamma(4.5) - lgamma(4.0) - 4.5 * ln(1 + z * z / 8))')} FROM z GROUP BY 1")
def residual_shape(spark, sf):
    z = training(spark, sf).where("eligible").withColumn("z", F.col("resid") / 17.0)
    return models.student_t_df(z, ["season"], "z", [8.0]).select("season", "log_likelihood")


GRID = [3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, 50.0, 100.0, 200.0]


@query("student_t_grid", with_("train", "").rstrip() + f""", z AS (SELECT season, resid / 17.0e0 AS z FROM train WHERE eligible), l AS (SELECT season, v, sum(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi()) - (v + 1) / 2 * ln(1 + z * z / v)) AS ll FROM z, (SELECT unnest([{', '.join(f'{v}e0' for v in GRID)}]) AS v) GROUP BY 1, 2)
  SELECT season, {reals(t_df='arg_max(v, ll)', log_likelihood='max(ll)')} FROM l GROUP BY 1""")
def student_t_grid(spark, sf):
    z = training(spark, sf).where("eligible").withColumn("z", F.col("resid") / 17.0)
    return models.student_t_df(z, ["season"], "z", GRID)


# M9
@query("latent_calibrators")
def latent_calibrators(spark, sf):
    p = cut_lineage(predictions(spark, sf).select("season", "date", "line", "outcome", "mu", "sd", "eligible"))
    c = calibrate.fit_latent(p)
    return c.select("season", *[F.col("beta")[i].alias(f"b{i}") for i in range(5)], F.col("v")[0].alias("v00"))


@query("pseudo_bets", with_("train", "").rstrip() + f""", b AS (SELECT *, floor(line) + 0.5 - side * k AS thr FROM train, (VALUES (1), (-1)) s(side), (SELECT unnest({calibrate.BUFFERS}) AS k))
  SELECT season, side, count(*) AS n, {reals(win_rate='avg(CASE WHEN side * (outcome - thr) > 0 THEN 1.0 ELSE 0.0 END)', s_buf='avg(side * (line - thr) / 17.0)')} FROM b GROUP BY 1, 2""")
def pseudo_bets(spark, sf):
    t = training(spark, sf).withColumns({"mu": F.lit(1.0), "sd": F.lit(17.0)})
    return calibrate.pseudo_bets(t).groupBy("season", "side").agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"), F.avg("s_buf").alias("s_buf"))


# M6: Newton as a recursion over its two numbers; the isotonic map as the largest, over starts, of the least mean of any later end
@query("platt_isotonic", with_("forecasts", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""", f AS (SELECT p, ln(p / (1 - p)) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM forecasts GROUP BY p),
  nt AS (SELECT 0 AS i, 1.0e0 AS a, 0.0e0 AS b UNION ALL SELECT i + 1, a + (h * gx - hx * g) / (hxx * h - hx * hx), b + (hxx * g - hx * gx) / (hxx * h - hx * hx)
    FROM (SELECT i, a, b, sum(w * x * x) + 1 AS hxx, sum(w * x) AS hx, sum(w) + 1e-12 AS h, sum(r * x) - a AS gx, sum(r) AS g FROM (SELECT i, a, b, x, n * q * (1 - q) AS w, s - n * q AS r FROM (SELECT nt.*, f.*, 1 / (1 + exp(-(a * x + b))) AS q FROM nt, f WHERE i < 25)) GROUP BY i, a, b)),
  u AS (SELECT p, row_number() OVER o AS k, sum(n) OVER o AS cn, sum(s) OVER o AS cs, n, s FROM f WINDOW o AS (ORDER BY p)),
  lows AS (SELECT y.k, min((y.cs - x.cs + x.s) / (y.cn - x.cn + x.n)) OVER (PARTITION BY x.k ORDER BY y.k DESC) AS low FROM u x JOIN u y ON y.k >= x.k),
  iso AS (SELECT u.p, greatest(0.01, least(0.99, max(low))) AS v FROM lows JOIN u USING (k) GROUP BY u.p)
  SELECT doc_id, {reals(p_platt='1 / (1 + exp(-(a * ln(p / (1 - p)) + b)))', p_iso='v')} FROM forecasts JOIN iso USING (p), (SELECT a, b FROM nt WHERE i = 25)""")
def platt_isotonic(spark, sf):
    f = forecasts(spark, sf)
    slope, icept = calibrate.fit_platt(f, "p", "y")
    iso = calibrate.isotonic(f, calibrate.fit_isotonic(f, "p", "y"), "p", "p_iso")
    return iso.select("doc_id", calibrate.platt(F.col("p"), slope, icept).alias("p_platt"), "p_iso")


# M7
@query("lower_bounds_counts", with_("forecasts", "").rstrip() + """, a AS (SELECT DISTINCT lang, p FROM forecasts), c AS (SELECT a.lang, a.p, count(f.p) AS n, sum(f.y) AS wins FROM a JOIN forecasts f ON f.lang = a.lang AND f.p >= a.p - 0.2 AND f.p <= a.p + 0.2 GROUP BY 1, 2)
  SELECT lang, CASE WHEN round(p, 6) = 0 THEN 0.0 ELSE round(p, 6) END AS p, n, CAST(wins AS DOUBLE) AS wins FROM c""")
def lower_bounds_counts(spark, sf):
    f = forecasts(spark, sf)
    return calibrate.neighbourhood_bound(f, f, ["lang"], "p", "y", width=0.2, min_n=1).select("lang", "p", "n", "wins")


@query("lower_bounds")
def lower_bounds(spark, sf):
    f = forecasts(spark, sf)
    return calibrate.neighbourhood_bound(f, f, ["lang"], "p", "y")


# M8
@query("pit_map", with_("forecasts", "").rstrip() + f""", k AS (SELECT lang, quantile_cont(p, [{', '.join(f'{i}/20.0' for i in range(21))}]) AS q FROM forecasts GROUP BY 1),
  kk AS (SELECT lang, x, min(y) AS y FROM (SELECT lang, unnest(q) AS x, (generate_subscripts(q, 1) - 1) / 20.0e0 AS y FROM k) GROUP BY 1, 2 UNION ALL SELECT lang, 0.0, 0.0 FROM k UNION ALL SELECT lang, 1.0, 1.0 FROM k),
  f AS (SELECT doc_id, lang, (p + 0.1) / 1.1 AS u FROM forecasts), j AS (SELECT doc_id, u, max(x) FILTER (x <= u) AS x0, arg_max(y, x) FILTER (x <= u) AS y0, min(x) FILTER (x > u) AS x1, arg_min(y, x) FILTER (x > u) AS y1 FROM f JOIN kk USING (lang) GROUP BY 1, 2)
  SELECT doc_id, {reals(g='coalesce(y0 + (y1 - y0) * (u - x0) / (x1 - x0), y0)')} FROM j""")
def pit_map(spark, sf):
    f = forecasts(spark, sf)
    k = calibrate.pit_knots(f, ["lang"], "p", 20)
    return f.join(F.broadcast(k), "lang").select("doc_id", calibrate.pit_map((F.col("p") + 0.1) / 1.1, F.col("knots")).alias("g"))    # 23 knots per language


@query("pit_bounds")
def pit_bounds(spark, sf):
    f = forecasts(spark, sf)
    return calibrate.pit_bounds(f, f, ["lang"], "p")


# M10, D15
def rated_games(spark, sf):
    poss = box(spark, sf).where("side = 'home'").select("game_key", "poss")
    return games(spark, sf).select("game_key", "league", "season", "date", "home", "away", "neutral", "home_pts", "away_pts", "total", F.col("line_close").alias("line")).join(poss, "game_key", "left")


@query("daily_ratings")
def daily_ratings(spark, sf):
    g = rated_games(spark, sf)
    r = ratings.daily_ratings(g)
    return g.select("game_key", "league", "date", "home", "away", "neutral").join(r, ["league", "date", "home", "away", "neutral"])


# The states as SQL: growing sums for the decayed averages, one recursion over a team's seasons and one over a league's dates
def _rates_sql(t: str) -> str:
    r = {"pace": "{t}.poss", "ortg": "100.0e0 * {t}.pts / {t}.poss", "drtg": "100.0e0 * {t}.pts_opp / {t}.poss", "efg": "({t}.fgm + 0.5e0 * {t}.fg3m) / greatest({t}.fga, 1)",
         "efg_allowed": "({t}.fgm_opp + 0.5e0 * {t}.fg3m_opp) / greatest({t}.fga_opp, 1)", "tpar": "1.0e0 * {t}.fg3a / greatest({t}.fga, 1)", "tpar_allowed": "1.0e0 * {t}.fg3a_opp / greatest({t}.fga_opp, 1)",
         "ftr": "1.0e0 * {t}.fta / greatest({t}.fga, 1)", "ftr_allowed": "1.0e0 * {t}.fta_opp / greatest({t}.fga_opp, 1)", "orb": "1.0e0 * {t}.oreb / greatest({t}.oreb + {t}.dreb_opp, 1)",
         "orb_allowed": "1.0e0 * {t}.oreb_opp / greatest({t}.oreb_opp + {t}.dreb, 1)", "tov": "1.0e0 * {t}.tov / {t}.poss", "tov_forced": "1.0e0 * {t}.tov_opp / {t}.poss"}
    return "[" + ", ".join(r[k].format(t=t) for k in ratings.BOX_RATES) + "]"


_FADE, _EDGE, _OWN = "pow(0.5e0, 1 / 150.0e0)", "pow(0.5e0, 1 / 500.0e0)", "pow(0.5e0, 1 / 10.0e0)"
_N_BOX = len(ratings.BOX_RATES)


def _each(make, names=("lt", "ou", "pf", "pa")) -> str:
    return ", ".join(make(x) for x in names)


STATES_SQL = with_("games box", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  hr AS (SELECT game_key, {_rates_sql('box')} AS r FROM box WHERE side = 'home'), ar AS (SELECT game_key, {_rates_sql('box')} AS r FROM box WHERE side = 'away'),
  p AS (SELECT league, season, date, home, away, CAST(count(*) AS DOUBLE) AS n, sum(home_pts) AS hp, sum(away_pts) AS ap, sum(line_close) AS ln, CAST(count(*) FILTER (hr.r IS NOT NULL AND ar.r IS NOT NULL) AS DOUBLE) AS nb,
    {', '.join(f"coalesce(sum({t}.r[{i + 1}]) FILTER (hr.r IS NOT NULL AND ar.r IS NOT NULL), 0.0e0) AS {t}{i}" for t in ('hr', 'ar') for i in range(_N_BOX))}
    FROM games LEFT JOIN hr USING (game_key) LEFT JOIN ar USING (game_key) GROUP BY ALL),
  q AS (SELECT *, sum(n) OVER (PARTITION BY league ORDER BY date, home, away, season) AS u FROM p),
  lv AS (SELECT *, (200 + coalesce(sum((hp + ap) * pow({_FADE}, -u)) OVER b, 0)) / (1 + coalesce(sum(n * pow({_FADE}, -u)) OVER b, 0)) AS lt, (200 + coalesce(sum(ln * pow({_FADE}, -u)) OVER b, 0)) / (1 + coalesce(sum(n * pow({_FADE}, -u)) OVER b, 0)) AS ll,
      pow({_EDGE}, u) * (50 + sum(n * pow({_EDGE}, -u)) OVER (PARTITION BY league ORDER BY date, home, away, season)) AS ew, row_number() OVER (PARTITION BY league, date ORDER BY home, away, season) AS rn
    FROM q WINDOW b AS (PARTITION BY league ORDER BY date, home, away, season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ld AS (SELECT league, date, lt AS lg_total, ll AS lg_line, lag(date) OVER (PARTITION BY league ORDER BY date) AS asof, row_number() OVER (PARTITION BY league ORDER BY date) AS k FROM lv WHERE rn = 1),
  sides AS (SELECT league, season, date, home, away, s.i AS side, CASE WHEN s.i = 0 THEN home ELSE away END AS team, n, nb, ln - n * lg_line AS lt, hp + ap - ln AS ou, CASE WHEN s.i = 0 THEN hp ELSE ap END AS pf, CASE WHEN s.i = 0 THEN ap ELSE hp END AS pa,
      {', '.join(f"CASE WHEN s.i = 0 THEN hr{i} ELSE ar{i} END AS r{i}" for i in range(_N_BOX))} FROM p JOIN ld USING (league, date), (VALUES (0), (1)) s(i)),
  td AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY league, team ORDER BY date) AS run FROM (SELECT *, coalesce(lag(season) OVER (PARTITION BY league, team ORDER BY date) <> season, false) AS new FROM (SELECT DISTINCT league, team, date, season FROM sides))),
  sr AS (SELECT sides.*, run, sum(n) OVER r AS u, sum(nb) OVER r AS ub FROM sides JOIN td USING (league, team, date) WINDOW r AS (PARTITION BY league, team, run ORDER BY date, home, away, side)),
  sb AS (SELECT *, pow({_OWN}, u - n) AS d0, {_each(lambda x: f"pow({_OWN}, u - n) * coalesce(sum({x} * pow({_OWN}, -u)) OVER b, 0) AS b_{x}")}, pow({_OWN}, u - n) * coalesce(sum(n * pow({_OWN}, -u)) OVER b, 0) AS b_w, row_number() OVER (PARTITION BY league, team, date ORDER BY home, away, side) AS rn
    FROM sr WINDOW b AS (PARTITION BY league, team, run ORDER BY date, home, away, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ends AS (SELECT league, team, run, pow({_OWN}, max(u)) AS d, {_each(lambda x: f"pow({_OWN}, max(u)) * sum({x} * pow({_OWN}, -u)) AS {x}")}, pow({_OWN}, max(u)) * sum(n * pow({_OWN}, -u)) AS w FROM sr GROUP BY 1, 2, 3),
  fold AS (SELECT league, team, run, 0.0e0 AS w0, {_each(lambda x: f"0.0e0 AS {x}0")}, w, {_each(lambda x: x)} FROM ends WHERE run = 0
    UNION ALL SELECT e.league, e.team, e.run, least(f.w, 5.0e0), {_each(lambda x: f"f.{x} * {0.6 if x in ('lt', 'ou') else 1.0}e0 * least(f.w, 5.0e0) / f.w")}, least(f.w, 5.0e0) * e.d + e.w,
      {_each(lambda x: f"f.{x} * {0.6 if x in ('lt', 'ou') else 1.0}e0 * least(f.w, 5.0e0) / f.w * e.d + e.{x}")} FROM fold f JOIN ends e ON e.league = f.league AND e.team = f.team AND e.run = f.run + 1),
  st AS (SELECT sb.league, sb.team, sb.date, sb.run, sb.u - sb.n AS games, {_each(lambda x: f"(f.{x}0 * d0 + b_{x}) / nullif(f.w0 * d0 + b_w, 0) AS {x}")} FROM sb JOIN fold f ON f.league = sb.league AND f.team = sb.team AND f.run = sb.run WHERE sb.rn = 1),
  tm AS (SELECT league, team, row_number() OVER (PARTITION BY league ORDER BY team) AS i, count(*) OVER (PARTITION BY league) AS m FROM (SELECT DISTINCT league, team FROM sides)),
  dg AS (SELECT lv.league, lv.date, list({{'h': h.i, 'a': a.i, 'n': lv.n, 'hp': lv.hp, 'ap': lv.ap, 'w': lv.ew}}) AS g FROM lv JOIN tm h ON h.league = lv.league AND h.team = lv.home JOIN tm a ON a.league = lv.league AND a.team = lv.away GROUP BY 1, 2),
  fr AS (SELECT td.league, td.date, list(tm.i) AS fresh FROM td JOIN tm USING (league, team) WHERE new GROUP BY 1, 2),
  days AS (SELECT ld.*, g, coalesce(fresh, []) AS fresh, (SELECT max(m) FROM tm WHERE tm.league = ld.league) AS m FROM ld JOIN dg USING (league, date) LEFT JOIN fr USING (league, date)),
  core AS (SELECT league, k, [0.0e0 FOR i IN range(m)] AS o, [0.0e0 FOR i IN range(m)] AS f, 0.0e0 AS adv FROM days WHERE k = 1
    UNION ALL SELECT z.league, z.k + 1, [CASE WHEN list_contains(nx.fresh, i) THEN z.o[i] * 0.6e0 ELSE z.o[i] END FOR i IN range(1, nx.m + 1)], [CASE WHEN list_contains(nx.fresh, i) THEN z.f[i] * 0.6e0 ELSE z.f[i] END FOR i IN range(1, nx.m + 1)], z.adv
      FROM (SELECT league, k, adv + list_sum([(x.eh - x.ea) / x.w FOR x IN e]) AS adv, [o[i] + 0.08e0 * (coalesce(list_sum([x.eh FOR x IN e IF x.h = i]), 0) + coalesce(list_sum([x.ea FOR x IN e IF x.a = i]), 0)) FOR i IN range(1, m + 1)] AS o,
              [f[i] + 0.08e0 * (coalesce(list_sum([x.eh FOR x IN e IF x.a = i]), 0) + coalesce(list_sum([x.ea FOR x IN e IF x.h = i]), 0)) FOR i IN range(1, m + 1)] AS f
            FROM (SELECT c.*, d.m, [{{'h': x.h, 'a': x.a, 'w': x.w, 'eh': x.hp - x.n * (lg_total / 2 + adv / 2 + o[x.h] + f[x.a]), 'ea': x.ap - x.n * (lg_total / 2 - adv / 2 + o[x.a] + f[x.h])}} FOR x IN d.g] AS e FROM core c JOIN days d ON d.league = c.league AND d.k = c.k)) z
      JOIN days nx ON nx.league = z.league AND nx.k = z.k + 1)"""


@query("team_states", STATES_SQL + f""" SELECT g.game_key, strftime(g.date, '%Y-%m-%d') AS date, strftime(ld.asof, '%Y-%m-%d') AS asof, {reals(exp_home='lg_total / 2 + adv / 2 + o[th.i] + f[ta.i]', exp_away='lg_total / 2 - adv / 2 + o[ta.i] + f[th.i]',
    naive_total='(sh.pf + sa.pf + sh.pa + sa.pa) / 2', lg_gap='lg_total - lg_line', home_games='sh.games', home_line_tend='coalesce(sh.lt, 0)', home_ou_trend='coalesce(sh.ou, 0)')}
  FROM games g JOIN ld USING (league, date) JOIN core c ON c.league = ld.league AND c.k = ld.k JOIN tm th ON th.league = g.league AND th.team = g.home JOIN tm ta ON ta.league = g.league AND ta.team = g.away
    JOIN st sh ON sh.league = g.league AND sh.team = g.home AND sh.date = g.date JOIN st sa ON sa.league = g.league AND sa.team = g.away AND sa.date = g.date""")
def team_states(spark, sf):
    g = rated_games(spark, sf)
    s = ratings.expected_points(g, ratings.team_states(g))
    return s.select("game_key", "date", "asof", "exp_home", "exp_away", "naive_total", "lg_gap", "home_games", "home_line_tend", "home_ou_trend")


# M11, box rates: the team's and the league's 13 averages, carried over seasons, and the total they imply
_BOX_SQL = STATES_SQL + f""",
  lb0 AS (SELECT *, sum(nb) OVER (PARTITION BY league ORDER BY date, home, away, season, side) AS v FROM sides),
  lb1 AS (SELECT league, date, coalesce(sum(nb * pow({_FADE}, -v)) OVER b, 0) AS w, {', '.join(f'coalesce(sum(r{i} * pow({_FADE}, -v)) OVER b, 0) AS s{i}' for i in range(_N_BOX))}, row_number() OVER (PARTITION BY league, date ORDER BY home, away, season, side) AS rn
    FROM lb0 WINDOW b AS (PARTITION BY league ORDER BY date, home, away, season, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lb AS (SELECT league, date, {', '.join(f's{i} / nullif(w, 0) AS l{i}' for i in range(_N_BOX))} FROM lb1 WHERE rn = 1),
  xb AS (SELECT sr.*, {', '.join(f'l{i}, coalesce(l{i}, r{i} / nullif(nb, 0)) AS f{i}' for i in range(_N_BOX))}, pow({_OWN}, ub - nb) AS d0, pow({_OWN}, ub - nb) * coalesce(sum(nb * pow({_OWN}, -ub)) OVER b, 0) AS b_w,
      {', '.join(f'pow({_OWN}, ub - nb) * coalesce(sum(r{i} * pow({_OWN}, -ub)) OVER b, 0) AS b{i}' for i in range(_N_BOX))}, row_number() OVER (PARTITION BY league, team, date ORDER BY home, away, side) AS rn
    FROM sr JOIN lb USING (league, date) WINDOW b AS (PARTITION BY league, team, run ORDER BY date, home, away, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  be AS (SELECT league, team, run, max(ub) AS nb, pow({_OWN}, max(ub)) AS d, pow({_OWN}, max(ub)) * sum(nb * pow({_OWN}, -ub)) AS w, {', '.join(f'pow({_OWN}, max(ub)) * sum(r{i} * pow({_OWN}, -ub)) AS s{i}, arg_min(l{i}, (date, home, away, side)) AS l{i}, arg_min(f{i}, (date, home, away, side)) FILTER (nb > 0) AS f{i}' for i in range(_N_BOX))} FROM xb GROUP BY 1, 2, 3),
  bf AS (SELECT league, team, run, false AS had, CASE WHEN nb > 0 THEN 2.5e0 ELSE 0.0e0 END AS w0, {', '.join(f'CASE WHEN nb > 0 THEN 2.5e0 * f{i} ELSE 0.0e0 END AS z{i}' for i in range(_N_BOX))}, CASE WHEN nb > 0 THEN 2.5e0 ELSE 0.0e0 END * d + w AS w, {', '.join(f'CASE WHEN nb > 0 THEN 2.5e0 * f{i} ELSE 0.0e0 END * d + s{i} AS s{i}' for i in range(_N_BOX))} FROM be WHERE run = 0
    UNION ALL SELECT league, team, run, had, w0, {', '.join(f'z{i}' for i in range(_N_BOX))}, w0 * d + ew, {', '.join(f'z{i} * d + e{i}' for i in range(_N_BOX))} FROM (
      SELECT e.league, e.team, e.run, e.d, e.w AS ew, f.w > 0 AS had, CASE WHEN f.w > 0 THEN least(f.w, 5.0e0) WHEN e.nb > 0 THEN 2.5e0 ELSE 0.0e0 END AS w0,
        {', '.join(f'e.s{i} AS e{i}, CASE WHEN f.w > 0 THEN least(f.w, 5.0e0) * coalesce(0.6e0 * f.s{i} / f.w + 0.4e0 * e.l{i}, f.s{i} / f.w) WHEN e.nb > 0 THEN 2.5e0 * e.f{i} ELSE 0.0e0 END AS z{i}' for i in range(_N_BOX))}
      FROM bf f JOIN be e ON e.league = f.league AND e.team = f.team AND e.run = f.run + 1)),
  bs AS (SELECT x.league, x.team, x.date, x.ub - x.nb AS games, {', '.join(f'CASE WHEN had OR x.ub - x.nb > 0 THEN (z{i} * d0 + b{i}) / nullif(w0 * d0 + b_w, 0) END AS a{i}' for i in range(_N_BOX))} FROM xb x JOIN bf USING (league, team, run) WHERE rn = 1)"""


@query("box_states", _BOX_SQL + f""" SELECT g.game_key, h.games AS home_box_games, {reals(**{f'home_{r}': f'h.a{i}' for i, r in enumerate(ratings.BOX_RATES)}, **{f'away_{r}': f'a.a{i}' for i, r in enumerate(ratings.BOX_RATES)}, lg_pace='l0', lg_ortg='l1',
    box_exp_pace='h.a0 * a.a0 / l0', box_exp_total='h.a0 * a.a0 / l0 * (h.a1 * a.a2 + a.a1 * h.a2) / l1 / 100')} FROM games g JOIN bs h ON h.league = g.league AND h.team = g.home AND h.date = g.date JOIN bs a ON a.league = g.league AND a.team = g.away AND a.date = g.date JOIN lb ON lb.league = g.league AND lb.date = g.date""")
def box_states(spark, sf):
    g = ratings.with_box_rates(rated_games(spark, sf), box(spark, sf))
    s = ratings.expected_points(g, ratings.team_states(g))
    return s.select("game_key", "home_box_games", *[f"{t}_{r}" for t in ("home", "away") for r in ratings.BOX_RATES], F.col("lb_pace").alias("lg_pace"), F.col("lb_ortg").alias("lg_ortg"), "box_exp_pace", "box_exp_total")


# Close-informed variants and season decay
@query("walk_forward_move_target")
def walk_forward_move_target(spark, sf):
    t = training(spark, sf).withColumn("move", F.col("f_move"))
    return models.walk_forward(t, ["f_home", "f_away"], VAR_FEATS, decay=0.6, close="target").select("game_key", "season", "mu", "sd")


@query("walk_forward_move_feature")
def walk_forward_move_feature(spark, sf):
    t = training(spark, sf).withColumn("move", F.col("f_move"))
    return models.walk_forward(t, ["f_home", "f_away"], VAR_FEATS, close="feature").select("game_key", "season", "mu", "sd", "mu_move")


# The stage-one chain: Over probability, Platt map and lower bound per season
@query("stage_one_walk_forward")
def stage_one_walk_forward(spark, sf):
    p = predictions(spark, sf).where(F.col("outcome") != F.col("line"))
    p = models.add_over_probability(p, F.col("mu"), F.col("line"), F.col("sd")).withColumn("over", (F.col("outcome") > F.col("line")).cast("double"))
    p = cut_lineage(p.select("game_key", "season", "eligible", "p_over", "over"))
    return calibrate.walk_forward_calibrated(p, "p_over", "over").select("game_key", "season", "p_over", "p_cal", "p_cons")


# M3: boosted mean averaged with the ridge
@query("boosted_mean")
def boosted_mean(spark, sf):
    g = boosting.boosted_walk_forward(training(spark, sf), MEAN_FEATS, "resid", boosting.TOTALS).select("game_key", "season", "mu_gbt")
    r = predictions(spark, sf).select("game_key", "mu")
    return g.join(r, "game_key").withColumn("mu_ensemble", (F.col("mu") + F.col("mu_gbt")) / 2)


# Player points: history features, boosted mean, spread by level, chance of more than a line
@query("points_forecast")
def points_forecast(spark, sf):
    from slatemill.operators import history
    from slatemill.plans.standins import player_box

    b = player_box(spark, sf).select("game", "player", "season", "date", "points", "minutes")
    d = history.form_before(b, ["player"], "date", ["points", "minutes"], 8.0, ["points"], 5).where(F.col("h_points").isNotNull())
    d = cut_lineage(d.drop("date")).withColumn("eligible", F.lit(True))                     # read several times below
    feats = ["h_points", "h_minutes", "l_points"]
    p = boosting.boosted_walk_forward(d, feats, "points", boosting.POINTS).withColumn("line", F.floor(F.col("minutes") / 2) + 0.5)
    p = cut_lineage(p.select("game", "player", "season", "points", "line", F.greatest("mu_gbt", F.lit(0.5)).alias("mu")))
    return models.level_forecasts(p, "points", "mu", "line").select("game", "player", "season", "mu", "sd", "p_over")


# M14
@query("information_test")
def information_test(spark, sf):
    return models.information_test(forecasts(spark, sf), "y", F.lit(0.45) + F.col("doc_id") % 7 / 70, F.col("p"))


@query("out_of_sample_gain")
def out_of_sample_gain(spark, sf):
    return models.out_of_sample_gain(training(spark, sf).where("eligible"), ["f_home"], ["f_away", "f_rest"])


# empirical residual law per league
@query("empirical_exceedance", with_("train", "").rstrip() + f", a AS (SELECT DISTINCT league, resid * 0.5 AS z FROM train) SELECT a.league, {reals(z='a.z', p='avg(CASE WHEN t.resid > a.z THEN 1.0 ELSE 0.0 END)')} FROM a JOIN train t USING (league) GROUP BY a.league, a.z")
def empirical_exceedance(spark, sf):
    t = training(spark, sf).withColumn("z", F.col("resid").cast("double"))
    return models.empirical_exceedance(t, t.withColumn("z", F.col("z") * 0.5), ["league"], "z")


# calibrated thresholds through the PIT map, with Beta bounds
@query("threshold_probabilities")
def threshold_probabilities(spark, sf):
    from slatemill.functions.probability import add_norm_cdf

    t = training(spark, sf).withColumn("mu", (F.col("f_home") + F.col("f_away") - 4) * 0.5)
    u = lambda d, e: add_norm_cdf(d, "u", (e - F.col("line") - F.col("mu")) / 17.0)
    seasons = cut_lineage(t.select("season").distinct())                                                    # one row per season
    later = F.broadcast(models.allowed_seasons(seasons, 2).withColumnRenamed("season", "fit"))
    hist = u(t.where("eligible"), F.col("outcome") + 0.5).select("season", "u").join(later, F.col("season") < F.col("fit"))
    hist = cut_lineage(hist.select(F.col("fit").alias("season"), "u"))
    ask = cut_lineage(u(t, F.floor("line") + 0.5).join(later, F.col("season") == F.col("fit")).select("game_key", "season", "u"))
    bounds = calibrate.pit_bounds(hist, ask, ["season"], "u")
    p = ask.join(calibrate.pit_knots(hist, ["season"], "u"), "season").withColumn("p_under", calibrate.pit_map(F.col("u"), F.col("knots")))
    return p.join(bounds, ["season", "u"]).select("game_key", "season", (1 - F.col("p_under")).alias("p_over"), (1 - F.col("hi")).alias("p_over_cons"),
                                                  "p_under", F.col("lo").alias("p_under_cons"))
