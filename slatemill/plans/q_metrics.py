"""Queries for reports, scores, intervals, screens and dependence."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.functions.probability import add_copula_joint, wilson_interval
from slatemill.operators import clean, market, metrics
from slatemill.plans.q_history import long_history
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import bets, book_quotes, forecasts, games, player_box, quotes, with_

WILSON = "({c} {s} 1.96 * sqrt(({p}) * (1 - ({p})) / {n} + 1.96*1.96 / (4.0 * {n} * {n})) / (1 + 1.96*1.96 / {n}))"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k}) * 1.0 / {n}"
    centre = f"(({p}) + 1.96*1.96 / (2.0 * {n})) / (1 + 1.96*1.96 / {n})"
    return WILSON.format(c=centre, s="-", p=p, n=n), WILSON.format(c=centre, s="+", p=p, n=n)


W_SETTLED = "nullif(count(*) FILTER (sign <> 0), 0)"
BET_SQL = ("count(*) AS bets, count(*) FILTER (sign = 1) AS wins, count(*) FILTER (sign = 0) AS pushes, "
           + reals(win_rate=f"count(*) FILTER (sign = 1) * 1.0 / {W_SETTLED}", avg_pred="avg(p)",
                   cal_err=f"count(*) FILTER (sign = 1) * 1.0 / {W_SETTLED} - avg(p) FILTER (sign <> 0)", roi="avg(pnl)", units="sum(pnl)",
                   roi_se="stddev_samp(pnl) / sqrt(count(pnl))"))
LO, HI = wilson_sql("count(*) FILTER (sign = 1)", W_SETTLED)


# A1
@query("season_report", with_("games", f"""SELECT season, count(*) AS games, count(*) FILTER (ok_close) AS with_close, count(*) FILTER (neutral) AS neutral_games,
  {reals(mean_total='avg(total)', mean_line='avg(line_close) FILTER (ok_close)')} FROM games GROUP BY season"""))
def season_report(spark, sf):
    return games(spark, sf).groupBy("season").agg(
        F.count("*").alias("games"), F.count_if("ok_close").alias("with_close"), F.count_if("neutral").alias("neutral_games"),
        F.avg("total").alias("mean_total"), F.avg(F.when(F.col("ok_close"), F.col("line_close"))).alias("mean_line"))


# A2, A3, A5
@query("bet_summary_pooled", with_("bets", f"SELECT coalesce(CAST(season AS VARCHAR), 'POOLED') AS season, {BET_SQL}, {reals(ci_lo=LO, ci_hi=HI)} FROM bets GROUP BY ROLLUP (season)"))
def bet_summary_pooled(spark, sf):
    return metrics.with_wilson(metrics.with_pooled(bets(spark, sf), "season", metrics.bet_aggregates()))


# A4
DIMS = {"side": "side", "league": "league", "neutral": "CASE WHEN neutral THEN 'true' ELSE 'false' END", "month": "month(date)", "weekday": "weekday(date)",
        "line_bucket": "CASE WHEN line < 195 THEN 'low' WHEN line < 205 THEN 'mid' ELSE 'high' END", "moved_our_way": "CAST((line_close - line) * side > 0 AS VARCHAR)"}


@query("slice_table", with_("bets", "SELECT dim, value, era, " + BET_SQL + f", {reals(clv='avg(side * (line_close - line))', moved='avg(CASE WHEN side * (line_close - line) > 0 THEN 1.0 ELSE 0.0 END)')} FROM (SELECT *, CASE WHEN season <= 1997 THEN 'early' ELSE 'late' END AS era, unnest(["
                             + ", ".join(f"{{'dim': '{d}', 'value': CAST({e.replace('weekday(date)', '(isodow(date) - 1)')} AS VARCHAR)}}" for d, e in DIMS.items()) + "], recursive := true) FROM bets) GROUP BY dim, value, era"))
def slice_table(spark, sf):
    b = bets(spark, sf).withColumn("era", F.when(F.col("season") <= 1997, "early").otherwise("late"))
    side, move = F.col("side"), F.col("line_close") - F.col("line")
    dims = {"side": side, "league": F.col("league"), "neutral": F.col("neutral"), "month": F.month("date"), "weekday": F.weekday("date"),
            "line_bucket": F.when(F.col("line") < 195, "low").when(F.col("line") < 205, "mid").otherwise("high"), "moved_our_way": move * side > 0}
    aggs = metrics.bet_aggregates() + [F.avg(side * move).alias("clv"), F.avg((side * move > 0).cast("double")).alias("moved")]
    return metrics.slice_table(b, dims, ["era"], aggs)


# A5
@query("wilson_by_league", with_("bets", "SELECT league, " + reals(lo=LO, hi=HI) + " FROM bets GROUP BY 1"))
def wilson_by_league(spark, sf):
    lo, hi = wilson_interval(F.col("k"), F.col("n"))
    return bets(spark, sf).groupBy("league").agg(F.count_if(F.col("sign") == 1).alias("k"), F.count_if(F.col("sign") != 0).alias("n")).select(
        "league", lo.alias("lo"), hi.alias("hi"))


# A6, F16
LL = "-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))"


@query("forecast_scores", with_("forecasts", f"SELECT lang, count(*) AS n, {reals(brier='avg((p - y) * (p - y))', log_loss=f'avg({LL})', base_loss='avg(-ln(0.5))', mean_logit='avg(ln(p / (1 - p)))')} FROM forecasts GROUP BY lang"))
def forecast_scores(spark, sf):
    from slatemill.functions.probability import logit

    p, y = F.col("p"), F.col("y")
    return forecasts(spark, sf).groupBy("lang").agg(
        F.count("*").alias("n"), metrics.brier(p, y).alias("brier"), F.avg(metrics.log_loss_row(p, y)).alias("log_loss"),
        F.avg(metrics.log_loss_row(F.col("p_base"), y)).alias("base_loss"), F.avg(logit(p)).alias("mean_logit"))


@query("two_sided_loss", with_("bets", f"SELECT season, {reals(loss='avg(CASE WHEN sign = 1 THEN -ln(p / (p + 0.5)) WHEN sign = -1 THEN -ln(1 - p / (p + 0.5)) END)')} FROM bets GROUP BY 1"))
def two_sided_loss(spark, sf):
    l = metrics.two_sided_log_loss_row(F.col("p"), F.lit(0.5), F.col("sign"))
    return bets(spark, sf).groupBy("season").agg(F.avg(l).alias("loss"))


# A7, P12
EDGES = [0, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 1.0001]
RLO, RHI = wilson_sql("sum(y)", "count(*)")


@query("reliability_fixed", with_("forecasts", "SELECT bucket, count(*) AS n, " + reals(pred="avg(p)", actual="avg(y)", ci_lo=RLO, ci_hi=RHI, cal_err="avg(y) - avg(p)")
                                  + " FROM (SELECT *, CASE " + " ".join(f"WHEN p >= {a} AND p < {b} THEN '[{a}, {b})'" for a, b in zip(EDGES[:-1], EDGES[1:]))
                                  + " END AS bucket FROM forecasts) GROUP BY bucket"))
def reliability_fixed(spark, sf):
    return metrics.reliability(forecasts(spark, sf), [], "p", "y", clean.edge_bucket(F.col("p"), EDGES))


def edges_sql(col: str, rel: str, k: int) -> str:
    qs = ", ".join(f"{i}/{k}.0" for i in range(k + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont(CAST({col} AS DOUBLE), [{qs}]))) AS e FROM {rel})"


@query("ece", with_("forecasts", f"""SELECT {reals(ece='sum(n * abs(mp - my)) / sum(n)')}, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT greatest(0, least(len(list_filter(e, lambda x: x <= p)) - 1, len(e) - 2)) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM forecasts, {edges_sql('p', 'forecasts', 10)} GROUP BY 1)"""))
def ece(spark, sf):
    return metrics.calibration_error(forecasts(spark, sf), "p", "y")


# P13
@query("quantile_buckets", with_("bets", f"""SELECT bin, count(*) AS n, {reals(lo='min(line)', hi='max(line)', roi='avg(pnl)')} FROM (
  SELECT *, greatest(0, len(list_filter(e, lambda x: x < line)) - 1) AS bin FROM bets, {edges_sql('line', 'bets', 5)}) GROUP BY bin"""))
def quantile_buckets(spark, sf):
    return metrics.quantile_bins(bets(spark, sf), [], "line", 5).groupBy("bin").agg(
        F.count("*").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"), F.avg("pnl").alias("roi"))


# A21
@query("outcome_quantiles", with_("games", "SELECT league, " + reals(**{f"p{q}": f"quantile_cont(CAST(total AS DOUBLE), {q / 100})" for q in (10, 25, 50, 75, 90)}) + " FROM games GROUP BY league"))
def outcome_quantiles(spark, sf):
    return market.result_quantiles(games(spark, sf), ["league"], "total")


# A8
@query("bootstrap_roi")
def bootstrap_roi(spark, sf):
    """Date-clustered interval of ROI per league."""
    return metrics.cluster_bootstrap(bets(spark, sf), ["league"], "date", F.col("pnl"), F.lit(1.0), 1000)


@query("paired_days", with_("bets", f"""SELECT strftime(date, '%Y-%m-%d') AS date, {reals(profit_a='coalesce(sum(pnl) FILTER (p >= 0.5), 0)', profit_b='coalesce(sum(pnl) FILTER (p >= 0.55), 0)')},
  count(*) FILTER (p >= 0.5) AS n_a, count(*) FILTER (p >= 0.55) AS n_b FROM bets WHERE p >= 0.5 GROUP BY date"""))
def paired_days(spark, sf):
    """Two arms side by side on every day: bets at 0.5 and bets at 0.55."""
    b = bets(spark, sf)
    return metrics.paired_day_sums(b.where("p >= 0.5"), b.where("p >= 0.55"), "date", "pnl")


@query("paired_day_difference")
def paired_day_difference(spark, sf):
    b = bets(spark, sf)
    return metrics.paired_day_difference(b.where("p >= 0.5"), b.where("p >= 0.55"), "date", "pnl")


@query("bootstrap_log_loss_gain")
def bootstrap_log_loss_gain(spark, sf):
    """Paired log-loss gain of the forecast over the base rate, clustered by day."""
    f = forecasts(spark, sf)
    gain = metrics.log_loss_row(F.col("p_base"), F.col("y")) - metrics.log_loss_row(F.col("p"), F.col("y"))
    return metrics.cluster_bootstrap(f, [], "day", gain, F.lit(1.0), 1000)


# A9, J11
@query("pair_dependence", with_("bets", "").rstrip() + f""", v AS (SELECT season, date, game_key, CASE WHEN outcome > line THEN 1.0 ELSE 0.0 END AS x, (outcome - line) / 17.0 AS z FROM bets WHERE sign <> 0),
  pr AS (SELECT a.season, a.date, a.x AS xa, b.x AS xb, a.z AS za, b.z AS zb FROM v a JOIN v b ON a.date = b.date AND a.game_key <> b.game_key)
  SELECT season, count(*) // 2 AS pairs, count(DISTINCT date) AS slates, {reals(over_corr='corr(xa, xb)', z_corr='corr(za, zb)', joint_rate='avg(xa * xb)', joint_minus_product='avg(xa * xb) - avg(xa) * avg(xb)')} FROM pr GROUP BY season""")
def pair_dependence(spark, sf):
    """Same-slate pair statistics from per-slate sums; the oracle forms the pairs."""
    b = bets(spark, sf).where(F.col("sign") != 0).withColumns({
        "x": (F.col("outcome") > F.col("line")).cast("double"), "z": (F.col("outcome") - F.col("line")) / 17.0})
    return metrics.pair_dependence(b, ["season"], "date", "x", "z")


# F15
def _gl_sql() -> str:
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(20)
    return "[" + ", ".join(f"{{'x': {float((a + 1) / 2)!r}::DOUBLE, 'w': {float(b / 2)!r}::DOUBLE}}" for a, b in zip(x, w)) + "]"


def _copula_oracle() -> str:
    from slatemill.plans.q_market import ppf_from

    h = ppf_from("(SELECT game_key, pa, pb, th FROM src)", "pa", "h")
    k = ppf_from(h, "pb", "k")
    term = "n.w * exp(-(h*h + k*k - 2*h*k*sin(th * n.x)) / (2 * (1 - sin(th * n.x) * sin(th * n.x))))"
    return with_("bets", "").rstrip() + f""", src AS (SELECT game_key, p AS pa, 0.3 + (game_key % 50) / 100.0 AS pb, asin((game_key % 7 - 3) * 0.1) AS th FROM bets)
    SELECT game_key, {reals(joint=f"CASE WHEN th = 0 THEN pa * pb ELSE pa * pb + th / (2 * pi()) * list_sum(list_transform({_gl_sql()}, lambda n: {term})) END")} FROM {k}"""


@query("copula_joint", _copula_oracle())
def copula_joint(spark, sf):
    b = bets(spark, sf).select("game_key", "p", (0.3 + (F.col("game_key") % 50) / 100.0).alias("pb"))
    return add_copula_joint(b, "joint", F.col("p"), F.col("pb"), (F.col("game_key") % 7 - 3) * 0.1).select("game_key", "joint")


# A10, O1
SIGNALS = {"neutral": "CAST(neutral AS INTEGER)", "spread": "abs(home_spread_close)", "move": "line_close - line_open", "line": "line_close", "month": "month(date)",
           "home": "home % 5", "away": "away % 5", "half": "first_half"}


@query("signal_screen", with_("games", "").rstrip() + ", s AS (SELECT season, total - line_close AS y, unnest([" + ", ".join(f"{{'signal': '{n}', 'x': CAST({e} AS DOUBLE)}}" for n, e in SIGNALS.items())
       + f"""], recursive := true) FROM games WHERE ok_close), e AS (SELECT signal, CASE WHEN season <= 1997 THEN 'disc' ELSE 'val' END AS era, x, y FROM s),
  t AS (SELECT signal, era, count(*) AS n, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM e GROUP BY 1, 2),
  w AS (SELECT signal, max(t) FILTER (era='disc') AS td, max(t) FILTER (era='val') AS tv, max(n) FILTER (era='disc') AS n_disc, max(n) FILTER (era='val') AS n_val FROM t GROUP BY 1)
  SELECT signal, n_disc, n_val, {reals(t_disc='td', t_val='tv')}, coalesce(abs(td) >= 2 AND sign(td) = sign(tv) AND abs(tv) >= 1.5, false) AS lead FROM w""")
def signal_screen(spark, sf):
    g = games(spark, sf).where("ok_close").withColumn("y", F.col("total") - F.col("line_close"))
    g = g.withColumn("era", F.when(F.col("season") <= 1997, "disc").otherwise("val"))
    sig = {"neutral": F.col("neutral").cast("int"), "spread": F.abs("home_spread_close"), "move": F.col("line_close") - F.col("line_open"),
           "line": F.col("line_close"), "month": F.month("date"), "home": F.col("home") % 5, "away": F.col("away") % 5, "half": F.col("first_half")}
    return metrics.signal_leads(metrics.signal_screen(g, sig, "y", "era"), "era", "disc", "val")


# A11
@query("consensus_lines", with_("book_quotes", f"SELECT game_key, count(*) AS books, {reals(line='median(open)', book_sd='stddev_pop(open)')} FROM book_quotes GROUP BY 1"))
def consensus_lines(spark, sf):
    return market.consensus(book_quotes(spark, sf))


DEC = "CASE WHEN {a} >= 100 THEN 1 + {a} / 100.0 WHEN {a} <= -100 THEN 1 + 100.0 / abs({a}) END"


@query("median_prices", with_("book_quotes", "").rstrip() + f", c AS (SELECT game_key, median(open) AS line FROM book_quotes GROUP BY 1) SELECT game_key, count(*) AS books, {reals(line='line', over='median(' + DEC.format(a='open_over') + ')', under='median(' + DEC.format(a='open_under') + ')')} FROM book_quotes JOIN c USING (game_key) WHERE open = line GROUP BY game_key, line")
def median_prices(spark, sf):
    return market.median_price_at_median(book_quotes(spark, sf))


# A12, F9
@query("best_quotes", with_("book_quotes", "").rstrip() + f""", c AS (SELECT game_key, median(open) AS line FROM book_quotes GROUP BY 1),
  q AS (SELECT b.*, {DEC.format(a='open_over')} AS d_o, {DEC.format(a='open_under')} AS d_u FROM book_quotes b JOIN c USING (game_key) WHERE abs(open - line) <= 3),
  o AS (SELECT *, row_number() OVER (PARTITION BY game_key ORDER BY open, d_o DESC, book) AS rn FROM q WHERE d_o IS NOT NULL),
  u AS (SELECT *, row_number() OVER (PARTITION BY game_key ORDER BY open DESC, d_u DESC, book) AS rn FROM q WHERE d_u IS NOT NULL),
  k AS (SELECT DISTINCT game_key FROM q)
  SELECT k.game_key, o.book AS over_book, u.book AS under_book, {reals(over_line='o.open', over_price='o.d_o', under_line='u.open', under_price='u.d_u')}
  FROM k LEFT JOIN (SELECT * FROM o WHERE rn = 1) o USING (game_key) LEFT JOIN (SELECT * FROM u WHERE rn = 1) u USING (game_key)""")
def best_quotes(spark, sf):
    return market.best_quotes(book_quotes(spark, sf))


# A14
@query("team_mode", with_("long", "SELECT team, league AS usual FROM (SELECT team, league, row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, league) AS rn FROM long GROUP BY 1, 2) WHERE rn = 1"))
def team_mode(spark, sf):
    c = long_history(spark, sf).groupBy("team", "league").agg(F.count("*").alias("n"))
    return c.groupBy("team").agg(F.max_by("league", F.struct("n", -F.col("league"))).alias("usual"))


# A15, A20
@query("coverage", with_("quotes", "SELECT book, count(*) AS prices, count(DISTINCT fixture_id) AS fixtures, count(DISTINCT line) AS lines FROM quotes GROUP BY 1"))
def coverage(spark, sf):
    """Two-level distinct counts: distinct pairs first, so a book holding most rows is spread."""
    q = quotes(spark, sf)
    rows = q.groupBy("book", "fixture_id", "line").agg(F.count("*").alias("n"))
    fx = rows.groupBy("book", "fixture_id").agg(F.sum("n").alias("n")).groupBy("book").agg(F.sum("n").alias("prices"), F.count("*").alias("fixtures"))
    ln = rows.groupBy("book", "line").agg(F.count("*").alias("x")).groupBy("book").agg(F.count("*").alias("lines"))
    return fx.join(ln, "book")


# A16
@query("worst_factor", with_("style", f"""SELECT factor, count(*) AS games, {reals(share='count(*) * 1.0 / sum(count(*)) OVER ()')} FROM (
  SELECT list_min([{{'v': CAST(round(efg - 0.5, 9) AS DOUBLE), 'n': 'shooting'}}, {{'v': CAST(round(ftr - 0.25, 9) AS DOUBLE), 'n': 'free_throws'}}, {{'v': CAST(round(orb - 0.3, 9) AS DOUBLE), 'n': 'rebounds'}}, {{'v': CAST(round(0.15 - tovr, 9) AS DOUBLE), 'n': 'turnovers'}}]).n AS factor FROM style) GROUP BY factor"""))
def worst_factor(spark, sf):
    from pyspark.sql import Window

    from slatemill.plans.q_history import style

    v = lambda x, n: F.struct(F.round(x, 9).alias("v"), F.lit(n).alias("n"))
    worst = F.array_min(F.array(v(F.col("efg") - 0.5, "shooting"), v(F.col("ftr") - 0.25, "free_throws"), v(F.col("orb") - 0.3, "rebounds"), v(0.15 - F.col("tovr"), "turnovers")))["n"]
    g = style(spark, sf).groupBy(worst.alias("factor")).agg(F.count("*").alias("games"))
    return g.withColumn("share", F.col("games") / F.sum("games").over(Window.partitionBy()))     # four rows


# A18
@query("player_seasons", with_("player_box", f"SELECT season + 1 AS season, player, team, {reals(minutes='sum(minutes)', points='sum(points)')} FROM player_box WHERE minutes > 0 GROUP BY ALL"))
def player_seasons(spark, sf):
    return player_box(spark, sf).where("minutes > 0").groupBy((F.col("season") + 1).alias("season"), "player", "team").agg(
        F.sum("minutes").alias("minutes"), F.sum("points").alias("points"))


# A19
def _hash_sum(start: int) -> str:
    """Sum of 15 hexadecimal digits of the row hashes."""
    return f"CAST(sum(CAST(CAST('0x' || substr(m, {start}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


_PRINTED = "coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


@query("table_fingerprint", with_("games", "").rstrip() + f", h AS (SELECT season, md5({' || '.join(_PRINTED.format(c=c) for c in ('game_key', 'date', 'home', 'away', 'total', 'line_close'))}) AS m FROM games) SELECT season, {_hash_sum(1)} || '-' || {_hash_sum(16)} AS hash, count(*) AS n FROM h GROUP BY 1")
def table_fingerprint(spark, sf):
    return metrics.fingerprint(games(spark, sf), ["season"], ["game_key", "date", "home", "away", "total", "line_close"])


# A22
@query("model_bias", with_("bets", f"SELECT season, {reals(bias='avg(p - 1 / price)', sd='stddev_samp(p - 1 / price)')} FROM bets GROUP BY 1"))
def model_bias(spark, sf):
    d = F.col("p") - 1 / F.col("price")
    return bets(spark, sf).groupBy("season").agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))


# D16
@query("card_report", with_("bets", f"SELECT season, {reals(units='sum(pnl)', break_even='avg(1 / price)', hit='avg(CASE WHEN sign = 1 THEN 1.0 ELSE 0.0 END)', clv_share='avg(CASE WHEN side * (line_close - line) > 0 THEN 1.0 ELSE 0.0 END)', max_drawdown='any_value(dd)')}, any_value(lr) AS losing_run FROM bets JOIN (SELECT season, max(greatest(0, pk) - eq) AS dd FROM (SELECT season, eq, max(eq) OVER (PARTITION BY season ORDER BY date, game_key) AS pk FROM (SELECT season, date, game_key, sum(pnl) OVER (PARTITION BY season ORDER BY date, game_key ROWS UNBOUNDED PRECEDING) AS eq FROM bets)) GROUP BY 1) USING (season) JOIN (SELECT season, max(c) AS lr FROM (SELECT season, isl, count(*) FILTER (pnl < 0) AS c FROM (SELECT season, pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY season ORDER BY date, game_key ROWS UNBOUNDED PRECEDING) AS isl FROM bets) GROUP BY 1, 2) GROUP BY 1) USING (season) GROUP BY season"))
def card_report(spark, sf):
    b = bets(spark, sf)
    base = b.groupBy("season").agg(F.avg(1 / F.col("price")).alias("break_even"), F.avg((F.col("sign") == 1).cast("double")).alias("hit"),
                                   F.avg((F.col("side") * (F.col("line_close") - F.col("line")) > 0).cast("double")).alias("clv_share"))
    return base.join(metrics.equity_report(b, ["season"], F.col("date"), ["date", "game_key"]), "season")
