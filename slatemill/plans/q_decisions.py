"""Queries for pricing, cards, staking, grading and studies."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.functions.odds import flat_profit, outcome_sign
from slatemill.operators import asof, calibrate, cards, clean, history, market, metrics, staking
from slatemill.plans.q_models import predictions
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import CTES, SHARP, SOFT, bets, book_quotes, box, finals, games, player_box, quotes, with_
from slatemill.session import cut_lineage

# predictions and calibrators with fixed coefficients, so that SQL can price the same legs
BETA = [0.05, 0.9, 1.55, 0.02, -0.1]
BETA_MKT = [0.0, 0.8, 1.6, 0.0, 0.0]
VAR = [0.004, 0.02, 0.003, 0.001, 0.01]
CTES["preds"] = (("games",), """SELECT game_key, season, date, CAST(line_open AS DOUBLE) AS line, CASE WHEN ok_close THEN line_close END AS line_close, CAST(total AS DOUBLE) AS outcome, game_key % 10 <> 0 AS eligible,
  (home % 5 + away % 5 - 4) * 0.8e0 AS mu, 15 + (game_key % 1009) / 500.0e0 AS sd, 0.1e0 AS mu_mkt, 16.5e0 + (game_key % 997) / 1000.0e0 AS sd_mkt, home_pts, away_pts FROM games WHERE ok_open""")


def preds(spark, sf):
    g, k = games(spark, sf).where("ok_open"), F.col("game_key")
    return g.select("game_key", "season", "date", F.col("line_open").cast("double").alias("line"), F.when(F.col("ok_close"), F.col("line_close")).alias("line_close"),
                    F.col("total").cast("double").alias("outcome"), (k % 10 != 0).alias("eligible"), ((F.col("home") % 5 + F.col("away") % 5 - 4) * 0.8).alias("mu"),
                    (15 + (k % 1009) / 500.0).alias("sd"), F.lit(0.1).alias("mu_mkt"), (16.5 + (k % 997) / 1000.0).alias("sd_mkt"), "home_pts", "away_pts")


def fixed_calibrators(spark, sf):
    s = games(spark, sf).select("season").distinct()
    v = [VAR[i] if i == j else 0.0 for i in range(5) for j in range(5)]
    arr = lambda a: F.array(*[F.lit(float(x)) for x in a])
    return s.withColumns({"beta": arr(BETA), "v": arr(v)}), s.withColumns({"beta": arr(BETA_MKT), "v": arr([0.0] * 25)})


def _eta(b: list[float], sm: str, sb: str) -> str:
    return f"({b[0]}e0 + {b[1]}e0 * {sm} + {b[2]}e0 * {sb} + {b[3]}e0 * {sb} * {sb} + ({b[4]}e0) * {sm} * {sb})"


def priced(rel: str, ref: str = "line") -> str:
    """SQL: relation with p, p_cons, p_mkt, p_mkt_close from line, t_eff, mu, sd, ..."""
    sig = lambda e: f"1 / (1 + exp(-({e})))"
    se = f"sqrt({VAR[0]} + {VAR[1]} * sm * sm + {VAR[2]} * sb * sb + {VAR[3]} * sb * sb * sb * sb + {VAR[4]} * sm * sm * sb * sb)"
    return f"""(SELECT *, {sig(_eta(BETA, 'sm', 'sb'))} AS p, {sig(_eta(BETA, 'sm', 'sb') + f' - 1.6449 * {se}')} AS p_cons, {sig(_eta(BETA_MKT, 'smm', 'sbm'))} AS p_mkt, {sig(_eta(BETA_MKT, 'smm', 'sbc'))} AS p_mkt_close
   FROM (SELECT *, side * mu / sd AS sm, side * (line - t_eff) / sd AS sb, side * mu_mkt / sd_mkt AS smm, side * ({ref} - t_eff) / sd_mkt AS sbm, side * (line_close - t_eff) / sd_mkt AS sbc FROM {rel}))"""


CUBE_BASE = """(SELECT *, thr AS t_eff, side * (outcome - thr) > 0 AS win FROM (SELECT *, CASE WHEN side = 1 THEN ceil(line + 0.5) - 0.5 ELSE floor(line - 0.5) + 0.5 END - side * k AS thr
   FROM preds, (VALUES (1), (-1)) s(side), (SELECT unnest(range(0, {n})) * 0.5e0 AS k)))"""
CTES["cube"] = (("preds",), "SELECT * FROM " + priced(CUBE_BASE.format(n=41)))
CTES["cube0"] = (("preds",), "SELECT * FROM " + priced(CUBE_BASE.format(n=1)))


# D1
@query("leg_cube", with_("cube", f"SELECT season, side, CASE WHEN round(k, 6) = 0 THEN 0.0 ELSE k END AS k, count(*) AS n, {reals(p='avg(p)', p_cons='avg(p_cons)', p_mkt='avg(p_mkt)', p_mkt_close='avg(p_mkt_close)', win_rate='avg(CASE WHEN win THEN 1.0 ELSE 0.0 END)')} FROM cube GROUP BY 1, 2, k"))
def leg_cube(spark, sf):
    c = cards.leg_cube(preds(spark, sf), *fixed_calibrators(spark, sf))
    return c.groupBy("season", "side", "k").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in ("p", "p_cons", "p_mkt", "p_mkt_close")], F.avg(F.col("win").cast("double")).alias("win_rate"))


# D3
MAIN_SQL = """, m AS (SELECT game_key, season, date, line, line_close, outcome, eligible, max(p) FILTER (side=1) AS p_over, max(p_cons) FILTER (side=1) AS oc, max(p) FILTER (side=-1) AS p_under, max(p_cons) FILTER (side=-1) AS uc FROM cube0 GROUP BY ALL),
  mv AS (SELECT *, CASE WHEN p_over >= p_under THEN 1 ELSE -1 END AS best_side, greatest(p_over, p_under) AS p_best, CASE WHEN p_over >= p_under THEN oc ELSE uc END AS p_best_cons FROM m)"""


@query("main_line_view", with_("cube0", "").rstrip() + MAIN_SQL + f" SELECT game_key, best_side, best_side * (outcome - line) > 0 AS best_win, outcome = line AS best_push, {reals(p_over='p_over', p_under='p_under', p_push='greatest(0, 1 - p_over - p_under)', p_best_cons='p_best_cons')} FROM mv")
def main_line_view(spark, sf):
    return cards.main_line_view(preds(spark, sf), *fixed_calibrators(spark, sf)).select("game_key", "best_side", "best_win", "best_push", "p_over", "p_under", "p_push", "p_best_cons")


# D8
@query("straight_bets", with_("cube0", "").rstrip() + MAIN_SQL + f""" SELECT season, count(*) AS bets, {reals(roi='avg(CASE WHEN outcome = line THEN 0 WHEN best_side * (outcome - line) > 0 THEN 100/110.0 ELSE -1 END)', avg_p='avg(p_best)')} FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY p_best DESC, game_key) AS rk FROM mv WHERE eligible AND p_best >= 0.55) WHERE rk <= 2 OR p_best >= 0.62 GROUP BY season""")
def straight_bets(spark, sf):
    """Singles at -110: a probability floor, two a day, and every pick at 0.62 or more."""
    m = cut_lineage(cards.main_line_view(preds(spark, sf), *fixed_calibrators(spark, sf)).select("season", "date", "game_key", "eligible", "outcome", "line", "best_side", "p_best"))
    m = history.best_or_all(m.where(F.col("eligible") & (F.col("p_best") >= 0.55)), ["date"], 2, [F.col("p_best").desc(), F.col("game_key")], F.col("p_best") >= 0.62)
    s = outcome_sign(F.col("outcome"), F.col("line"), F.col("best_side"))
    return m.groupBy("season").agg(F.count("*").alias("bets"), F.avg(flat_profit(s, F.lit(1 + 100 / 110))).alias("roi"), F.avg("p_best").alias("avg_p"))


DEC = "CASE WHEN {a} >= 100 THEN 1 + {a} / 100.0e0 WHEN {a} <= -100 THEN 1 + 100.0e0 / abs({a}) END"


@query("shopped_bets", with_("cube0 book_quotes", "").rstrip() + MAIN_SQL + f""", c AS (SELECT game_key, median(open) AS ml FROM book_quotes GROUP BY 1),
  q AS (SELECT b.*, {DEC.format(a='open_over')} AS d_o, {DEC.format(a='open_under')} AS d_u FROM book_quotes b JOIN c USING (game_key) WHERE abs(open - ml) <= 3),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_key ORDER BY open, d_o DESC, book) AS rn FROM q WHERE d_o IS NOT NULL) WHERE rn = 1),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_key ORDER BY open DESC, d_u DESC, book) AS rn FROM q WHERE d_u IS NOT NULL) WHERE rn = 1),
  s AS (SELECT mv.season, mv.outcome, CASE WHEN p_over * o.d_o >= p_under * u.d_u THEN 1 ELSE -1 END AS side, CASE WHEN p_over * o.d_o >= p_under * u.d_u THEN o.open ELSE u.open END AS ln,
     CASE WHEN p_over * o.d_o >= p_under * u.d_u THEN o.d_o ELSE u.d_u END AS od, greatest(p_over * o.d_o, p_under * u.d_u) AS value FROM mv JOIN o USING (game_key) JOIN u USING (game_key))
  SELECT season, count(*) AS bets, {reals(roi='avg(CASE WHEN outcome = ln THEN 0 WHEN side * (outcome - ln) > 0 THEN od - 1 ELSE -1 END)')} FROM s WHERE value > 1 GROUP BY 1""")
def shopped_bets(spark, sf):
    """Line shopping: each side at its best book, the side of higher value, graded at that line."""
    m = cards.main_line_view(preds(spark, sf), *fixed_calibrators(spark, sf))
    q = market.best_quotes(book_quotes(spark, sf))
    v = m.join(q, "game_key").withColumnsRenamed({"over_line": "line_over", "under_line": "line_under", "over_price": "odds_over", "under_price": "odds_under"})
    s = cards.shop_sides(v).where(F.col("value") > 1)
    s = s.withColumn("sign", outcome_sign(F.col("outcome"), F.col("line_shop"), F.col("side")))
    return s.groupBy("season").agg(F.count("*").alias("bets"), F.avg(flat_profit(F.col("sign"), F.col("odds_shop"))).alias("roi"))


# D2
@query("ladder_legs", with_("preds", "").rstrip() + ", l AS (SELECT * FROM " + priced("""(SELECT *, CASE WHEN thr = floor(thr) THEN thr + 0.5 * side ELSE thr END AS t_eff FROM (
    SELECT p.*, side, a.k, a.main, CASE WHEN a.main THEN line ELSE CASE WHEN side = 1 THEN ceil(line + 0.5) - 0.5 ELSE floor(line - 0.5) + 0.5 END - side * a.k END AS thr
    FROM preds p, (VALUES (1), (-1)) s(side), (SELECT true AS main, 0 AS k UNION ALL SELECT false, unnest(range(-6, 16))) a WHERE eligible))""") + f""")
  SELECT main, side, CAST(k AS BIGINT) AS k, count(*) AS n, {reals(odds='avg(CASE WHEN main THEN 1.909 ELSE 0.955 / greatest(p_mkt, 1e-3) END)', p_cons='avg(p_cons)', win='avg(CASE WHEN side * (outcome - thr) > 0 THEN 1.0 ELSE 0.0 END)', push='avg(CASE WHEN outcome = thr THEN 1.0 ELSE 0.0 END)')} FROM l GROUP BY 1, 2, k""")
def ladder_legs(spark, sf):
    l = cards.ladder_legs(preds(spark, sf), *fixed_calibrators(spark, sf))
    b = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return l.groupBy("main", "side", "k").agg(F.count("*").alias("n"), F.avg("odds").alias("odds"), F.avg("p_cons").alias("p_cons"), b("win"), b("push"))


# D4
@query("buffered_cards", with_("cube", "").rstrip() + f""", c AS (SELECT *, 0.9545 / greatest(p_mkt, 1e-3) AS odds, p * 0.9545 / greatest(p_mkt, 1e-3) AS val FROM cube WHERE eligible),
  sc AS (SELECT date, game_key, side, max(val) AS s FROM c WHERE p_cons >= sqrt(0.6) GROUP BY 1, 2, 3),
  tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, game_key DESC, side) AS r FROM sc) WHERE r <= 14),
  o AS (SELECT c.* FROM c JOIN tp USING (date, game_key, side) WHERE p_cons >= 0.6),
  x AS (SELECT a.date, a.game_key AS ga, b.game_key AS gb, a.val * b.val AS v, a.p_cons * b.p_cons AS jc, a.k AS ka, b.k AS kb, a.win AND b.win AS w, a.odds * b.odds AS od FROM o a JOIN o b ON a.date = b.date AND a.game_key < b.game_key WHERE a.p_cons * b.p_cons >= 0.6),
  r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY v DESC, ga, gb) AS rn FROM x)
  SELECT strftime(date, '%Y-%m-%d') AS date, ga AS game_key_a, gb AS game_key_b, w AS card_win, {reals(k_a='ka', k_b='kb', ev='v - 1', joint_cons='jc', profit='CASE WHEN w THEN od - 1 ELSE -1.0 END')} FROM r WHERE rn = 1""")
def buffered_cards(spark, sf):
    c = cards.buffered_cards(cards.leg_cube(preds(spark, sf), *fixed_calibrators(spark, sf)))
    return c.select("date", "game_key_a", "game_key_b", "card_win", "k_a", "k_b", "ev", "joint_cons", "profit")


# D5
@query("odds_cards", with_("preds", "").rstrip() + ", l AS (SELECT * FROM " + priced("""(SELECT *, CASE WHEN thr = floor(thr) THEN thr + 0.5 * side ELSE thr END AS t_eff FROM (
    SELECT p.*, side, a.k, a.main, CASE WHEN a.main THEN line ELSE CASE WHEN side = 1 THEN ceil(line + 0.5) - 0.5 ELSE floor(line - 0.5) + 0.5 END - side * a.k END AS thr
    FROM preds p, (VALUES (1), (-1)) s(side), (SELECT true AS main, 0 AS k UNION ALL SELECT false, unnest(range(-6, 16))) a WHERE eligible))""") + f"""),
  o0 AS (SELECT *, CASE WHEN main THEN 1.909 ELSE 0.955 / greatest(p_mkt, 1e-3) END AS odds FROM l), o1 AS (SELECT *, p_cons * odds AS vc FROM o0),
  tp AS (SELECT * FROM (SELECT date, game_key, side, row_number() OVER (PARTITION BY date ORDER BY max(vc) DESC, game_key DESC, side) AS r FROM o1 GROUP BY 1, 2, 3) WHERE r <= 16),
  o AS (SELECT o1.* FROM o1 JOIN tp USING (date, game_key, side)),
  x AS (SELECT a.date, a.game_key AS ga, b.game_key AS gb, a.vc * b.vc AS v, a.odds * b.odds AS od, a.thr AS ta, b.thr AS tb,
     CASE WHEN a.outcome <> a.thr AND a.side * (a.outcome - a.thr) < 0 OR b.outcome <> b.thr AND b.side * (b.outcome - b.thr) < 0 THEN -1.0 ELSE CASE WHEN a.outcome = a.thr THEN 1 ELSE a.odds END * CASE WHEN b.outcome = b.thr THEN 1 ELSE b.odds END - 1 END AS profit
     FROM o a JOIN o b ON a.date = b.date AND a.game_key < b.game_key WHERE a.odds * b.odds >= 2.5),
  r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY v DESC, ga, gb, ta DESC, tb DESC) AS rn FROM x)
  SELECT strftime(date, '%Y-%m-%d') AS date, ga AS game_key_a, gb AS game_key_b, {reals(ev_cons='v - 1', combined_odds='od', thr_a='ta', thr_b='tb', profit='profit')} FROM r WHERE rn = 1""")
def odds_cards(spark, sf):
    c = cards.odds_cards(cards.ladder_legs(preds(spark, sf), *fixed_calibrators(spark, sf)), force=True)
    return c.select("date", "game_key_a", "game_key_b", "ev_cons", "combined_odds", "thr_a", "thr_b", "profit")


@query("odds_cards_joint", with_("preds book_quotes", "").rstrip() + f""", c AS (SELECT game_key, median(open) AS ml FROM book_quotes GROUP BY 1),
  q AS (SELECT b.*, {DEC.format(a='open_over')} AS d_o, {DEC.format(a='open_under')} AS d_u FROM book_quotes b JOIN c USING (game_key) WHERE abs(open - ml) <= 3),
  bo AS (SELECT * FROM (SELECT game_key, open, d_o, row_number() OVER (PARTITION BY game_key ORDER BY open, d_o DESC, book) AS rn FROM q WHERE d_o IS NOT NULL) WHERE rn = 1),
  bu AS (SELECT * FROM (SELECT game_key, open, d_u, row_number() OVER (PARTITION BY game_key ORDER BY open DESC, d_u DESC, book) AS rn FROM q WHERE d_u IS NOT NULL) WHERE rn = 1),
  sd2 AS (SELECT p.*, side, CASE WHEN side = 1 THEN coalesce(bo.open, line) ELSE coalesce(bu.open, line) END AS ref, CASE WHEN side = 1 THEN d_o ELSE d_u END AS bp FROM preds p CROSS JOIN (VALUES (1), (-1)) s(side) LEFT JOIN bo ON bo.game_key = p.game_key LEFT JOIN bu ON bu.game_key = p.game_key WHERE eligible),
  l AS (SELECT * FROM """ + priced("""(SELECT *, CASE WHEN thr = floor(thr) THEN thr + 0.5 * side ELSE thr END AS t_eff FROM (
    SELECT s.*, a.k, a.main, CASE WHEN a.main THEN ref ELSE CASE WHEN side = 1 THEN ceil(ref + 0.5) - 0.5 ELSE floor(ref - 0.5) + 0.5 END - side * a.k END AS thr
    FROM sd2 s, (SELECT true AS main, 0 AS k UNION ALL SELECT false, unnest(range(-6, 16))) a))""", "ref") + f"""),
  o0 AS (SELECT *, CASE WHEN main THEN 0 ELSE k + 7 END AS opt, CASE WHEN main THEN coalesce(bp, 1.909) ELSE 0.955 / greatest(least(p_mkt, 1), 1e-3) END AS od FROM l), o1 AS (SELECT *, p_cons * od AS vc FROM o0 WHERE od BETWEEN 1.3 AND 3.0),
  tp AS (SELECT * FROM (SELECT date, game_key, side, row_number() OVER (PARTITION BY date ORDER BY max(vc) DESC, game_key DESC, side) AS r FROM o1 GROUP BY 1, 2, 3) WHERE r <= 16),
  o AS (SELECT o1.*, r FROM o1 JOIN tp USING (date, game_key, side)),
  x AS (SELECT a.date, a.game_key AS ga, b.game_key AS gb, a.p_cons * b.p_cons AS jc, a.od * b.od AS od, a.vc * b.vc AS v, a.r AS ra, b.r AS rb, a.opt AS pa, b.opt AS pb,
     CASE WHEN a.side * (a.outcome - a.thr) < 0 OR b.side * (b.outcome - b.thr) < 0 THEN -1.0 ELSE CASE WHEN a.outcome = a.thr THEN 1 ELSE a.od END * CASE WHEN b.outcome = b.thr THEN 1 ELSE b.od END - 1 END AS profit
     FROM o a JOIN o b ON a.date = b.date AND a.game_key < b.game_key WHERE a.od * b.od BETWEEN 2.5 AND 4.0 AND a.vc * b.vc > 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY jc DESC, ra, pa, rb, pb) AS rn FROM x)
  SELECT strftime(date, '%Y-%m-%d') AS date, ga AS game_key_a, gb AS game_key_b, {reals(joint_cons='jc', combined_odds='od', profit='profit')} FROM r WHERE rn = 1 AND v - 1 > 0""")
def odds_cards_joint(spark, sf):
    """Product variant: highest chance of both winning among main and alternate legs of positive EV."""
    l = cards.ladder_legs(preds(spark, sf), *fixed_calibrators(spark, sf), quotes=cut_lineage(market.best_quotes(book_quotes(spark, sf))), alt_ref="best_book")
    return cards.odds_cards(l, objective="joint", band=(1.3, 3.0), cap=4.0, settle="odds").select("date", "game_key_a", "game_key_b", "joint_cons", "combined_odds", "profit")


# D6, A9 per earlier season
def slate_preds(spark, sf):
    k = F.col("game_key")
    return bets(spark, sf).select("game_key", "season", "date", (0.5 + (k * 37 % 211) / 797.0 + (k % 9973) / 1e7).alias("p_cal"), (0.46 + (k * 37 % 211) / 797.0 + (k % 13) / 500.0).alias("p_cons"),
                                  "line", (F.col("line") + 2).alias("proj_total"), F.col("outcome").alias("total"), F.lit(True).alias("calibrated"), (k % 10 != 0).alias("eligible"))


@query("slate_decisions", with_("bets", "").rstrip() + f""", d AS (SELECT game_key, season, date, 0.5e0 + (game_key * 37 % 211) / 797.0e0 + (game_key % 9973) / 1e7 AS p_cal, 0.46e0 + (game_key * 37 % 211) / 797.0e0 + (game_key % 13) / 500.0e0 AS p_cons, line, outcome FROM bets WHERE game_key % 10 <> 0),
  c AS (SELECT * FROM d WHERE p_cal >= 0.6 AND p_cal * 1.909 > 1),
  x AS (SELECT a.date, a.game_key AS ga, b.game_key AS gb, a.p_cal * b.p_cal AS jc FROM c a JOIN c b ON a.date = b.date AND a.game_key < b.game_key WHERE a.p_cons * b.p_cons >= 0.42),
  r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY jc DESC, ga, gb) AS rn FROM x),
  po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p_cal DESC, game_key) AS rk FROM d) WHERE rk <= 8),
  cl AS (SELECT a.date, max(a.p_cons * b.p_cons) AS jc FROM po a JOIN po b ON a.date = b.date AND a.game_key < b.game_key GROUP BY 1),
  s AS (SELECT date, arg_max(game_key, p_cal - game_key * 1e-12) AS sk FROM c WHERE p_cons >= 0.5238 AND p_cons * 1.909 > 1 GROUP BY 1)
  SELECT strftime(p.date, '%Y-%m-%d') AS date, n_games, nc AS n_candidates, nc * (nc - 1) // 2 AS n_pairs, CASE WHEN r.ga IS NOT NULL THEN 'TWO-PICK CARD' WHEN sk IS NOT NULL THEN 'ONE QUALIFYING PICK' ELSE 'NO BET' END AS outcome,
    coalesce(r.ga, sk) AS pick_a, r.gb AS pick_b, {reals(joint_cal='r.jc', closest_joint_cons='cl.jc')}
  FROM (SELECT date, count(*) AS n_games, count(*) FILTER (p_cal >= 0.6 AND p_cal * 1.909 > 1) AS nc FROM d GROUP BY 1) p LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.date = p.date LEFT JOIN s ON s.date = p.date LEFT JOIN cl ON cl.date = p.date""")
def slate_decisions(spark, sf):
    """With no dependence the copula is a product, which SQL can search over all pairs."""
    p = slate_preds(spark, sf)
    rho = p.select("season").distinct().withColumns({"rho": F.lit(0.0), "rho_lo": F.lit(0.0)})
    return cards.decide_slates(p, rho, joint_target=0.42).select("date", "n_games", "n_candidates", "n_pairs", "outcome", "pick_a", "pick_b", "joint_cal", "closest_joint_cons")


# Qualifying pairs counted without forming them, against SQL over all pairs; the picks of every slate
_SLATE_SQL = with_("bets", "").rstrip() + """, d AS (SELECT game_key, season, date, 0.5e0 + (game_key * 37 % 211) / 797.0e0 + (game_key % 9973) / 1e7 AS p_cal, 0.46e0 + (game_key * 37 % 211) / 797.0e0 + (game_key % 13) / 500.0e0 AS p_cons, line, outcome FROM bets WHERE game_key % 10 <> 0),
  c AS (SELECT * FROM d WHERE p_cal >= 0.6 AND p_cal * 1.909 > 1),
  x AS (SELECT a.date, a.game_key AS ga, b.game_key AS gb, a.p_cal * b.p_cal AS jc FROM c a JOIN c b ON a.date = b.date AND a.game_key < b.game_key WHERE a.p_cons * b.p_cons >= 0.42),
  r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY jc DESC, ga, gb) AS rn, count(*) OVER (PARTITION BY date) AS q FROM x)"""


@query("slate_pair_counts", _SLATE_SQL + f""" SELECT strftime(p.date, '%Y-%m-%d') AS date, nc * (nc - 1) // 2 AS n_pairs, coalesce(r.q, 0) AS n_qualifying, {reals(joint_indep='r.jc')}
  FROM (SELECT date, count(*) FILTER (p_cal >= 0.6 AND p_cal * 1.909 > 1) AS nc FROM d GROUP BY 1) p LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.date = p.date""")
def slate_pair_counts(spark, sf):
    p = slate_preds(spark, sf)
    rho = p.select("season").distinct().withColumns({"rho": F.lit(0.0), "rho_lo": F.lit(0.0)})
    return cards.decide_slates(p, rho, joint_target=0.42).select("date", "n_pairs", "n_qualifying", "joint_indep")


@query("slate_picks", _SLATE_SQL + f""", s AS (SELECT date, arg_max(game_key, p_cal - game_key * 1e-12) AS sk FROM c WHERE p_cons >= 0.5238 AND p_cons * 1.909 > 1 AND date NOT IN (SELECT date FROM x) GROUP BY 1),
  k AS (SELECT date, 'TWO-PICK CARD' AS role, 0 AS leg, ga AS game_key FROM r WHERE rn = 1 UNION ALL SELECT date, 'TWO-PICK CARD', 1, gb FROM r WHERE rn = 1 UNION ALL SELECT date, 'ONE QUALIFYING PICK', 0, sk FROM s)
  SELECT strftime(k.date, '%Y-%m-%d') AS date, season, k.game_key, role, CAST(leg AS BIGINT) AS leg, CASE WHEN outcome > line THEN 'W' WHEN outcome = line THEN 'P' ELSE 'L' END AS result,
    {reals(line='line', proj_total='line + 2', p_cal='p_cal', p_cons='p_cons', profit='CASE WHEN outcome > line THEN 0.909e0 WHEN outcome = line THEN 0 ELSE -1 END')}, outcome AS total FROM k JOIN d ON d.game_key = k.game_key""")
def slate_picks(spark, sf):
    p = slate_preds(spark, sf)
    rho = p.select("season").distinct().withColumns({"rho": F.lit(0.0), "rho_lo": F.lit(0.0)})
    return cards.slate_picks(p, cards.decide_slates(p, rho, joint_target=0.42))


@query("slate_engine")
def slate_engine(spark, sf):
    """Full stage-one engine: dependence from earlier seasons' slates feeds each season's decisions."""
    p = slate_preds(spark, sf)
    z = p.withColumns({"x": (F.col("total") > F.col("line")).cast("double"), "z": (F.col("total") - F.col("proj_total")) / 17.0}).where(F.col("total") != F.col("line"))
    rho = metrics.earlier_season_dependence(z, "season", "date", "x", "z", n_boot=200, min_pairs=2000)
    d = cards.decide_slates(p, rho, joint_target=0.42)
    return d.groupBy("season", "outcome").agg(F.count("*").alias("slates"), F.avg("joint_cal").alias("joint_cal"), F.avg("double_profit").alias("roi"))


# D9
@query("props_value", with_("player_box", "").rstrip() + f""", q AS (SELECT game, player, points, floor(minutes / 2) + 0.5 AS line, 1.7 + (player % 20) / 40.0 AS price, 0.4 + (game % 21) / 100.0 AS p_fair, 1.0 + (game % 4) AS hours, CASE WHEN game % 2 = 0 THEN 1 ELSE -1 END AS side FROM player_box),
  e AS (SELECT *, p_fair * price - 1 AS ev FROM q WHERE p_fair * price - 1 > 0), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hours, game, player ORDER BY ev DESC) AS rn FROM e) WHERE rn = 1)
  SELECT hours, CASE WHEN ev < 0.05 THEN '[0, 0.05)' WHEN ev < 0.1 THEN '[0.05, 0.1)' ELSE '[0.1, 10)' END AS band, count(*) AS bets, {reals(roi='avg(CASE WHEN points = line THEN 0 WHEN side * (points - line) > 0 THEN price - 1 ELSE -1 END)', ev='avg(ev)')} FROM b GROUP BY 1, 2""")
def props_value(spark, sf):
    """Player props: one bet per player and decision time, graded, by value band."""
    g, pl = F.col("game"), F.col("player")
    q = player_box(spark, sf).select("game", "player", "points", (F.floor(F.col("minutes") / 2) + 0.5).alias("line"), (1.7 + (pl % 20) / 40.0).alias("price"), (0.4 + (g % 21) / 100.0).alias("p_fair"),
                                     (1.0 + g % 4).alias("hours"), F.when(g % 2 == 0, 1).otherwise(-1).alias("side"))
    ev = F.col("p_fair") * F.col("price") - 1
    q = q.withColumn("ev", ev).where("ev > 0")
    b = q.groupBy("hours", "game", "player").agg(F.max_by(F.struct("points", "line", "price", "side", "ev"), "ev").alias("m")).select("hours", "m.*")
    pnl = flat_profit(outcome_sign(F.col("points"), F.col("line"), F.col("side")), F.col("price"))
    return b.groupBy("hours", clean.edge_bucket(F.col("ev"), [0, 0.05, 0.1, 10]).alias("band")).agg(F.count("*").alias("bets"), F.avg(pnl).alias("roi"), F.avg("ev").alias("ev"))


# D10, F18
@query("kelly_staking", with_("bets", "").rstrip() + f""", k AS (SELECT *, greatest(0, (p * price - 1) / (price - 1)) / 8 AS f FROM bets), s AS (SELECT *, f * CASE WHEN sum(f) OVER (PARTITION BY date) > 0.25 THEN 0.25 / sum(f) OVER (PARTITION BY date) ELSE 1 END AS st FROM k)
  SELECT season, count(*) AS bets, {reals(staked='sum(st)', profit='sum(st * pnl)', roi='sum(st * pnl) / sum(st)')} FROM s GROUP BY 1""")
def kelly_staking(spark, sf):
    b = staking.capped_kelly(bets(spark, sf), ["date"], F.col("p"), F.col("price"))
    return staking.staking_report(b, ["season"], F.col("stake"), F.col("date"), ["date", "game_key"]).select("season", "bets", "staked", "profit", "roi")


@query("tiered_staking", with_("bets", "").rstrip() + f""", s AS (SELECT *, CASE WHEN p >= 0.6 THEN 2.5 WHEN p >= 0.58 THEN 2.0 WHEN p >= 0.55 THEN 1.5 ELSE 1.0 END AS st FROM bets),
  e AS (SELECT *, sum(st * pnl) OVER (PARTITION BY season ORDER BY date, game_key ROWS UNBOUNDED PRECEDING) AS eq FROM s), f AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY season ORDER BY date, game_key ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e)
  SELECT season, count(*) AS bets, {reals(staked='sum(st)', profit='sum(st * pnl)', roi='sum(st * pnl) / sum(st)', max_drawdown='max(dd)')} FROM f GROUP BY 1""")
def tiered_staking(spark, sf):
    return staking.staking_report(bets(spark, sf), ["season"], staking.tiered_units(F.col("p")), F.col("date"), ["date", "game_key"])


# D11
@query("compounding", with_("bets", f"SELECT season, count(*) AS days, {reals(balance='10000 * exp(sum(ln(greatest(1e-300, 1 + CASE WHEN n * 0.01 > 1 THEN 1.0 / n ELSE 0.01 END * u))))')} FROM (SELECT season, date, sum(pnl) AS u, count(*) AS n FROM bets GROUP BY 1, 2) GROUP BY 1"))
def compounding(spark, sf):
    return staking.compounding_balance(bets(spark, sf), ["season"], 0.01, 10000.0)


@query("capped_compounding")
def capped_compounding(spark, sf):
    return staking.capped_compounding(bets(spark, sf), ["season"], 0.01, 150.0, 10000.0)


# D12
@query("doubling_by_night")
def doubling_by_night(spark, sf):
    flat = staking.doubling_by_night(bets(spark, sf), ["season"], 10.0, None, 10000.0).withColumn("plan", F.lit("flat base"))
    return flat.unionByName(staking.doubling_by_night(bets(spark, sf), ["season"], 10.0, 0.005, 10000.0).withColumn("plan", F.lit("share of balance")))


@query("doubling_levels", with_("bets", "").rstrip() + """, o AS (SELECT *, coalesce(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS lc FROM bets WINDOW w AS (PARTITION BY season ORDER BY date, game_key)),
  p AS (SELECT *, coalesce(max(CASE WHEN pnl > 0 THEN lc END) OVER (PARTITION BY season ORDER BY date, game_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM o) SELECT game_key, CAST((lb - lw) % 3 AS BIGINT) AS level FROM p""")
def doubling_levels(spark, sf):
    """Per-bet doubling: the level of every bet without sequential state."""
    return staking.doubling_levels(bets(spark, sf), ["season"], F.col("date"), ["date", "game_key"]).select("game_key", "level")


# D13
@query("grade_cards", with_("games", "").rstrip() + f""", l AS (SELECT game_key // 2 AS card, game_key, line_open AS line, CASE WHEN game_key % 3 = 0 THEN 1 ELSE -1 END AS side, 1.8 + (game_key % 20) / 100.0 AS price, CASE WHEN game_key % 23 <> 0 THEN total END AS t FROM games),
  s AS (SELECT *, sign((t - line) * side) AS s FROM l), c AS (SELECT card, count(*) AS legs, count(t) AS known, min(s) AS worst, count(*) FILTER (s = 1) AS w, exp(sum(CASE WHEN s = 1 THEN ln(price) ELSE 0 END)) AS pays FROM s GROUP BY 1)
  SELECT card, legs, known, CASE WHEN worst = -1 THEN 'lost' WHEN known < legs THEN 'pending' WHEN w = 0 THEN 'void' ELSE 'won' END AS status, {reals(profit='CASE WHEN worst = -1 THEN -1.0 WHEN known = legs THEN pays - 1 END')} FROM c""")
def grade_cards(spark, sf):
    g, k = games(spark, sf), F.col("game_key")
    legs = g.select(F.expr("game_key div 2").alias("card"), "game_key", F.col("line_open").alias("line"), F.when(k % 3 == 0, 1).otherwise(-1).alias("side"), (1.8 + (k % 20) / 100.0).alias("price"))
    return staking.grade_cards(legs, g.where(k % 23 != 0).select("game_key", "total"), ["game_key"])


@query("grade_singles", with_("games", f"SELECT game_key, CASE WHEN game_key % 23 <> 0 THEN CAST(sign((total - line_open) * CASE WHEN game_key % 3 = 0 THEN 1 ELSE -1 END) AS BIGINT) END AS result, {reals(profit='CASE WHEN game_key % 23 = 0 THEN NULL WHEN total = line_open THEN 0 WHEN (total - line_open) * CASE WHEN game_key % 3 = 0 THEN 1 ELSE -1 END > 0 THEN 0.02 * (0.8 + (game_key % 20) / 100.0) ELSE -0.02 END')} FROM games"))
def grade_singles(spark, sf):
    g, k = games(spark, sf), F.col("game_key")
    led = g.select("game_key", F.col("line_open").alias("line"), F.when(k % 3 == 0, 1).otherwise(-1).alias("side"), (1.8 + (k % 20) / 100.0).alias("price"), F.lit(0.02).alias("stake"))
    return staking.grade_singles(led, g.where(k % 23 != 0).select("game_key", "total"), ["game_key"]).select("game_key", "result", "profit")


# D14, D15
@query("loss_decomposition", with_("box", "").rstrip() + f""", r AS (SELECT season, sum(fg3m) * 1.0 / sum(fg3a) AS r3, sum(ftm) * 1.0 / sum(fta) AS rf, sum(fgm - fg3m) * 1.0 / sum(fga - fg3a) AS r2 FROM box GROUP BY 1),
  g AS (SELECT game_key, season, sum(fg3m) AS m3, sum(fg3a) AS a3, sum(ftm) AS mf, sum(fta) AS af, sum(fgm - fg3m) AS m2, sum(fga - fg3a) AS a2 FROM box GROUP BY 1, 2)
  SELECT game_key, {reals(three_luck='3 * (m3 - a3 * r3)', ft_luck='mf - af * rf', two_luck='2 * (m2 - a2 * r2)')} FROM g JOIN r USING (season)""")
def loss_decomposition(spark, sf):
    return staking.shooting_luck(box(spark, sf)).drop("poss")


@query("failure_categories", with_("preds", f"SELECT season, CASE WHEN abs(home_pts - away_pts) >= 20 THEN 'blowout' WHEN abs(outcome - line - mu) > 1.5 * sd THEN 'model_error' ELSE 'variance' END AS category, count(*) AS n, {reals(mean_error='avg(outcome - line - mu)')} FROM preds WHERE outcome < line GROUP BY 1, 2"))
def failure_categories(spark, sf):
    p = preds(spark, sf).where(F.col("outcome") < F.col("line"))
    return staking.failure_categories(p).groupBy("season", "category").agg(F.count("*").alias("n"), F.avg("error").alias("mean_error"))


@query("neutral_shooting", with_("box", "").rstrip() + f""", rt AS (SELECT season, date, CASE WHEN b3a >= 5000 THEN b3m / b3a ELSE coalesce(p3, 0.34) END AS l3, CASE WHEN bfa >= 5000 THEN bfm / bfa ELSE coalesce(pf, 0.70) END AS lf FROM (
   SELECT d.season, d.date, coalesce(sum(m3) OVER w, 0) AS b3m, coalesce(sum(a3) OVER w, 0) AS b3a, coalesce(sum(mf) OVER w, 0) AS bfm, coalesce(sum(af) OVER w, 0) AS bfa, p3, pf
   FROM (SELECT season, date, sum(fg3m) AS m3, sum(fg3a) AS a3, sum(ftm) AS mf, sum(fta) AS af FROM box GROUP BY 1, 2) d JOIN (SELECT season, lag(m3) OVER (ORDER BY season) / lag(a3) OVER (ORDER BY season) AS p3, lag(mf) OVER (ORDER BY season) / lag(af) OVER (ORDER BY season) AS pf FROM (SELECT season, sum(fg3m) AS m3, sum(fg3a) AS a3, sum(ftm) AS mf, sum(fta) AS af FROM box GROUP BY 1)) f USING (season)
   WINDOW w AS (PARTITION BY d.season ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  SELECT game_key, team, {reals(neutral_pts='2 * (fgm - fg3m) + 3 * fg3a * l3 + fta * lf')} FROM box JOIN rt USING (season, date)""")
def neutral_shooting(spark, sf):
    """Points with league-average three-point and free-throw rates known before the date."""
    b = box(spark, sf)
    r3 = history.league_rates(b, "fg3m", "fg3a", 5000, 0.34, "l3")
    rf = history.league_rates(b, "ftm", "fta", 5000, 0.70, "lf")
    j = b.join(r3, ["season", "date"]).join(rf, ["season", "date"])
    return j.select("game_key", "team", (2 * (F.col("fgm") - F.col("fg3m")) + 3 * F.col("fg3a") * F.col("l3") + F.col("fta") * F.col("lf")).alias("neutral_pts"))


# D17
@query("max_playable_line", with_("preds", "").rstrip() + ", l AS (SELECT * FROM " + priced("(SELECT *, 1 AS side, CASE WHEN thr = floor(thr) THEN thr + 0.5 ELSE thr END AS t_eff FROM (SELECT *, floor(line) + 0.5 + i * 0.5e0 AS thr FROM preds, (SELECT unnest(range(-30, 31)) AS i)))") + f") SELECT game_key, {reals(max_line='max(thr) FILTER (p_cons >= 0.55)')} FROM l GROUP BY 1")
def max_playable_line(spark, sf):
    return cards.max_playable_line(preds(spark, sf), *fixed_calibrators(spark, sf), min_p=0.55)


# D20
@query("soft_vs_sharp", with_("quotes", "").rstrip() + f""", fl AS (SELECT fixture_id, book, line, arg_min(price, seq) FILTER (side='over' AND active) AS o, arg_min(price, seq) FILTER (side='under' AND active) AS u, min(seq) AS s0 FROM quotes GROUP BY 1, 2, 3),
  mn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id, book ORDER BY abs(1/o - 1/u), line) AS rn FROM fl WHERE o IS NOT NULL AND u IS NOT NULL) WHERE rn = 1)
  SELECT s.book, count(*) AS fixtures, {reals(mean_gap='avg(s.line - h.line)', share_over='avg(CASE WHEN h.line > s.line THEN 1.0 ELSE 0.0 END)')} FROM mn s JOIN mn h ON h.fixture_id = s.fixture_id AND h.book = '{SHARP}' WHERE s.book <> '{SHARP}' GROUP BY 1""")
def soft_vs_sharp(spark, sf):
    """Gap between each soft book's opening line and the sharp one's."""
    q = quotes(spark, sf)
    first = asof.open_close_ladder(q)
    tw = asof.two_way(first, ["fixture_id", "book", "line"], "open_price")
    imb = F.abs(1 / F.col("over") - 1 / F.col("under"))
    m = tw.groupBy("fixture_id", "book").agg(F.min_by("line", F.struct(imb, "line")).alias("line"))
    sharp = m.where(F.col("book") == SHARP).select("fixture_id", F.col("line").alias("sharp_line"))
    j = m.where(F.col("book") != SHARP).join(sharp, "fixture_id")
    return j.groupBy("book").agg(F.count("*").alias("fixtures"), F.avg(F.col("line") - F.col("sharp_line")).alias("mean_gap"), F.avg((F.col("sharp_line") > F.col("line")).cast("double")).alias("share_over"))


def _legs_by_decision(spark, sf, whens: dict[str, object]):
    """Value legs at several decision times at once: the times are an exploded key, one board pass."""
    from functools import reduce

    q = cut_lineage(quotes(spark, sf))
    curve = market.fair_curve(asof.close_board(q), SHARP)
    w = reduce(lambda a, b: a.unionByName(b), [f(q).withColumn("decision", F.lit(n)) for n, f in whens.items()])
    return market.value_legs(q, w, curve, SOFT, SHARP, finals(spark, sf), F.to_date("start"), extra=["decision"])


# D22, M16, J13
@query("execution_delay")
def execution_delay(spark, sf):
    """Legs and cards rebuilt at the sharp opener plus 0, 15, 30, 60 and 120 minutes and before the start."""
    whens = {f"open+{m:03d}": (lambda m: lambda q: asof.first_post(q, SHARP, m))(m) for m in (0, 15, 30, 60, 120)}
    whens |= {f"start-{h:02d}h": (lambda h: lambda q: asof.decision_at(q, h))(h) for h in (24, 12, 6, 3, 1)}
    whens["10am"] = lambda q: asof.at_local_hour(q, "Europe/Madrid", 10)
    l = cut_lineage(_legs_by_decision(spark, sf, whens))
    best = market.best_leg_per_game(l, ["decision", "date", "fixture_id"], F.col("price").between(1.4, 3.0)).withColumn("v", 1 + F.col("ev_now"))
    c = market.card_rows(market.best_pair(best, ["decision", "date"]), best, ["decision", "date"])
    cs = c.groupBy("decision").agg(F.count("*").alias("cards"), F.avg("ev").alias("card_ev"), F.avg("clv").alias("card_clv"))
    return l.groupBy("decision").agg(F.count("*").alias("legs"), F.avg("ev_now").alias("ev"), F.avg("clv").alias("clv")).join(cs, "decision", "left")


LEGS_PER_TASK = 4_000


@query("strategy_grid")
def strategy_grid(spark, sf):
    """Every rule (decision time x EV floor x odds band x books x model agreement x cards a date: 1,680) scored on all dates
    and on both halves, split at the median date. `best_a` marks the rule chosen on the first half, whose honest score is that of
    the second, `best_b` the reverse, `best_all` the one to lock. A choice needs 4 cards in its half, 8 overall."""
    whens = {f"{h}h": (lambda h: lambda q: asof.decision_at(q, h))(h) for h in (24, 12, 6, 3, 1)}
    whens |= {"open": lambda q: asof.first_post(q, SHARP, 0), "10am": lambda q: asof.at_local_hour(q, "Europe/Madrid", 10)}
    l = cut_lineage(_legs_by_decision(spark, sf, whens))
    arr = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rules = spark.range(1).select(arr(list(whens), "decision")).select("*", arr((-0.3, -0.2, -0.1, 0.0, 0.03), "ev_min"))
    rules = rules.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((1.4, 1.9), (1.5, 1.75), (1.55, 1.7), (1.7, 2.1))])).alias("band"))
    rules = rules.select("decision", "ev_min", "band.*").select("*", arr(("all", *SOFT[:2]), "books")).select("*", arr((False, True), "agree"))
    key = ["decision", "ev_min", "lo", "hi", "books", "agree"]
    # a leg meets 120 rules, so tasks are cut by legs instead of by bytes; the best leg of a rule and game is found without a shuffle
    dealt = l.repartition(1 + l.count() // LEGS_PER_TASK, "date", "fixture_id")
    x = dealt.join(F.broadcast(rules), "decision").where(                                 # 840 rows, fixed
        (F.col("ev_now") > F.col("ev_min")) & F.col("price").between(F.col("lo"), F.col("hi")) & ((F.col("books") == "all") | (F.col("books") == F.col("book")))
        & (~F.col("agree") | F.col("model_agrees")))
    group = [*key, "date"]
    b = cut_lineage(market.best_leg_per_game(x, group + ["fixture_id"]).withColumn("v", 1 + F.col("ev_now")))
    one = market.best_pair(b, group).withColumn("per_date", F.lit("1"))
    every = market.disjoint_pairs(b, group).withColumn("per_date", F.lit("all_disjoint"))
    c = market.card_rows(one.unionByName(every.select(one.columns)), b.withColumn("per_date", F.explode(F.array(F.lit("1"), F.lit("all_disjoint")))), group + ["per_date"])
    days = F.array_sort(F.collect_set("date"))                                            # one value per calendar day
    split = l.agg(F.element_at(days, (F.size(days) / 2).cast("int") + 1).alias("split"))
    c = c.crossJoin(F.broadcast(split)).withColumn("half", F.when(F.col("date") < F.col("split"), "a").otherwise("b"))      # one row
    key = [*key, "per_date"]
    g = c.groupBy(*key).agg(*[f(F.when(part, v)).alias(f"{h}_{n}") for h, part in (("all", F.lit(True)), ("a", F.col("half") == "a"), ("b", F.col("half") == "b"))
                              for n, f, v in (("cards", F.count, F.lit(1)), ("clv", F.avg, F.col("clv")), ("roi", F.avg, F.col("pnl")), ("won", F.avg, F.col("win").cast("double")))])
    g = cut_lineage(rules.select("*", arr(("1", "all_disjoint"), "per_date")).join(g, key, "left").na.fill(0, ["all_cards", "a_cards", "b_cards"]))
    best = lambda h, least: F.min_by(F.struct(*key), F.when(F.col(f"{h}_cards") >= least, F.struct(-F.col(f"{h}_clv"), *key))).alias(h)
    top = g.agg(best("a", 4), best("b", 4), best("all", 8))                               # one row
    g = g.crossJoin(F.broadcast(top.select(*[F.col(h).alias(f"_{h}") for h in ("a", "b", "all")])))
    return g.withColumns({f"best_{h}": F.coalesce(F.struct(*key) == F.col(f"_{h}"), F.lit(False)) for h in ("a", "b", "all")}).drop("_a", "_b", "_all")


# D21
@query("line_shopping_cards", with_("preds book_quotes", "").rstrip() + ", l AS (SELECT * FROM " + priced("""(SELECT *, CASE WHEN thr = floor(thr) THEN thr + 0.5 * side ELSE thr END AS t_eff FROM (SELECT p.*, side, line AS thr FROM preds p, (VALUES (1), (-1)) s(side) WHERE eligible))""") + f"""),
  o1 AS (SELECT *, p_cons * 1.909 AS vc FROM l), tp AS (SELECT * FROM (SELECT date, game_key, side, row_number() OVER (PARTITION BY date ORDER BY vc DESC, game_key DESC, side) AS r FROM o1) WHERE r <= 16),
  c AS (SELECT game_key, median(open) AS ml FROM book_quotes GROUP BY 1), q AS (SELECT b.*, ml, {DEC.format(a='open_over')} AS d_o, {DEC.format(a='open_under')} AS d_u FROM book_quotes b JOIN c USING (game_key) WHERE abs(open - ml) <= 3),
  gn AS (SELECT game_key, greatest(any_value(ml) - min(open) FILTER (d_o IS NOT NULL), 0) AS go, greatest(max(open) FILTER (d_u IS NOT NULL) - any_value(ml), 0) AS gu FROM q GROUP BY 1),
  o AS (SELECT o1.*, tp.r, thr - side * coalesce(CASE WHEN side = 1 THEN go ELSE gu END, 0) AS ts FROM o1 JOIN tp USING (date, game_key, side) LEFT JOIN gn USING (game_key)),
  x AS (SELECT a.date, a.game_key AS ga, b.game_key AS gb, a.vc * b.vc AS v, a.r AS ra, b.r AS rb, a.thr AS ta, b.thr AS tb, a.ts AS sa, b.ts AS sb,
     CASE WHEN a.side * (a.outcome - a.thr) < 0 OR b.side * (b.outcome - b.thr) < 0 THEN -1.0 ELSE CASE WHEN a.outcome = a.thr THEN 1 ELSE 1.909 END * CASE WHEN b.outcome = b.thr THEN 1 ELSE 1.909 END - 1 END AS profit,
     CASE WHEN a.side * (a.outcome - a.ts) < 0 OR b.side * (b.outcome - b.ts) < 0 THEN -1.0 ELSE CASE WHEN a.outcome = a.ts THEN 1 ELSE 1.909 END * CASE WHEN b.outcome = b.ts THEN 1 ELSE 1.909 END - 1 END AS ps
     FROM o a JOIN o b ON a.date = b.date AND a.game_key < b.game_key), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY v DESC, ra, rb) AS rn FROM x)
  SELECT strftime(date, '%Y-%m-%d') AS date, ga AS game_key_a, gb AS game_key_b, {reals(thr_a='ta', thr_shop_a='sa', thr_b='tb', thr_shop_b='sb', profit='profit', profit_shop='ps')} FROM r WHERE rn = 1""")
def line_shopping_cards(spark, sf):
    """Chosen cards regraded with each leg moved to the best book's number."""
    q = market.best_quotes(book_quotes(spark, sf))
    c = cards.odds_cards(cards.ladder_legs(preds(spark, sf), *fixed_calibrators(spark, sf), main_only=True), force=True)
    m = market.consensus(book_quotes(spark, sf))
    return cards.improve_by_best_book(c, q, m).select("date", "game_key_a", "game_key_b", "thr_a", "thr_shop_a", "thr_b", "thr_shop_b", "profit", "profit_shop")


# E2 spine: walk-forward -> calibrators -> ladder -> cards -> report
@query("backtest_spine")
def backtest_spine(spark, sf):
    from slatemill.plans.q_models import predictions

    p = cut_lineage(predictions(spark, sf).select("game_key", "season", "date", "line", "line_close", "outcome", "eligible", "mu", "sd", "mu_mkt", "sd_mkt"))
    cal, mkt = calibrate.fit_latent(p), calibrate.fit_latent(p, mu="mu_mkt", sd="sd_mkt")
    again = lambda few: cards.ladder_legs(p.join(F.broadcast(few), ["date", "game_key"], "left_semi"), cal, mkt)
    c = cut_lineage(cards.odds_cards(cards.ladder_legs(p, cal, mkt), force=True, again=again))
    rep = metrics.with_pooled(c, "season", [F.count("*").alias("cards"), F.count_if(F.col("profit") > 0).alias("won"), F.avg("combined_odds").alias("odds"), F.avg("profit").alias("roi"), F.sum("profit").alias("units")])
    lo, hi = metrics.wilson_interval(F.col("won"), F.col("cards"))
    return rep.withColumns({"hit_lo": lo, "hit_hi": hi})
