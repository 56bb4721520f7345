"""Queries over the quote log: boards, curves, closing prices, main lines."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.functions import probability as P
from slatemill.functions.odds import book_margin, no_vig
from slatemill.operators import asof, market
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import SHARP, SOFT, finals, quotes, with_
from slatemill.session import cut_lineage

BOARD = """, whens AS (SELECT fixture_id, min(start) - INTERVAL {h} HOUR AS at FROM quotes GROUP BY 1),
last AS (SELECT q.*, row_number() OVER (PARTITION BY q.fixture_id, book, line, side ORDER BY t DESC, seq DESC) AS rn
         FROM quotes q JOIN whens w ON w.fixture_id = q.fixture_id AND q.t <= w.at),
board AS (SELECT fixture_id, book, line, side, t, price FROM last WHERE rn = 1 AND active AND price > 1),
tw AS (SELECT fixture_id, book, line, max(price) FILTER (side = 'over') AS over, max(price) FILTER (side = 'under') AS under
       FROM board GROUP BY 1, 2, 3 HAVING over IS NOT NULL AND under IS NOT NULL)
"""


def with_board(hours: int, names: str, body: str) -> str:
    return with_("quotes " + names, "").rstrip() + BOARD.format(h=hours) + body


@query("asof_best_line", with_board(6, "", f"""
SELECT fixture_id, book, line, {reals(over='over', under='under', p_fair='(1/over)/(1/over+1/under)', margin='1/over+1/under-1')}
FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY abs((1/over)/(1/over+1/under) - 0.5), line, book) AS rn FROM tw)
WHERE rn = 1"""))
def asof_best_line(spark, sf):
    """J6 -> P8 -> F10 -> W11: board six hours out, two-way prices, no-vig, most balanced line per fixture."""
    q = quotes(spark, sf)
    w = asof.two_way(asof.board_at(q, asof.decision_at(q, 6)), ["fixture_id", "book", "line"])
    w = w.withColumn("p_fair", no_vig(F.col("over"), F.col("under"))).withColumn("margin", book_margin(F.col("over"), F.col("under")))
    best = w.groupBy("fixture_id").agg(F.min_by(F.struct("book", "line", "over", "under", "p_fair", "margin"),
                                                F.struct(F.abs(F.col("p_fair") - 0.5), "line", "book")).alias("b"))
    return best.select("fixture_id", "b.*")


# ------------------------------------------------------------------ SQL pieces shared by the oracles
def horner(x: str, coefs: list[float]) -> str:
    acc = repr(float(coefs[0])) + "::DOUBLE"
    for c in coefs[1:]:
        acc = f"({acc} * {x} + ({c!r}::DOUBLE))"
    return acc


def cdf_sql(x: str) -> str:
    """Normal CDF; `x` should be a column name, it is repeated."""
    a = f"abs({x})"
    frac = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k} / {frac})"
    e = f"exp(-{a} * {a} / 2)"
    up = (f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {P.CDF_SPLIT} THEN {e} * {horner(a, P.CDF_NUM)} / {horner(a, P.CDF_DEN)} "
          f"ELSE {e} / {frac} / 2.506628274631 END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {up} ELSE {up} END)"


def ppf_from(rel: str, p: str, z: str) -> str:
    """Relation `rel` with a column z = normal quantile of column p (three nested steps)."""
    return (f"(SELECT * EXCLUDE (x0, s_), x0 - ({cdf_sql('x0')} - {p}) / (exp(-x0 * x0 / 2) / sqrt(2 * pi())) AS {z} FROM ("
            f"SELECT *, CASE WHEN {p} < {P.PPF_TAIL} THEN {horner('s_', P.PPF_C)} / {horner('s_', P.PPF_D)} "
            f"WHEN {p} > 1 - {P.PPF_TAIL} THEN -({horner('s_', P.PPF_C)}) / ({horner('s_', P.PPF_D)}) "
            f"ELSE {horner(f'(({p} - 0.5) * ({p} - 0.5))', P.PPF_A)} * ({p} - 0.5) / {horner(f'(({p} - 0.5) * ({p} - 0.5))', P.PPF_B)} END AS x0 "
            f"FROM (SELECT *, sqrt(-2 * ln(least({p}, 1 - {p}))) AS s_ FROM {rel})))")


def curve_cte(name: str, board: str, key: str = "fixture_id") -> str:
    """CTE text: fair curve of the sharp book from a board relation."""
    tw = (f"(SELECT {key}, line, greatest(0.02, least(0.98, p)) AS pc, p FROM (SELECT {key}, line, (1/o)/(1/o+1/u) AS p FROM ("
          f"SELECT {key}, line, max(price) FILTER (side='over') AS o, max(price) FILTER (side='under') AS u FROM {board} "
          f"WHERE book = '{SHARP}' GROUP BY {key}, line) WHERE o IS NOT NULL AND u IS NOT NULL AND (line * 2) % 2 = 1))")
    return f""", {name} AS (SELECT *, mz + b * ml AS a, (mz + b * ml) / b AS fair_mu FROM (
  SELECT {key}, CASE WHEN -slope > 1/40.0 THEN -slope ELSE 1/16.0 END AS b, mz, ml, main, lines FROM (
    SELECT {key}, CASE WHEN count(*) > 1 THEN regr_slope(z, line) END AS slope, avg(z) AS mz, avg(line) AS ml,
           arg_min(line, abs(p - 0.5) + line * 1e-13) AS main, count(*) AS lines FROM {ppf_from(tw, 'pc', 'z')} GROUP BY {key})))"""


CLOSE = """, cells AS (SELECT fixture_id, book, line, side, max(t) AS last_t, arg_max(active, seq) AS last_active,
   max(seq) FILTER (active AND price > 1) AS ls FROM quotes GROUP BY 1, 2, 3, 4),
ends AS (SELECT fixture_id, book, max(last_t) AS end_t FROM cells GROUP BY 1, 2),
closing AS (SELECT c.fixture_id, c.book, c.line, c.side, q.price FROM cells c JOIN ends USING (fixture_id, book) JOIN quotes q ON q.seq = c.ls
   WHERE last_active OR epoch(end_t) - epoch(last_t) <= 1800)"""


# J6
@query("asof_board", with_board(6, "", f"SELECT fixture_id, book, line, side, {reals(price='price')} FROM board"))
def asof_board(spark, sf):
    q = quotes(spark, sf)
    return asof.board_at(q, asof.decision_at(q, 6)).drop("t")


# J7
@query("next_change", with_board(24, "", f""", nxt AS (
  SELECT q.fixture_id, q.book, q.line, q.side, min(q.t) AS nt FROM quotes q JOIN whens w ON q.fixture_id = w.fixture_id AND q.t > w.at GROUP BY 1, 2, 3, 4),
j AS (SELECT b.book, (epoch_us(nt) - epoch_us(w.at)) / 60e6 AS m FROM board b JOIN whens w USING (fixture_id) LEFT JOIN nxt USING (fixture_id, book, line, side))
SELECT book, count(*) AS cells, count(m) AS changed, {reals(mean_minutes='avg(m)', survived_hour='avg(CASE WHEN m IS NULL OR m >= 60 THEN 1.0 ELSE 0.0 END)')}
FROM j GROUP BY book"""))
def next_change(spark, sf):
    q = quotes(spark, sf)
    when = asof.decision_at(q, 24)
    s = asof.next_change(asof.board_at(q, when), q, when)
    alive = F.coalesce(F.col("minutes") >= 60, F.lit(True)).cast("double")
    return s.groupBy("book").agg(F.count("*").alias("cells"), F.count("minutes").alias("changed"),
                                 F.avg("minutes").alias("mean_minutes"), F.avg(alive).alias("survived_hour"))


# J8
@query("close_board", with_("quotes", "").rstrip() + CLOSE + f" SELECT fixture_id, book, line, side, {reals(price='price')} FROM closing")
def close_board(spark, sf):
    return asof.close_board(quotes(spark, sf)).drop("t")


# J9, A13
def _ladder_with_ot(spark, sf):
    q = quotes(spark, sf)
    cells = asof.CELL
    asof_ladder = asof.open_close_ladder(q.withColumn("book", F.concat_ws("|", "book", F.col("incl_ot").cast("string"))))
    parts = F.split("book", r"\|")
    return asof_ladder.select("fixture_id", parts[0].alias("book"), *cells[2:], "open_price", "open_t", "close_price", "close_t",
                              "close_active", (parts[1] == "true").alias("incl_ot"))


@query("ladder_overtime", with_("quotes", "").rstrip() + """, lad AS (SELECT fixture_id, book, line, side, incl_ot,
    arg_min(price, seq) FILTER (active) AS open_price, arg_max(price, seq) FILTER (active) AS close_price, max(t) AS last_t,
    arg_max(active, seq) AS last_active, count(*) FILTER (active) AS n FROM quotes GROUP BY 1, 2, 3, 4, 5 HAVING n > 0),
  e AS (SELECT *, last_active OR epoch(max(last_t) OVER (PARTITION BY fixture_id, book, incl_ot)) - epoch(last_t) <= 1800 AS close_active,
        max(incl_ot) OVER (PARTITION BY fixture_id, book) AS has_ot FROM lad)
  SELECT fixture_id, book, line, side, close_active, """ + reals(open_price="open_price", close_price="close_price") + " FROM e WHERE incl_ot OR NOT has_ot")
def ladder_overtime(spark, sf):
    """Regulation-only lines drop where the book prices overtime-inclusive ones."""
    return asof.prefer_overtime_lines(_ladder_with_ot(spark, sf)).select(
        "fixture_id", "book", "line", "side", "close_active", "open_price", "close_price")


@query("main_lines", with_("quotes", "").rstrip() + """, lad AS (SELECT fixture_id, book, line, side,
    min(t) FILTER (active) AS open_t, arg_min(price, seq) FILTER (active) AS op, arg_max(price, seq) FILTER (active) AS cp, max(t) AS last_t,
    arg_max(active, seq) AS last_active FROM quotes GROUP BY 1, 2, 3, 4),
  e AS (SELECT *, last_active OR epoch(max(last_t) OVER (PARTITION BY fixture_id, book)) - epoch(last_t) <= 1800 AS ca FROM lad WHERE op IS NOT NULL),
  o AS (SELECT fixture_id, book, line, max(op) FILTER (side='over') AS po, max(op) FILTER (side='under') AS pu, min(open_t) AS ft FROM e GROUP BY 1, 2, 3),
  o2 AS (SELECT *, min(ft) OVER (PARTITION BY fixture_id, book) AS f0 FROM o WHERE abs(1/po - 1/pu) < 0.08),
  o3 AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, book ORDER BY abs(1/po - 1/pu), line) AS rn FROM o2 WHERE epoch(ft) <= epoch(f0) + 600),
  c AS (SELECT fixture_id, book, line, max(cp) FILTER (side='over') AS po, max(cp) FILTER (side='under') AS pu FROM e WHERE ca GROUP BY 1, 2, 3),
  c2 AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, book ORDER BY abs(1/po - 1/pu), line) AS rn FROM c WHERE po IS NOT NULL AND pu IS NOT NULL)
  SELECT fixture_id, book, a.line AS open_line, b.line AS close_line, """
       + reals(open_over="a.po", open_under="a.pu", close_over="b.po", close_under="b.pu")
       + " FROM (SELECT * FROM o3 WHERE rn = 1) a FULL JOIN (SELECT * FROM c2 WHERE rn = 1) b USING (fixture_id, book)")
def main_lines(spark, sf):
    return asof.main_lines(asof.open_close_ladder(quotes(spark, sf)))


# P8
@query("two_way_wide", with_board(6, "", f"SELECT fixture_id, book, line, {reals(over='over', under='under')} FROM tw"))
def two_way_wide(spark, sf):
    q = quotes(spark, sf)
    return asof.two_way(asof.board_at(q, asof.decision_at(q, 6)), ["fixture_id", "book", "line"])


# A17, F12
@query("fair_curve", with_("quotes", "").rstrip() + CLOSE + curve_cte("curve", "closing")
       + f" SELECT fixture_id, main, lines, {reals(a='a', b='b', fair_mu='fair_mu')} FROM curve")
def fair_curve(spark, sf):
    return market.fair_curve(asof.close_board(quotes(spark, sf)), SHARP)


LEGS = (CLOSE + curve_cte("curve", "closing") + curve_cte("nowc", "board")
        + f""", s0 AS (SELECT b.*, n.a, n.b AS nb, n.fair_mu, c.a AS ca, c.b AS cb, f.final, f.model, CAST(w.at + INTERVAL 6 HOUR AS DATE) AS date
     FROM board b JOIN nowc n USING (fixture_id) JOIN curve c USING (fixture_id) JOIN whens w USING (fixture_id) JOIN finals f USING (fixture_id)
     WHERE book <> '{SHARP}' AND (line * 2) % 2 = 1),
   per AS (SELECT fixture_id, date, first(model - fair_mu) AS dev FROM s0 GROUP BY 1, 2),
   daily AS (SELECT date, sum(dev) AS s, count(*) AS n FROM per GROUP BY 1),
   prior AS (SELECT date, sum(s) OVER w / sum(n) OVER w AS m FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
   zz AS (SELECT s0.*, a - nb * line AS zn, ca - cb * line AS zc, dev - coalesce(m, 0) AS dc FROM s0 JOIN per USING (fixture_id) JOIN prior ON prior.date = s0.date),
   pp AS (SELECT *, {cdf_sql('zn')} AS pn, {cdf_sql('zc')} AS pcl FROM zz),
   legs AS (SELECT fixture_id, date, book, line, side, price, CASE WHEN side='over' THEN pn ELSE 1 - pn END * price - 1 AS ev_now,
      CASE WHEN side='over' THEN pcl ELSE 1 - pcl END * price - 1 AS clv, CASE WHEN side='over' THEN dc > 0 ELSE dc < 0 END AS model_agrees,
      CASE WHEN side='over' THEN final > line ELSE final < line END AS win FROM pp),
   bestl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY ev_now DESC, price DESC, line DESC, side DESC, book DESC) AS rn
      FROM legs WHERE ev_now > -0.2 AND price BETWEEN 1.4 AND 3.0) WHERE rn = 1)""")


def _legs(spark, sf, hours: float = 6):
    q = quotes(spark, sf)
    curve = market.fair_curve(asof.close_board(q), SHARP)
    return market.value_legs(q, asof.decision_at(q, hours), curve, SOFT, SHARP, finals(spark, sf), F.to_date("start"))


# D7, F10, F11, W10
@query("value_legs", with_board(6, "finals", LEGS + f" SELECT fixture_id, strftime(date, '%Y-%m-%d') AS date, book, line, side, model_agrees, win, {reals(price='price', ev_now='ev_now', clv='clv')} FROM legs"))
def value_legs(spark, sf):
    return _legs(spark, sf)


def _best_legs(spark, sf):
    rule = (F.col("ev_now") > -0.2) & F.col("price").between(1.4, 3.0)
    return market.best_leg_per_game(_legs(spark, sf), ["date", "fixture_id"], rule).withColumn("v", 1 + F.col("ev_now"))


PAIRS = """, prs AS (SELECT a.date, a.fixture_id AS leg_a, b.fixture_id AS leg_b, (1 + a.ev_now) * (1 + b.ev_now) AS joint, a.price * b.price AS odds,
    (1 + a.clv) * (1 + b.clv) - 1 AS clv, a.win AND b.win AS win FROM bestl a JOIN bestl b ON a.date = b.date AND a.fixture_id < b.fixture_id
    WHERE a.price * b.price >= 2.5 - 1e-9)"""


@query("best_cards", with_board(6, "finals", LEGS + PAIRS + f""" SELECT strftime(date, '%Y-%m-%d') AS date, leg_a, leg_b, win,
   {reals(odds='odds', ev='joint - 1', clv='clv', pnl='CASE WHEN win THEN odds - 1 ELSE -1.0 END')}
   FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY joint DESC, leg_a, leg_b) AS rn FROM prs) WHERE rn = 1"""))
def best_cards(spark, sf):
    """One card per date, without forming pairs."""
    l = _best_legs(spark, sf)
    return market.card_rows(market.best_pair(l, ["date"]), l, ["date"])


# greedy picks one after another: a recursion that keeps the games already used
DISJOINT = """, bv AS (SELECT *, 1.15e0 + ev_now AS v FROM bestl), pv AS (SELECT a.date, a.fixture_id AS leg_a, b.fixture_id AS leg_b, a.v * b.v AS joint, a.price * b.price AS odds, (1 + a.clv) * (1 + b.clv) - 1 AS clv, a.win AND b.win AS win
    FROM bv a JOIN bv b ON a.date = b.date AND a.fixture_id < b.fixture_id WHERE a.price * b.price >= 2.5 - 1e-9 AND a.v * b.v > 1),
  gd AS (SELECT date, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS leg_a, CAST(NULL AS BIGINT) AS leg_b FROM (SELECT DISTINCT date FROM pv)
    UNION ALL SELECT date, used || [la, lb], la, lb FROM (SELECT g.date, g.used, p.leg_a AS la, p.leg_b AS lb, row_number() OVER (PARTITION BY g.date ORDER BY joint DESC, p.leg_a, p.leg_b) AS rn
      FROM gd g JOIN pv p ON p.date = g.date WHERE NOT list_contains(g.used, p.leg_a) AND NOT list_contains(g.used, p.leg_b)) WHERE rn = 1)"""


@query("disjoint_cards", with_board(6, "finals", LEGS + DISJOINT + f""" SELECT strftime(gd.date, '%Y-%m-%d') AS date, gd.leg_a, gd.leg_b, win, {reals(odds='odds', ev='joint - 1', clv='clv', pnl='CASE WHEN win THEN odds - 1 ELSE -1.0 END')}
  FROM gd JOIN pv ON pv.date = gd.date AND pv.leg_a = gd.leg_a AND pv.leg_b = gd.leg_b""").replace("WITH ", "WITH RECURSIVE ", 1))
def disjoint_cards(spark, sf):
    """D7 all_disjoint: greedy cards of every date, all dates at once."""
    l = cut_lineage(_best_legs(spark, sf).withColumn("v", F.col("v") + 0.15))
    return market.card_rows(market.disjoint_pairs(l, ["date"]), l, ["date"])
