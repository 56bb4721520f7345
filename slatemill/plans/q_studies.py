"""Queries for studies of soft books against the sharp one."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from slatemill.operators import asof, studies
from slatemill.plans.q_market import CLOSE, cdf_sql, curve_cte
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import SHARP, SOFT, finals, quotes, with_
from slatemill.session import cut_lineage

HOURS = (24, 6, 1)
CAL_EDGES = [0, 0.4, 0.45, 0.5, 0.55, 0.6, 1]

#: Means of prices with two digits can lie on a tie of the rounding; query and SQL both move them off it.
OFF_TIES = 1e-9


def _off_ties(df, *cols):
    return df.withColumns({c: F.col(c) + OFF_TIES for c in cols})


_CHANCES = """(SELECT {keys}, line, (1/o)/(1/o+1/u) AS p, o, u FROM (SELECT {keys}, line, max(price) FILTER (side='over') AS o, max(price) FILTER (side='under') AS u
  FROM {board} WHERE book = '""" + SHARP + """' GROUP BY {keys}, line) WHERE o IS NOT NULL AND u IS NOT NULL)"""
_BOARDS = with_("quotes finals", "").rstrip() + CLOSE + f""", wh AS (SELECT fixture_id, h AS hours, min(start) - h * INTERVAL 1 HOUR AS at, date_trunc('week', min(start)) AS week FROM quotes, (VALUES (24), (6), (1)) v(h) GROUP BY 1, 2),
  lst AS (SELECT hours, q.*, row_number() OVER (PARTITION BY hours, q.fixture_id, book, line, side ORDER BY t DESC, seq DESC) AS rn FROM quotes q JOIN wh w ON w.fixture_id = q.fixture_id AND q.t <= w.at),
  brd AS (SELECT hours, fixture_id, book, line, side, price FROM lst WHERE rn = 1 AND active AND price > 1),
  sh AS {_CHANCES.format(keys='hours, fixture_id', board='brd')}, cs AS {_CHANCES.format(keys='fixture_id', board='closing')},
  res AS (SELECT fixture_id, final FROM finals WHERE fixture_id % 11 <> 0),
  px AS (SELECT b.hours, b.fixture_id, b.book, b.line, b.side, b.price, CASE WHEN b.side = 'over' THEN p ELSE 1 - p END * b.price - 1 AS ev FROM brd b JOIN sh USING (hours, fixture_id, line) WHERE b.book <> '{SHARP}')"""
_BETS = _BOARDS + """, bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hours, fixture_id, book ORDER BY ev DESC, line DESC, side DESC) AS rn FROM px WHERE ev >= 0.02) WHERE rn = 1),
  gv AS (SELECT bb.hours, bb.fixture_id, bb.book, bb.line, bb.side, bb.price, bb.ev, CASE WHEN bb.side = 'over' THEN cs.p ELSE 1 - cs.p END * bb.price - 1 AS clv, CAST(sign((final - bb.line) * CASE WHEN bb.side = 'over' THEN 1 ELSE -1 END) AS BIGINT) AS sign
    FROM bb LEFT JOIN cs ON cs.fixture_id = bb.fixture_id AND cs.line = bb.line LEFT JOIN res ON res.fixture_id = bb.fixture_id),
  gr AS (SELECT *, CASE sign WHEN 1 THEN price - 1 WHEN 0 THEN 0e0 WHEN -1 THEN -1e0 END AS pnl, CASE WHEN ev < 0.04 THEN '[0.02, 0.04)' WHEN ev < 0.07 THEN '[0.04, 0.07)' WHEN ev < 0.12 THEN '[0.07, 0.12)' ELSE '[0.12, 9)' END AS band FROM gv)"""
_MEASURES = "count(*) AS all_bets, count(sign) AS bets, count(*) FILTER (sign = 0) AS pushes, " + reals(
    clv_all="avg(clv)", won="avg(CASE WHEN sign = 1 THEN 1e0 WHEN sign = -1 THEN 0e0 END)", avg_price="avg(price) FILTER (sign IS NOT NULL) + 1e-9", roi="avg(pnl) + 1e-9",
    roi_se="stddev_samp(pnl) / sqrt(count(pnl))", clv="avg(clv) FILTER (sign IS NOT NULL)")


def boards(spark, sf):
    """The log and its boards 24, 6 and 1 hours before the start, in one pass; results are missing for one fixture in eleven."""
    q = cut_lineage(quotes(spark, sf))
    whens = reduce(lambda a, b: a.unionByName(b), [asof.decision_at(q, h).withColumn("hours", F.lit(h).cast("bigint")) for h in HOURS])
    return q, cut_lineage(asof.board_at(q, whens, extra=["hours"])), finals(spark, sf).where(F.col("fixture_id") % 11 != 0)


def value_bets(spark, sf):
    q, b, res = boards(spark, sf)
    bets = studies.best_value(studies.on_sharp_lines(b, SOFT, SHARP, ["hours", "fixture_id"]), ["hours", "fixture_id"])
    return studies.graded_value(bets, asof.close_board(q), res, SHARP), asof.starting_times(q)


# D9
@query("soft_value_bets", _BETS + f" SELECT hours, fixture_id, book, line, side, sign, {reals(price='price', ev='ev', clv='clv', pnl='pnl')} FROM gr")
def soft_value_bets(spark, sf):
    """Every bet of the value study, graded, with its value at the close."""
    return value_bets(spark, sf)[0].drop("p")


@query("soft_value_summary", _BETS + f""" SELECT hours, book, "window", band, {_MEASURES} FROM (SELECT gr.*, strftime(week, '%Y-%m-%d') AS "window" FROM gr JOIN wh USING (hours, fixture_id))
  GROUP BY GROUPING SETS ((hours, book), (hours, "window", book), (hours, band))""")
def soft_value_summary(spark, sf):
    bets, starts = value_bets(spark, sf)
    return _off_ties(studies.value_summary(bets.join(starts, "fixture_id"), "hours", F.date_format(F.date_trunc("week", "start"), "yyyy-MM-dd")), "avg_price", "roi")


@query("pricing_by_book", _BOARDS + f" SELECT hours, book, count(*) AS prices, {reals(mean_value='avg(ev)', above_fair='avg(CASE WHEN ev > 0 THEN 1e0 ELSE 0e0 END)', well_above='avg(CASE WHEN ev >= 0.02 THEN 1e0 ELSE 0e0 END)')} FROM px GROUP BY 1, 2")
def pricing_by_book(spark, sf):
    _, b, _ = boards(spark, sf)
    return studies.pricing_by_book(studies.on_sharp_lines(b, SOFT, SHARP, ["hours", "fixture_id"]), ["hours"])


@query("sharp_calibration", _BOARDS + f""" SELECT CASE WHEN p < 0.4 THEN '[0, 0.4)' WHEN p < 0.45 THEN '[0.4, 0.45)' WHEN p < 0.5 THEN '[0.45, 0.5)' WHEN p < 0.55 THEN '[0.5, 0.55)' WHEN p < 0.6 THEN '[0.55, 0.6)' ELSE '[0.6, 1)' END AS band,
  count(*) AS lines, {reals(predicted='avg(p)', happened='avg(CASE WHEN final > line THEN 1e0 ELSE 0e0 END)')} FROM cs JOIN res USING (fixture_id) WHERE final <> line GROUP BY 1""")
def sharp_calibration(spark, sf):
    q = cut_lineage(quotes(spark, sf))
    return studies.sharp_calibration(asof.close_board(q), finals(spark, sf).where(F.col("fixture_id") % 11 != 0), SHARP, CAL_EDGES)


@query("sharp_favoured_side", _BOARDS + f""", fv AS (SELECT hours, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS s, CASE WHEN p > 0.5 THEN o ELSE u END AS price, final - line AS d FROM sh JOIN res USING (fixture_id) WHERE abs(p - 0.5) > 0.005 AND final <> line)
  SELECT hours, count(*) AS bets, {reals(won='avg(CASE WHEN s * d > 0 THEN 1e0 ELSE 0e0 END)', avg_price='avg(price) + 1e-9', roi='avg(CASE WHEN s * d > 0 THEN price - 1 ELSE -1e0 END) + 1e-9')} FROM fv GROUP BY 1""")
def sharp_favoured_side(spark, sf):
    _, b, res = boards(spark, sf)
    f = studies.favoured_side(b, res, SHARP, ["hours", "fixture_id"])
    return _off_ties(f.groupBy("hours").agg(F.count("*").alias("bets"), F.avg((F.col("sign") == 1).cast("double")).alias("won"), F.avg("price").alias("avg_price"), F.avg("pnl").alias("roi")), "avg_price", "roi")


# D20
_GAPS = with_("quotes finals", "").rstrip() + CLOSE + f""", fp AS (SELECT fixture_id, book, min(greatest(o, u)) AS t FROM (SELECT fixture_id, book, line, min(t) FILTER (side='over') AS o, min(t) FILTER (side='under') AS u FROM quotes
    WHERE active AND price > 1 AND (line * 2) % 2 = 1 GROUP BY 1, 2, 3) WHERE o IS NOT NULL AND u IS NOT NULL GROUP BY 1, 2),
  bp AS (SELECT a.fixture_id, a.book AS soft, greatest(a.t, b.t) + INTERVAL 1 MILLISECOND AS at FROM fp a JOIN fp b ON b.fixture_id = a.fixture_id AND b.book = '{SHARP}' WHERE a.book <> '{SHARP}'),
  bl AS (SELECT soft, q.*, row_number() OVER (PARTITION BY soft, q.fixture_id, q.book, line, side ORDER BY t DESC, seq DESC) AS rn FROM quotes q JOIN bp ON bp.fixture_id = q.fixture_id AND q.t <= bp.at AND q.book IN (bp.soft, '{SHARP}')),
  gb AS (SELECT soft, fixture_id, book, line, side, price FROM bl WHERE rn = 1 AND active AND price > 1)""" + curve_cte("gnow", "gb", "soft, fixture_id") + curve_cte("gcl", "closing") + f""",
  gm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY soft, fixture_id ORDER BY abs(1/o - 1/u), line) AS rn FROM (SELECT soft, fixture_id, line, max(price) FILTER (side='over') AS o, max(price) FILTER (side='under') AS u
     FROM gb WHERE book = soft AND (line * 2) % 2 = 1 GROUP BY 1, 2, 3) WHERE o IS NOT NULL AND u IS NOT NULL) WHERE rn = 1),
  gj AS (SELECT gm.*, line - n.fair_mu AS gap, c.fair_mu AS close_mu, c.a - c.b * line AS zc, final FROM gm JOIN gnow n ON n.soft = gm.soft AND n.fixture_id = gm.fixture_id JOIN gcl c ON c.fixture_id = gm.fixture_id JOIN finals f ON f.fixture_id = gm.fixture_id),
  gp AS (SELECT *, CASE WHEN gap > 0 THEN 'under' ELSE 'over' END AS side, CASE WHEN gap > 0 THEN u ELSE o END AS price, {cdf_sql('zc')} AS pc FROM gj),
  gq AS (SELECT *, CASE WHEN side = 'over' THEN pc ELSE 1 - pc END * price - 1 AS clv, sign(line - close_mu) = sign(gap) AS stays, CASE WHEN (side = 'over') = (final > line) THEN price - 1 ELSE -1e0 END AS pnl FROM gp)"""


@query("opening_gaps", _GAPS + f" SELECT soft, fixture_id, line, side, stays, {reals(gap='gap', price='price', clv='clv', pnl='pnl')} FROM gq")
def opening_gaps(spark, sf):
    return studies.opening_gaps(quotes(spark, sf), finals(spark, sf), SOFT, SHARP)


@query("gap_table", _GAPS + f""" SELECT soft, CAST(k AS DOUBLE) AS least_gap, count(*) AS games, {reals(mean_gap='avg(abs(gap))', stays='avg(CASE WHEN stays THEN 1e0 ELSE 0e0 END)', clv='avg(clv)', won='avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END)', roi='avg(pnl) + 1e-9', roi_se='stddev_samp(pnl) / sqrt(count(*))')}
  FROM gq, (VALUES (0), (1), (2), (3)) v(k) WHERE abs(gap) >= k GROUP BY 1, 2""")
def gap_table(spark, sf):
    return _off_ties(studies.gap_table(studies.opening_gaps(quotes(spark, sf), finals(spark, sf), SOFT, SHARP), [0, 1, 2, 3]), "roi")


# D13
@query("ledger_closing_value", with_("quotes finals", "").rstrip() + CLOSE + curve_cte("lc", "cw") .replace("(line * 2) % 2 = 1", "((line * 2) % 2 = 1 OR fixture_id NOT IN (SELECT fixture_id FROM hf))").replace(", lc AS", f""", cw AS (SELECT * FROM closing),
  hf AS (SELECT DISTINCT fixture_id FROM (SELECT fixture_id, line FROM closing WHERE book = '{SHARP}' GROUP BY 1, 2 HAVING count(DISTINCT side) = 2) WHERE (line * 2) % 2 = 1), lc AS""", 1) + f""",
  pk AS (SELECT fixture_id, book, line, side, price, t FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id, book ORDER BY seq) AS rn FROM quotes WHERE active AND price > 1 AND book <> '{SHARP}') WHERE rn = 1),
  lt AS (SELECT fixture_id, max(t) AS last_t FROM quotes WHERE book = '{SHARP}' GROUP BY 1),
  lj AS (SELECT pk.*, a - b * line AS z, last_t > t AS later, f.final FROM pk LEFT JOIN lc USING (fixture_id) LEFT JOIN lt USING (fixture_id) LEFT JOIN (SELECT * FROM finals WHERE fixture_id % 11 <> 0) f USING (fixture_id)),
  lp AS (SELECT *, CASE WHEN later THEN CASE WHEN side = 'over' THEN {cdf_sql('z')} ELSE 1 - {cdf_sql('z')} END END AS close_p FROM lj WHERE z IS NOT NULL UNION ALL SELECT *, NULL FROM lj WHERE z IS NULL),
  lr AS (SELECT *, CASE WHEN final IS NULL THEN 'pending' WHEN final = line THEN 'push' WHEN (side = 'over') = (final > line) THEN 'won' ELSE 'lost' END AS result FROM lp)
  SELECT fixture_id, book, line, side, result, {reals(price='price', close_p='close_p', clv='close_p * price - 1', pnl="CASE result WHEN 'won' THEN price - 1 WHEN 'lost' THEN -1e0 WHEN 'push' THEN 0e0 END")} FROM lr""")
def ledger_closing_value(spark, sf):
    """Each soft book's first price as a recorded pick, graded, with its value at the sharp close."""
    q = cut_lineage(quotes(spark, sf))
    first = q.where(F.col("active") & (F.col("price") > 1) & F.col("book").isin(SOFT)).groupBy("fixture_id", "book").agg(F.min_by(F.struct("line", "side", "price", "t"), "seq").alias("p"))
    return studies.closing_value(first.select("fixture_id", "book", "p.*"), q, finals(spark, sf).where(F.col("fixture_id") % 11 != 0), SHARP).drop("t")
