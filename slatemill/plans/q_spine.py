"""Queries over the joined feature frames: the ladder, the market spine, its provenance, and models on them."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.operators import history, models, spine
from slatemill.operators.ratings import BOX_RATES, with_box_rates
from slatemill.plans.q_history import HIST, STYLE, long_history, style
from slatemill.plans.q_models import _BOX_SQL, rated_games
from slatemill.plans.q_tables import FEATS  # noqa: F401  registers the feature table
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import box, games, with_

MATCH_AT = {r: i for i, r in enumerate(BOX_RATES)}


# P10: every rung of the ladder, from states, box rates, rest and the market
def _ladder_sql() -> str:
    both = lambda r: f"(h.a{MATCH_AT[r]} + a.a{MATCH_AT[r]})"
    cols = {"x_naive": "naive - line", "x_rating": "rating - line", "x_box": "bx - line", "x_pace_rel": "pace - pm",
            **{f"m_{n}": f"m_{n}" for n, _, _ in spine.MATCHUPS}, "rest_sum": "hr + ar", "abs_spread": "abs(home_spread_close)", "line_tend_sum": "ltend", "lg_total_minus_line": "lg_total - lg_line",
            "line_rel": "line - lg_line", "log_games": "ln(1 + least(hg, ag))", "ou_trend_sum": "outrend"}
    return _BOX_SQL + f""",
  rs AS (SELECT league, team, date, least(coalesce(date - lag(date) OVER (PARTITION BY league, team ORDER BY date), 7), 7) AS rest FROM (SELECT DISTINCT league, team, date FROM sides)),
  fr0 AS (SELECT g.*, line_close AS line, (sh.pf + sa.pf + sh.pa + sa.pa) / 2 AS naive, lg_total + o[th.i] + f[ta.i] + o[ta.i] + f[th.i] AS rating, lg_total, lg_line, sh.games AS hg, sa.games AS ag, hr.rest AS hr, ar.rest AS ar,
      coalesce(sh.lt, 0) + coalesce(sa.lt, 0) AS ltend, coalesce(sh.ou, 0) + coalesce(sa.ou, 0) AS outrend, h.a0 * a.a0 / l0 AS pace, h.a0 * a.a0 / l0 * (h.a1 * a.a2 + a.a1 * h.a2) / l1 / 100 AS bx,
      {', '.join(f"{both(own)} + {both(allowed)} AS m_{n}" for n, own, allowed in spine.MATCHUPS)}
    FROM games g JOIN ld USING (league, date) JOIN core c ON c.league = ld.league AND c.k = ld.k JOIN tm th ON th.league = g.league AND th.team = g.home JOIN tm ta ON ta.league = g.league AND ta.team = g.away
      JOIN st sh ON sh.league = g.league AND sh.team = g.home AND sh.date = g.date JOIN st sa ON sa.league = g.league AND sa.team = g.away AND sa.date = g.date
      JOIN bs h ON h.league = g.league AND h.team = g.home AND h.date = g.date JOIN bs a ON a.league = g.league AND a.team = g.away AND a.date = g.date JOIN lb ON lb.league = g.league AND lb.date = g.date
      JOIN rs hr ON hr.league = g.league AND hr.team = g.home AND hr.date = g.date JOIN rs ar ON ar.league = g.league AND ar.team = g.away AND ar.date = g.date),
  pd AS (SELECT league, season, date, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS pm FROM (SELECT league, season, date, sum(pace) AS s, count(pace) AS n FROM fr0 GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY league, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT game_key, CAST((hr = 1)::INT + (ar = 1)::INT AS BIGINT) AS b2b_any, CAST(least(hg, ag) < 10 AS BIGINT) AS early_season, CAST(month(date) BETWEEN 5 AND 6 AS BIGINT) AS postseason, {reals(**cols)} FROM fr0 JOIN pd USING (league, season, date)"""


def ladder_games(spark, sf):
    g = with_box_rates(rated_games(spark, sf), box(spark, sf))
    spreads = games(spark, sf).select("game_key", F.col("home_spread_close").alias("home_spread"))
    return g.join(spreads, "game_key").withColumn("postseason", F.month("date").between(5, 6))


@query("ladder_frame", _ladder_sql())
def ladder_frame(spark, sf):
    d = spine.ladder_frame(ladder_games(spark, sf))
    ints = ["b2b_any", "early_season", "postseason"]
    names = [c for c in spine.feature_set("F8_trends") if c not in ints]
    return d.select("game_key", *[F.col(c).cast("long") for c in ints], *[F.col(c).cast("double") for c in names])


# M1, M2 on the rungs of the ladder: the walk-forward spread of errors by rung
@query("ladder_walk_forward")
def ladder_walk_forward(spark, sf):
    from slatemill.session import cut_lineage

    d = cut_lineage(spine.ladder_frame(ladder_games(spark, sf)).withColumns({"resid": F.col("total") - F.col("line"), "eligible": F.col("game_key") % 10 != 0})
                    .select("game_key", "season", "resid", "eligible", *spine.feature_set("F8_trends")))
    sets = {rung: spine.feature_set(rung) for rung in ("F2_ratings", "F4_matchup", "F8_trends")}
    p = d
    for rung, m in models.fit_nested_models(d.where("eligible"), sets).items():
        e = (F.col("resid") - models.linear_prediction(sets[rung])) ** 2
        p = p.join(F.broadcast(m), "season").withColumn(f"e_{rung}", e).drop(*models.MODEL)           # one row per season
    g = p.groupBy("season").agg(F.count("*").alias("n"), *[F.sqrt(F.avg(f"e_{r}")).alias(r) for r in sets])
    rungs = F.explode(F.array(*[F.struct(F.lit(r).alias("rung"), F.col("n"), F.col(r).alias("rmse")) for r in sets]))
    return g.select("season", rungs.alias("x")).select("season", "x.*")


# The spine by market, the columns that past dates decide without ratings
_SPINE_SQL = with_("feat", "").rstrip() + """, le AS (SELECT league, date, count(*) AS n, sum(total) FILTER (ok_close) AS t, sum(line_close) FILTER (ok_close) AS l, count(*) FILTER (ok_close) AS c FROM games GROUP BY 1, 2),
  lw AS (SELECT league, date, n AS slate_size, (sum(t) OVER w - sum(l) OVER w) / nullif(sum(c) OVER w, 0) AS lg_drift, sum(l) OVER w / nullif(sum(c) OVER w, 0) AS lg_line FROM le WINDOW w AS (PARTITION BY league ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, 'open' AS market, line_open AS full_line FROM feat WHERE ok_open UNION ALL SELECT *, 'close', line_close FROM feat WHERE ok_close UNION ALL SELECT *, 'second_half', line_close FROM feat WHERE ok_2h)"""


def spine_table(spark, sf, rated: bool = False):
    return spine.spine(games(spark, sf), long_history(spark, sf), style(spark, sf), HIST, STYLE, rated_games(spark, sf) if rated else None)


@query("market_spine", _SPINE_SQL + f""" SELECT game_key, market, {reals(line_rel='full_line - lg_line', lg_drift='lg_drift', open_bias_sum='home_h_resid_open + away_h_resid_open', move_hist_sum='home_h_move + away_h_move', log_slate='ln(1 + slate_size)',
   m_pace='home_s_pace + away_s_pace', m_efg='home_s_efg + away_s_efg + home_s_efg_allowed + away_s_efg_allowed', m_tovr='home_s_tovr + away_s_tovr + home_s_tovr_forced + away_s_tovr_forced', m_orb='home_s_orb + away_s_orb + home_s_orb_allowed + away_s_orb_allowed')}
   FROM m JOIN lw USING (league, date)""")
def market_spine(spark, sf):
    return spine.market_spine(spine_table(spark, sf)).select("game_key", "market", "line_rel", "lg_drift", "open_bias_sum", "move_hist_sum", "log_slate", "m_pace", "m_efg", "m_tovr", "m_orb")


# What every builder of the rated spine has seen, row by row
@query("spine_provenance", with_("style", "").rstrip() + """, td AS (SELECT team, season, date, max(date) OVER (PARTITION BY team, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, max(date) OVER (PARTITION BY team ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
      FROM (SELECT DISTINCT home AS team, season, date FROM games UNION SELECT DISTINCT away, season, date FROM games)),
  sd AS (SELECT team, season, date, max(date) OVER (PARTITION BY team, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM (SELECT DISTINCT team, season, date FROM style)),
  ll AS (SELECT league, date, n, lag(date) OVER (PARTITION BY league ORDER BY date) AS l, coalesce(sum(n) OVER (PARTITION BY league ORDER BY date RANGE BETWEEN INTERVAL 400 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS past,
      max(date) OVER (PARTITION BY league ORDER BY date RANGE BETWEEN INTERVAL 400 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS seen FROM (SELECT league, date, count(*) AS n FROM games GROUP BY 1, 2))
  SELECT game_key, strftime(g.date, '%Y-%m-%d') AS date, strftime(greatest(h.h, a.h), '%Y-%m-%d') AS hist_asof, strftime(greatest(h.r, a.r), '%Y-%m-%d') AS rest_asof, strftime(greatest(hs.s, s.s), '%Y-%m-%d') AS style_asof, strftime(l, '%Y-%m-%d') AS league_asof,
    strftime(CASE WHEN past >= 30 THEN seen END, '%Y-%m-%d') AS rating_asof, false AS leaks
  FROM games g JOIN td h ON h.team = g.home AND h.season = g.season AND h.date = g.date JOIN td a ON a.team = g.away AND a.season = g.season AND a.date = g.date JOIN ll ON ll.league = g.league AND ll.date = g.date
    LEFT JOIN sd hs ON hs.team = g.home AND hs.season = g.season AND hs.date = g.date LEFT JOIN sd s ON s.team = g.away AND s.season = g.season AND s.date = g.date""")
def spine_provenance(spark, sf):
    d = spine_table(spark, sf, rated=True)
    latest = lambda n: F.greatest(f"home_{n}", f"away_{n}").alias(n)
    leaks = F.coalesce(F.col("asof") >= F.col("date"), F.lit(False))
    return d.select("game_key", "date", latest("hist_asof"), latest("rest_asof"), latest("style_asof"), "league_asof", "rating_asof", leaks.alias("leaks"))


# M12 on the rated spine: two-stage walk-forward of the opening market
@query("walk_forward_spine")
def walk_forward_spine(spark, sf):
    from slatemill.session import cut_lineage

    d = spine.market_spine(spine_table(spark, sf, rated=True)).where("market = 'open'")
    d = cut_lineage(d.withColumn("eligible", F.col("clean") & F.col("x_pts").isNotNull()).select("game_key", "season", "resid", "eligible", "asof", "date", *dict.fromkeys(spine.MEAN + spine.SPREAD)))
    history.assert_no_leakage(d.select("asof", "date"))
    return models.walk_forward(d, spine.MEAN, spine.SPREAD).select("game_key", "season", "mu", "sd", "mu_mkt", "sd_mkt")
