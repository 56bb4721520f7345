"""Queries for the point-in-time layer: windows over strictly earlier dates."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.operators import clean, history, metrics, running
from slatemill.plans.registry import ORACLE, query, reals
from slatemill.plans.standins import CTES, bets, box, games, player_box, with_

CTES["long"] = (("games",), """SELECT g.*, u.side, CASE WHEN u.side = 'home' THEN home ELSE away END AS team, CASE WHEN u.side = 'home' THEN home_pts ELSE away_pts END AS pf,
  CASE WHEN u.side = 'home' THEN away_pts ELSE home_pts END AS pa FROM games g, (VALUES ('home'), ('away')) u(side)""")
CTES["hist"] = (("long",), """SELECT *, CASE WHEN ok_close THEN total - line_close END AS resid_close, CASE WHEN ok_close THEN abs(total - line_close) END AS absres_close,
  CASE WHEN ok_open THEN total - line_open END AS resid_open, CASE WHEN ok_close AND ok_open THEN line_close - line_open END AS move,
  first_half * 1.0 / total AS fh_share FROM long""")
DAY = "strftime(date, '%Y-%m-%d') AS date"
HIST = ["resid_close", "absres_close", "resid_open", "move", "fh_share"]


def long_history(spark, sf):
    keep = ["game_key", "league", "season", "date", "total", "line_close", "line_open", "first_half", "ok_close", "ok_open"]
    l = clean.team_long(games(spark, sf), keep)
    c = F.col
    return l.withColumns({
        "resid_close": F.when(c("ok_close"), c("total") - c("line_close")), "absres_close": F.when(c("ok_close"), F.abs(c("total") - c("line_close"))),
        "resid_open": F.when(c("ok_open"), c("total") - c("line_open")),
        "move": F.when(c("ok_close") & c("ok_open"), c("line_close") - c("line_open")), "fh_share": c("first_half") / c("total")})


def ew_sql(rel: str, keys: str, cols: list[str], h: float, prefix: str) -> str:
    """Oracle relation: EW means of earlier dates."""
    sums = ", ".join(f"sum({c}) AS s_{c}, count({c}) AS c_{c}" for c in cols)
    out = ", ".join(f"sum(power(2.0, k / {h}) * s_{c}) OVER w / nullif(sum(power(2.0, k / {h}) * c_{c}) OVER w, 0) AS {prefix}{c}" for c in cols)
    return (f"SELECT {keys}, date, {out} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS k FROM "
            f"(SELECT {keys}, date, {sums} FROM {rel} GROUP BY {keys}, date)) "
            f"WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


# W3, P7
@query("ew_history", with_("hist", f"SELECT team, season, {DAY}, " + reals(**{f"h_{c}": f"h_{c}" for c in HIST})
                           + f" FROM ({ew_sql('hist', 'team, season', HIST, 8.0, 'h_')})"))
def ew_history(spark, sf):
    return history.ew_before(long_history(spark, sf), ["team", "season"], "date", HIST, 8.0)


# W1, W2
@query("rest_and_games", with_("long", f"""SELECT team, season, {DAY}, least(coalesce(date - lag(date) OVER (PARTITION BY team ORDER BY date), 10), 10) AS rest,
  CAST(coalesce(sum(n) OVER (PARTITION BY team, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS games
  FROM (SELECT team, season, date, count(*) AS n FROM long GROUP BY 1, 2, 3)"""))
def rest_and_games(spark, sf):
    return history.rest_and_count(long_history(spark, sf), ["team"], "date", 10, ["season"])


# W4
@query("rolling_stats", with_("long", f"""SELECT a.team, strftime(a.date, '%Y-%m-%d') AS date, {reals(l5='a.l5', sd20='a.sd20')} FROM (
  SELECT team, date, sum(s) OVER w5 / sum(n) OVER w5 AS l5, CASE WHEN sum(n) OVER w20 >= 5 THEN sqrt(greatest(0, (sum(q) OVER w20 - power(sum(s) OVER w20, 2) / sum(n) OVER w20) / (sum(n) OVER w20 - 1))) END AS sd20
  FROM (SELECT team, date, sum(pf) AS s, sum(pf * pf) AS q, count(*) AS n FROM long GROUP BY 1, 2)
  WINDOW w5 AS (PARTITION BY team ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (PARTITION BY team ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) a"""))
def rolling_stats(spark, sf):
    l = long_history(spark, sf)
    m = history.rolling_before(l, ["team"], "date", ["pf"], 5).withColumnRenamed("r_pf", "l5")
    s = history.rolling_before(l, ["team"], "date", ["pf"], 20, min_rows=5, sd=True).withColumnRenamed("r_pf", "sd20")
    return m.join(s, ["team", "date"])


# W5
@query("season_to_date", with_("long", f"""SELECT team, season, {DAY}, {reals(team_for='sum(s) OVER w / sum(n) OVER w', team_against='sum(a) OVER w / sum(n) OVER w')}
  FROM (SELECT team, season, date, sum(pf) AS s, sum(pa) AS a, count(*) AS n FROM long GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY team, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def season_to_date(spark, sf):
    d = history.rolling_before(long_history(spark, sf), ["team", "season"], "date", ["pf", "pa"], None)
    return d.withColumnsRenamed({"r_pf": "team_for", "r_pa": "team_against"})


# W6
@query("league_trailing", with_("games", f"""SELECT league, {DAY}, {reals(lg_drift='(sum(r) OVER w - sum(l) OVER w) / nullif(sum(c) OVER w, 0)', lg_line='sum(l) OVER w / nullif(sum(c) OVER w, 0)')}, slate_size
  FROM (SELECT league, date, coalesce(sum(total) FILTER (ok_close), 0) AS r, coalesce(sum(line_close) FILTER (ok_close), 0) AS l, count(*) FILTER (ok_close) AS c, count(*) AS slate_size FROM games GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY league ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)"""))
def league_trailing(spark, sf):
    g = games(spark, sf).withColumn("r", F.when(F.col("ok_close"), F.col("total") - F.col("line_close"))).withColumn("l", F.when(F.col("ok_close"), F.col("line_close")))
    d = history.rolling_before(g, ["league"], "date", ["r", "l"], 21).withColumnsRenamed({"r_r": "lg_drift", "r_l": "lg_line"})
    return d.join(g.groupBy("league", "date").agg(F.count("*").alias("slate_size")), ["league", "date"])


# W7, J12
@query("games_in_3_days", with_("long", f"""SELECT team, {DAY}, CAST(coalesce(sum(n) OVER (PARTITION BY team ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS recent
  FROM (SELECT team, date, count(*) AS n FROM long GROUP BY 1, 2)"""))
def games_in_3_days(spark, sf):
    return history.days_before(long_history(spark, sf), ["team"], "date", 3, "recent")


# W8, J12, F20
def venue_sql(team: str) -> str:
    return f"""st AS (SELECT season, min(d) OVER (ORDER BY season ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ws FROM (SELECT season, min(date) AS d FROM games GROUP BY 1)),
  ok_{team} AS (SELECT {team} AS tm, date, sum(total - line_close) AS s, count(*) AS n FROM games WHERE NOT neutral AND ok_close AND clean GROUP BY 1, 2),
  tg_{team} AS (SELECT DISTINCT {team}, season, date FROM games)"""


@query("venue_factor", with_("games", "").rstrip() + ", " + venue_sql("home") + f"""
  SELECT t.home, t.season, strftime(t.date, '%Y-%m-%d') AS date, {reals(venue_factor='coalesce(sum(o.s), 0) / (coalesce(sum(o.n), 0) + 40.0)')}
  FROM tg_home t JOIN st USING (season) LEFT JOIN ok_home o ON o.tm = t.home AND o.date < t.date AND o.date >= st.ws GROUP BY 1, 2, t.date""")
def venue_factor(spark, sf):
    return history.venue_factor(games(spark, sf))


# W9
@query("league_rates", with_("box", f"""SELECT season, {DAY}, {reals(l3='CASE WHEN ba >= 5000 THEN bm / ba ELSE coalesce(prev, 0.34) END')} FROM (
  SELECT d.season, d.date, coalesce(sum(m) OVER w, 0) AS bm, coalesce(sum(a) OVER w, 0) AS ba, f.prev
  FROM (SELECT season, date, sum(fg3m) AS m, sum(fg3a) AS a FROM box GROUP BY 1, 2) d JOIN
       (SELECT season, lag(fm) OVER (ORDER BY season) / lag(fa) OVER (ORDER BY season) AS prev FROM (SELECT season, sum(fg3m) AS fm, sum(fg3a) AS fa FROM box GROUP BY 1)) f USING (season)
  WINDOW w AS (PARTITION BY d.season ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def league_rates(spark, sf):
    return history.league_rates(box(spark, sf), "fg3m", "fg3a", 5000, 0.34, "l3")


# W10
@query("centred_values", with_("bets", f"""SELECT b.game_key, {reals(dev_c='(line_close - line) - coalesce(m, 0)')} FROM bets b JOIN (
  SELECT league, date, sum(s) OVER w / sum(n) OVER w AS m FROM (SELECT league, date, sum(line_close - line) AS s, count(*) AS n FROM bets GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY league ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) USING (league, date)"""))
def centred_values(spark, sf):
    b = bets(spark, sf).withColumn("dev", F.col("line_close") - F.col("line"))
    return history.centre_before(b, ["league"], "date", "dev", "dev_c").select("game_key", "dev_c")


# W11, O2
@query("top_n_daily", with_("bets", f"""SELECT game_key, strftime(date, '%Y-%m-%d') AS date, {reals(p='p')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC, game_key) AS rk FROM bets WHERE p >= 0.5)
  WHERE rk <= 2 OR p >= 0.64"""))
def top_n_daily(spark, sf):
    """Best two per day plus everything at or above 0.64."""
    b = bets(spark, sf).where(F.col("p") >= 0.5).select("game_key", "date", "p")
    return history.best_or_all(b, ["date"], 2, [F.col("p").desc(), F.col("game_key")], F.col("p") >= 0.64)


# W12, W13, D16
@query("equity_by_league", with_("bets", f"""SELECT league, {reals(units='any_value(units)', max_drawdown='max(greatest(0, pk) - eq)')}, CAST(any_value(lr) AS BIGINT) AS losing_run FROM (
    SELECT *, max(eq) OVER (PARTITION BY league ORDER BY date, game_key) AS pk FROM (
      SELECT league, date, game_key, sum(pnl) OVER (PARTITION BY league ORDER BY date, game_key ROWS UNBOUNDED PRECEDING) AS eq FROM bets)) e
  JOIN (SELECT league, sum(pnl) AS units FROM bets GROUP BY 1) USING (league)
  JOIN (SELECT league, max(c) AS lr FROM (SELECT league, isl, count(*) FILTER (pnl < 0) AS c FROM (
      SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY league ORDER BY date, game_key ROWS UNBOUNDED PRECEDING) AS isl FROM bets) GROUP BY 1, 2) GROUP BY 1) USING (league)
  GROUP BY league"""))
def equity_by_league(spark, sf):
    return metrics.equity_report(bets(spark, sf), ["league"], F.col("date"), ["date", "game_key"])


@query("equity_curve", with_("bets", f"SELECT game_key, {reals(equity='sum(pnl) OVER (ORDER BY date, game_key ROWS UNBOUNDED PRECEDING)')} FROM bets"))
def equity_curve(spark, sf):
    """W12 over one unbounded group: chunked by date."""
    return running.running_total(bets(spark, sf), [], F.col("date"), ["date", "game_key"], "pnl", "equity").select("game_key", "equity")


# W14
@query("season_weights", with_("games", f"SELECT season, count(*) AS n, {reals(w='any_value(power(0.6, greatest((SELECT max(season) FROM games) + 1 - season - 1, 0)))')} FROM games GROUP BY season"))
def season_weights(spark, sf):
    from pyspark.sql import Window

    s = games(spark, sf).groupBy("season").agg(F.count("*").alias("n"))
    age = F.max("season").over(Window.partitionBy()) + 1 - F.col("season")
    return s.withColumn("w", history.season_weight(age, 0.6))


# a roster of 15 distinct players for each team; three of them change teams every season
ROSTER = "CASE WHEN player % 15 < 3 THEN 100000 + (team + season) * 15 + player % 15 ELSE team * 15 + player % 15 END"


# W15, A18
@query("roster_continuity", with_("player_box", "").rstrip() + f""", pb AS (SELECT season, team, {ROSTER} AS player, date, minutes FROM player_box),
  tot AS (SELECT season, team, player, sum(minutes) AS m, min(date) AS first FROM pb GROUP BY 1, 2, 3),
  prv AS (SELECT season + 1 AS season, team, player, m AS own FROM tot), anyp AS (SELECT season, player, sum(own) AS anywhere FROM prv GROUP BY 1, 2),
  base AS (SELECT season, team, sum(own) AS base FROM prv GROUP BY 1, 2),
  f AS (SELECT t.season, t.team, t.first, coalesce(own, 0) AS own, coalesce(anywhere, 0) - coalesce(own, 0) AS other FROM tot t LEFT JOIN prv USING (season, team, player) LEFT JOIN anyp USING (season, player)),
  days AS (SELECT DISTINCT season, team, date FROM pb)
  SELECT d.season, d.team, strftime(d.date, '%Y-%m-%d') AS date, {reals(cont='CASE WHEN count(f.first) > 0 AND any_value(base) > 0 THEN sum(f.own) / any_value(base) END', xfer='CASE WHEN count(f.first) > 0 AND any_value(base) > 0 THEN sum(f.other) / any_value(base) END')}
  FROM days d LEFT JOIN base USING (season, team) LEFT JOIN f ON f.season = d.season AND f.team = d.team AND f.first < d.date GROUP BY 1, 2, d.date""")
def roster_continuity(spark, sf):
    return history.roster_continuity(player_box(spark, sf).withColumn("player", F.expr(ROSTER)))


# W16
@query("key_absence", with_("player_box", "").rstrip() + f""", m AS (SELECT season, team, date, game, {ROSTER} AS player, sum(minutes) AS m FROM player_box GROUP BY ALL),
  gr AS (SELECT season, team, date, game, row_number() OVER (PARTITION BY season, team ORDER BY date, game) - 1 AS j FROM (SELECT DISTINCT season, team, date, game FROM m)),
  ro AS (SELECT DISTINCT season, team, player FROM m),
  grid AS (SELECT gr.*, ro.player, coalesce(m.m, 0) AS m FROM gr JOIN ro USING (season, team) LEFT JOIN m USING (season, team, date, game, player)),
  g AS (SELECT *, avg(m) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r, avg(m) OVER (w ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS r1,
        avg(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, lag(m) OVER w AS l FROM grid WINDOW w AS (PARTITION BY season, team, player ORDER BY j))
  SELECT season, team, strftime(date, '%Y-%m-%d') AS date, game, j, {reals(out_share='CASE WHEN j >= 3 THEN sum(CASE WHEN r >= 8 AND m = 0 THEN r ELSE 0 END) / 200 END', back_share='CASE WHEN j >= 2 THEN sum(CASE WHEN a >= 8 AND l = 0 AND m > 0 THEN a ELSE 0 END) / 200 END')},
    CASE WHEN j >= 4 THEN count(*) FILTER (r1 >= 8 AND l = 0) END AS missed_last, CASE WHEN j >= 4 THEN count(*) FILTER (r1 >= 8 AND l = 0 AND m = 0) END AS missed_again
  FROM g GROUP BY season, team, date, game, j""")
def key_absence(spark, sf):
    pb = player_box(spark, sf).select("season", "team", "date", "game", F.expr(ROSTER).alias("player"), F.col("minutes").alias("m"))
    return history.key_player_absence(pb, 8.0)


# W17
@query("senior_night", with_("games", """SELECT home, season, max(game_key) AS game_key, max(strftime(date, '%Y-%m-%d')) AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY home, season ORDER BY date DESC, game_key DESC) AS rn FROM games WHERE NOT neutral) WHERE rn = 1 GROUP BY 1, 2"""))
def senior_night(spark, sf):
    """A team's last regular home game of the season: a schedule fact, found by an aggregate."""
    g = games(spark, sf).where(~F.col("neutral"))
    return g.groupBy("home", "season").agg(F.max(F.struct("date", "game_key")).alias("m")).select("home", "season", "m.*")


# W18
@query("referee_tendency", with_("games", "").rstrip() + f""", rf AS (SELECT game_key, date, unnest([game_key % 37, 40 + game_key % 29, 80 + game_key % 31]) AS ref, CASE WHEN ok_close THEN total - line_close END AS x FROM games),
  d AS (SELECT ref, date, sum(x) AS s, count(x) AS c FROM rf GROUP BY 1, 2), k AS (SELECT *, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY date) AS k FROM d),
  t AS (SELECT ref, date, sum(CASE WHEN c > 0 THEN power(2.0, k / 40.0) * s END) OVER w AS num, sum(CASE WHEN c > 0 THEN power(2.0, k / 40.0) * c END) OVER w AS den, max(k) OVER w AS lk FROM k
        WINDOW w AS (PARTITION BY ref ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT game_key, {reals(crew='avg(coalesce(num / den * (den / power(2.0, lk / 40.0)) / (den / power(2.0, lk / 40.0) + 15), 0))')} FROM rf JOIN t USING (ref, date) GROUP BY 1""")
def referee_tendency(spark, sf):
    g = games(spark, sf).withColumn("x", F.when(F.col("ok_close"), F.col("total") - F.col("line_close")))
    k = F.col("game_key")
    r = g.select("game_key", "date", "x", F.explode(F.array(k % 37, 40 + k % 29, 80 + k % 31)).alias("ref"))
    t = history.ew_shrunk_before(r, ["ref"], "date", "x", 40.0, 15.0, "t")
    return history.attach(r, t, ["ref"]).groupBy("game_key").agg(F.avg("t").alias("crew"))


# W19
@query("previous_meeting", with_("games", "").rstrip() + f""", g AS (SELECT *, CAST(least(home, away) AS VARCHAR) || '|' || CAST(greatest(home, away) AS VARCHAR) AS pair FROM games),
  d AS (SELECT season, pair, date, count(*) AS n, avg(CASE WHEN ok_close THEN total - line_close END) AS v FROM g GROUP BY 1, 2, 3),
  e AS (SELECT season, pair, date, CAST(coalesce(sum(n) OVER (PARTITION BY season, pair ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS meeting, lag(v) OVER (PARTITION BY season, pair ORDER BY date) AS prev FROM d)
  SELECT game_key, meeting, {reals(prev_value='prev')} FROM g JOIN e USING (season, pair, date)""")
def previous_meeting(spark, sf):
    g = games(spark, sf).withColumn("res", F.when(F.col("ok_close"), F.col("total") - F.col("line_close")))
    return history.previous_meeting(g, "res").select("game_key", "meeting", "prev_value")


# W20, F17
@query("forced_pair", with_("bets", "").rstrip() + f""", r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC, game_key) AS rk FROM bets)
  SELECT strftime(date, '%Y-%m-%d') AS date, count(*) FILTER (sign = 1) AS card_wins, {reals(p_a="max(p) FILTER (rk = 1)", p_b="max(p) FILTER (rk = 2)", double_profit="CASE WHEN min(sign) = -1 THEN -1.0 ELSE exp(sum(CASE WHEN sign = 1 THEN ln(price) ELSE 0 END)) - 1 END")}
  FROM r WHERE rk <= 2 GROUP BY date HAVING count(*) = 2""")
def forced_pair(spark, sf):
    from pyspark.sql import Window

    rk = F.row_number().over(Window.partitionBy("date").orderBy(F.col("p").desc(), "game_key"))
    r = bets(spark, sf).select("date", "p", "game_key", "sign", "price").withColumn("rk", rk).where(F.col("rk") <= 2)
    prod = F.exp(F.sum(F.when(F.col("sign") == 1, F.log("price")).otherwise(0.0))) - 1
    return r.groupBy("date").agg(
        F.count_if(F.col("sign") == 1).alias("card_wins"), F.max(F.when(F.col("rk") == 1, F.col("p"))).alias("p_a"),
        F.max(F.when(F.col("rk") == 2, F.col("p"))).alias("p_b"),
        F.when(F.min("sign") == -1, F.lit(-1.0)).otherwise(prod).alias("double_profit"), F.count("*").alias("n")).where("n = 2").drop("n")


# P5, P6, J3
STYLE = ["efg", "efg_allowed", "tpar", "tpar_allowed", "ftr", "ftr_allowed", "orb", "orb_allowed", "tovr", "tovr_forced", "pace"]
STYLE_SQL = dict(
    efg="(fgm + 0.5 * fg3m) / greatest(fga, 1)", efg_allowed="(fgm_opp + 0.5 * fg3m_opp) / greatest(fga_opp, 1)", tpar="fg3a / greatest(fga, 1)",
    tpar_allowed="fg3a_opp / greatest(fga_opp, 1)", ftr="fta / greatest(fga, 1)", ftr_allowed="fta_opp / greatest(fga_opp, 1)",
    orb="oreb / greatest(oreb + dreb_opp, 1)", orb_allowed="oreb_opp / greatest(oreb_opp + dreb, 1)", tovr="tov / poss", tovr_forced="tov_opp / poss",
    pace="poss", ortg="100.0 * pts / poss", drtg="100.0 * pts_opp / poss")
CTES["style"] = (("box",), "SELECT game_key, league, season, date, team, side, " + ", ".join(f"{v} AS {k}" for k, v in STYLE_SQL.items()) + " FROM box")


def style(spark, sf):
    return box(spark, sf).withColumns(clean.style_ratios())


@query("box_style", with_("style", "SELECT game_key, team, " + reals(**{s: s for s in STYLE_SQL}) + " FROM style"))
def box_style(spark, sf):
    return style(spark, sf).select("game_key", "team", *STYLE_SQL)


@query("style_history", with_("style", f"SELECT team, season, {DAY}, " + reals(**{f"s_{c}": f"s_{c}" for c in STYLE}) + f" FROM ({ew_sql('style', 'team, season', STYLE, 8.0, 's_')})"))
def style_history(spark, sf):
    return history.ew_before(style(spark, sf), ["team", "season"], "date", STYLE, 8.0, "s_")


# D18
@query("leakage_audit", with_("long", """SELECT count(*) FILTER (seen >= date) AS violations, count(seen) AS with_history, count(*) AS n FROM (
  SELECT team, date, lag(date) OVER (PARTITION BY team ORDER BY date) AS seen FROM (SELECT DISTINCT team, date FROM long))"""))
def leakage_audit(spark, sf):
    d = history.date_grain(long_history(spark, sf), ["team"], "date", [])
    d = d.withColumn("asof", F.max("date").over(history._past(["team"], "date")))
    return d.agg(F.count_if(F.col("asof") >= F.col("date")).alias("violations"), F.count("asof").alias("with_history"), F.count("*").alias("n"))


# Stage dummies, gaps and continuity interactions beside the histories
STAGES = ["nonconf", "conf_regular", "conf_tourney", "national"]
STAGE = "CASE WHEN month(date) >= 10 THEN 'nonconf' WHEN month(date) <= 2 THEN 'conf_regular' WHEN month(date) <= 4 THEN 'conf_tourney' ELSE 'national' END"


@query("study_frame", with_("games", "").rstrip() + f""", rc AS ({ORACLE['roster_continuity']}), s AS (SELECT game_key, {STAGE.replace('date', 'g.date')} AS stage, 64 + home % 9 AS th, 64 + away % 9 AS ta, 100 + home % 7 AS oh, 100 + away % 7 AS oa, 98 + home % 11 AS dh, 98 + away % 11 AS da,
    (home % 5 + away % 5 - 4) * 0.8e0 AS x, floor(round(h.cont * 1e6) / 100) / 1e4 AS hc, floor(round(a.cont * 1e6) / 100) / 1e4 AS ac, floor(round(h.xfer * 1e6) / 100) / 1e4 AS hx, floor(round(a.xfer * 1e6) / 100) / 1e4 AS ax
  FROM games g LEFT JOIN rc h ON h.team = g.home AND h.season = g.season AND h.date = strftime(g.date, '%Y-%m-%d') LEFT JOIN rc a ON a.team = g.away AND a.season = g.season AND a.date = strftime(g.date, '%Y-%m-%d'))
  SELECT game_key, {reals(st_nonconf="CASE WHEN stage = 'nonconf' THEN 1.0 ELSE 0.0 END", st_conf_tourney="CASE WHEN stage = 'conf_tourney' THEN 1.0 ELSE 0.0 END", st_national="CASE WHEN stage = 'national' THEN 1.0 ELSE 0.0 END",
    tempo_gap='CAST(abs(th - ta) AS DOUBLE)', eff_gap='CAST(abs(oh - da - (oa - dh)) AS DOUBLE)', cont_avg='(hc + ac) / 2', xfer_avg='(hx + ax) / 2', lowcont='1 - (hc + ac) / 2', x_pts_lowcont='x * (1 - (hc + ac) / 2)')} FROM s""")
def study_frame(spark, sf):
    g = games(spark, sf)
    rc = history.roster_continuity(player_box(spark, sf).withColumn("player", F.expr(ROSTER))).select(
        "season", "team", "date", *[(F.floor(F.round(F.round(c, 6) * 1e6) / 100) / 1e4).alias(c) for c in ("cont", "xfer")])
    for side in ("home", "away"):
        g = g.join(rc.select("season", "date", F.col("team").alias(side), F.col("cont").alias(f"{side}_cont"), F.col("xfer").alias(f"{side}_xfer")), ["season", "date", side], "left")
        g = g.withColumns({f"tempo_{side}": 64 + F.col(side) % 9, f"off_{side}": 100 + F.col(side) % 7, f"def_{side}": 98 + F.col(side) % 11})
    g = g.withColumns({"stage": F.expr(STAGE), "x_pts": (F.col("home") % 5 + F.col("away") % 5 - 4) * 0.8})
    new = clean.study_columns(STAGES, "conf_regular")
    d = g.withColumns(new)
    return d.select("game_key", *[F.col(n).cast("double").alias(n) for n in new])
