"""Queries for cleaning, reshaping, features, set operations and scalar functions."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatemill.functions import dates, numbers, odds, text
from slatemill.operators import clean, history
from slatemill.plans.q_history import CTES, HIST, STYLE, ew_sql, long_history, style
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import bets, book_quotes, games, table, with_


# S1
@query("scan_subset", "SELECT o_orderkey AS game_key, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(NULL AS VARCHAR) AS venue_capacity FROM orders")
def scan_subset(spark, sf):
    """Wanted columns only; a column the files lack becomes a typed null; one row per id."""
    from slatemill.sources.tables import scan

    d = scan(spark, [f"{sf}/orders.parquet"], {"o_orderkey": "bigint", "o_orderdate": "timestamp", "venue_capacity": "string"}, ["o_orderkey"])
    return d.select(F.col("o_orderkey").alias("game_key"), F.year("o_orderdate").alias("season"), "venue_capacity")


# P1
@query("alias_map", """SELECT c_custkey, coalesce(code, 'x:' || c_mktsegment) AS code FROM customer LEFT JOIN (
  SELECT DISTINCT c_mktsegment, upper(left(c_mktsegment, 3)) AS code FROM customer WHERE c_mktsegment < 'H') USING (c_mktsegment)""")
def alias_map(spark, sf):
    c = table(spark, sf, "customer")
    al = c.select(F.col("c_mktsegment").alias("name")).where("name < 'H'").distinct().withColumn("code", F.upper(F.left("name", F.lit(3))))
    return clean.map_names(c, al, "c_mktsegment", "code", soft=True).select("c_custkey", "code")


# P2
@query("coerce_numbers", """SELECT l_orderkey, l_linenumber, sum(CASE WHEN upper(trim(t)) IN ('PK', 'P') THEN 0.0 ELSE TRY_CAST(t AS DOUBLE) END) AS v, count(*) AS n FROM (
  SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN ' pk ' WHEN 1 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS t FROM lineitem) GROUP BY 1, 2""")
def coerce_numbers(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    t = F.when(q % 4 == 0, " pk ").when(q % 4 == 1, "n/a").otherwise(q.cast("string"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(numbers.coerce_number(t)).alias("v"), F.count("*").alias("n"))


# P3, O6
@query("quality_flags", with_("games", """SELECT game_key, flags AS quality_flags, flags = '' AS clean FROM (SELECT game_key, concat_ws(';', CASE WHEN NOT (line_close BETWEEN 194 AND 207) THEN 'line_range' END,
   CASE WHEN abs(line_close - line_open) > 1.5 THEN 'move' END, CASE WHEN first_half > total THEN 'half_score' END,
   CASE WHEN count(*) OVER (PARTITION BY date, line_close, home_spread_close) >= 3 THEN 'placeholder' END,
   CASE WHEN count(*) OVER (PARTITION BY game_key) > 1 THEN 'duplicate' END) AS flags FROM games)"""))
def quality_flags(spark, sf):
    return clean.quality_flags(games(spark, sf), 194, 207, 1.5).select("game_key", "quality_flags", "clean")


# P4
@query("spread_sign", with_("games", "").rstrip() + f""", r AS (SELECT *, home_spread_close * CASE WHEN season % 2 = 0 THEN 1 ELSE -1 END AS raw, CASE WHEN home_spread_close > 0 THEN 1 ELSE -1 END AS fav FROM games),
  s AS (SELECT season, sign(corr(fav, raw)) AS sg FROM r GROUP BY 1) SELECT game_key, {reals(home_spread='CASE WHEN abs(raw * sg) <= 8 THEN raw * sg END')} FROM r JOIN s USING (season)""")
def spread_sign(spark, sf):
    g = games(spark, sf).withColumn("raw", F.col("home_spread_close") * F.when(F.col("season") % 2 == 0, 1).otherwise(-1))
    fav = F.when(F.col("home_spread_close") > 0, 1).otherwise(-1)
    return clean.spread_sign(g, "raw", fav, 8.0).select("game_key", "home_spread")


# P7
@query("team_long", with_("long", "SELECT game_key, side, team, pf, pa FROM long"))
def team_long(spark, sf):
    return clean.team_long(games(spark, sf), ["game_key"])


# P9, P10, P21 over W1-W3 and W6: the whole feature path
FEATS = ["h_" + c for c in HIST]


def feature_table(spark, sf):
    """Games with both teams' histories, rest, style and league environment attached."""
    l = long_history(spark, sf)
    h = history.ew_before(l, ["team", "season"], "date", HIST, 8.0)
    r = history.rest_and_count(l, ["team"], "date", 10, ["season"])
    s = history.ew_before(style(spark, sf), ["team", "season"], "date", STYLE, 8.0, "s_")
    per_team = h.join(r, ["team", "season", "date"]).join(s, ["team", "season", "date"], "left")
    g = games(spark, sf)
    for side in ("home", "away"):
        cols = [F.col(c).alias(f"{side}_{c}") for c in FEATS + ["rest", "games"] + ["s_" + c for c in STYLE]]
        g = g.join(per_team.select(F.col("team").alias(side), "season", "date", *cols), [side, "season", "date"], "left")
    return g


CTES["feat"] = (("hist", "style"), f"""SELECT g.*, {", ".join(f"{s}t.{c} AS {s}_{c}" for s in ("home", "away") for c in FEATS + ["rest", "games"])},
  {", ".join(f"{s}s.s_{c} AS {s}_s_{c}" for s in ("home", "away") for c in STYLE)}
  FROM games g {" ".join(f'''LEFT JOIN (SELECT e.*, r.rest, r.games FROM ({ew_sql('hist', 'team, season', HIST, 8.0, 'h_')}) e JOIN (
     SELECT team, season, date, least(coalesce(date - lag(date) OVER (PARTITION BY team ORDER BY date), 10), 10) AS rest,
       CAST(coalesce(sum(n) OVER (PARTITION BY team, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS games
     FROM (SELECT team, season, date, count(*) AS n FROM long GROUP BY 1, 2, 3)) r USING (team, season, date)) {s}t ON {s}t.team = g.{s} AND {s}t.season = g.season AND {s}t.date = g.date
     LEFT JOIN ({ew_sql('style', 'team, season', STYLE, 8.0, 's_')}) {s}s ON {s}s.team = g.{s} AND {s}s.season = g.season AND {s}s.date = g.date''' for s in ("home", "away"))}""")
EXP1H = "line_close * coalesce((home_h_fh_share + away_h_fh_share) / 2, home_h_fh_share, away_h_fh_share, 0.48)"


@query("market_frame", with_("feat", "").rstrip() + f""", m AS (
  SELECT *, 'open' AS market, line_open AS line, total AS outcome, home_spread_open AS spread, line_open AS full_line FROM feat WHERE ok_open UNION ALL
  SELECT *, 'close', line_close, total, home_spread_close, line_close FROM feat WHERE ok_close UNION ALL
  SELECT *, 'second_half', line_2h, second_half, home_spread_close, line_close FROM feat WHERE ok_2h)
  SELECT game_key, market, outcome = line AS push, CAST(outcome > line AS BIGINT) AS over, CAST(isodow(date) IN (6, 7) AS BIGINT) AS weekend, least(home_rest, away_rest) AS rest_min,
   {reals(line='line', resid='outcome - line', abs_spread='abs(spread)', move="CASE WHEN ok_open AND market <> 'open' THEN line_close - line_open END", vol_sum='home_h_absres_close + away_h_absres_close',
          mkt_bias_sum='home_h_resid_close + away_h_resid_close', fh_surplus=f"CASE WHEN market = 'second_half' THEN first_half - {EXP1H} END", implied_home='(full_line + spread) / 2',
          log_games='ln(1 + least(home_games, away_games))')} FROM m""")
def market_frame(spark, sf):
    return clean.market_frame(feature_table(spark, sf)).select(
        "game_key", "market", "push", "over", "weekend", "rest_min", "line", "resid", "abs_spread", "move", "vol_sum", "mkt_bias_sum", "fh_surplus", "implied_home", "log_games")


@query("derived_features", with_("feat", f"""SELECT game_key, home_rest + away_rest AS rest_sum, CAST((home_rest = 1)::INT + (away_rest = 1)::INT AS BIGINT) AS b2b_any,
  {reals(m_efg='home_s_efg + away_s_efg_allowed + away_s_efg + home_s_efg_allowed', m_3par='home_s_tpar + away_s_tpar_allowed + away_s_tpar + home_s_tpar_allowed', m_tov='home_s_tovr + away_s_tovr_forced + away_s_tovr + home_s_tovr_forced', m_home_orb='home_s_orb + away_s_orb_allowed')} FROM feat"""))
def derived_features(spark, sf):
    return clean.derived_features(feature_table(spark, sf)).select("game_key", "rest_sum", "b2b_any", "m_efg", "m_3par", "m_tov", "m_home_orb")


# P11
@query("season_stage", with_("games", """SELECT game_key, CASE WHEN month(date) IN (3, 4) AND home % 3 = 0 THEN 'ncaa_tournament' WHEN month(date) IN (3, 4) THEN 'other_postseason'
  WHEN game_key % 10 = 3 THEN 'conf_tournament' WHEN league % 2 = 0 THEN 'conf_regular' WHEN neutral THEN 'nonconf_neutral' ELSE 'nonconf_home' END AS stage FROM games"""))
def season_stage(spark, sf):
    s = {"post": F.month("date").isin(3, 4), "national": F.col("home") % 3 == 0, "tournament": F.col("game_key") % 10 == 3,
         "conference": F.col("league") % 2 == 0, "neutral": F.col("neutral")}
    return games(spark, sf).select("game_key", clean.season_stage(s).alias("stage"))


# P12
@query("fixed_buckets", with_("bets", f"SELECT CASE WHEN line < 195 THEN '[185, 195)' WHEN line < 200 THEN '[195, 200)' WHEN line < 205 THEN '[200, 205)' ELSE '[205, 215)' END AS bucket, count(*) AS n, {reals(roi='avg(pnl)')} FROM bets GROUP BY 1"))
def fixed_buckets(spark, sf):
    return bets(spark, sf).groupBy(clean.edge_bucket(F.col("line"), [185, 195, 200, 205, 215]).alias("bucket")).agg(F.count("*").alias("n"), F.avg("pnl").alias("roi"))


# P14, F1, F6
@query("season_labels", with_("games", """SELECT label, count(*) AS n FROM (SELECT CAST(year(date) - (month(date) < 8)::INT AS VARCHAR) || '-' || lpad(CAST((year(date) - (month(date) < 8)::INT + 1) % 100 AS VARCHAR), 2, '0') AS label FROM games) GROUP BY 1"""))
def season_labels(spark, sf):
    return games(spark, sf).groupBy(dates.season_label(F.col("date"), 8).alias("label")).agg(F.count("*").alias("n"))


# P15
@query("local_clock", """SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS us_date,
  strftime((date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Madrid') + INTERVAL 10 HOUR) AT TIME ZONE 'Europe/Madrid' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS madrid_10 FROM events""")
def local_clock(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", dates.local_date(ts, "America/New_York").alias("us_date"),
                                             F.date_format(dates.local_clock(ts, "Europe/Madrid", 10), "yyyy-MM-dd HH:mm:ss").alias("madrid_10"))


# P16
@query("median_impute", with_("box", "").rstrip() + f""", x AS (SELECT b.game_key, b.side, b.season, CASE WHEN game_key % 6 <> 0 THEN fg3m * 1.0 / fg3a END AS v FROM box b),
  md AS (SELECT s.season, (SELECT median(v) FROM x WHERE x.season < s.season) AS m FROM (SELECT DISTINCT season FROM x) s)
  SELECT game_key, side, {reals(v='coalesce(v, m)')} FROM x JOIN md USING (season)""")
def median_impute(spark, sf):
    """Gaps take the median of earlier seasons only."""
    from slatemill.operators.models import impute_from_earlier_seasons
    from slatemill.plans.standins import box

    b = box(spark, sf).select("game_key", "side", "season", F.when(F.col("game_key") % 6 != 0, F.col("fg3m") / F.col("fg3a")).alias("v"))
    return impute_from_earlier_seasons(b, "season", ["v"]).select("game_key", "side", "v")


# P17
@query("coalesce_sources", with_("games", f"SELECT game_key, {reals(line='coalesce(CASE WHEN ok_open THEN line_open END, CASE WHEN ok_close THEN line_close END, 200.0)')} FROM games"))
def coalesce_sources(spark, sf):
    return games(spark, sf).select("game_key", F.coalesce(F.when(F.col("ok_open"), F.col("line_open")), F.when(F.col("ok_close"), F.col("line_close")), F.lit(200.0)).alias("line"))


# P18, P20
@query("body_clock", with_("games", """SELECT game_key, 12 + game_key % 11 + CASE WHEN away % 5 < 4 THEN -(5 + away % 5) ELSE -5 END + 5 AS away_clock, abs(CASE WHEN home % 5 < 4 THEN -(5 + home % 5) ELSE -5 END - CASE WHEN away % 5 < 4 THEN -(5 + away % 5) ELSE -5 END) AS zone_shift,
  CASE WHEN home % 7 = 6 THEN NULL ELSE CAST(home % 7 IN (1, 3) AS BIGINT) END AS high_altitude FROM games"""))
def body_clock(spark, sf):
    g = games(spark, sf)
    zone = lambda t: F.when(F.col(t) % 5 < 4, -(5 + F.col(t) % 5))
    city = F.when(F.col("home") % 7 != 6, F.col("home") % 7)
    return g.select("game_key", *[v.alias(k) for k, v in clean.body_clock(12 + F.col("game_key") % 11, zone("home"), zone("away")).items()],
                    F.when(city.isNotNull(), city.isin(1, 3).cast("int")).alias("high_altitude"))


# P19
@query("pending_slate", with_("games", """SELECT pending, season, count(*) AS n, count(total) AS with_result FROM (SELECT season, false AS pending, total FROM games WHERE date < DATE '2001-06-01'
  UNION ALL SELECT season, true, NULL FROM games WHERE date >= DATE '2001-06-01') GROUP BY 1, 2"""))
def pending_slate(spark, sf):
    g = games(spark, sf)
    cut = F.lit("2001-06-01").cast("date")
    s = clean.add_slate(g.where(F.col("date") < cut), g.where(F.col("date") >= cut).drop("home_pts", "away_pts", "total", "first_half", "second_half"))
    return s.groupBy("pending", "season").agg(F.count("*").alias("n"), F.count("total").alias("with_result"))


# P22
@query("era_filter", with_("games", "SELECT CASE WHEN season <= 1997 THEN 'discovery' WHEN season <= 1999 THEN 'validation' ELSE 'holdout' END AS era, count(*) AS n FROM games WHERE season <= 2000 GROUP BY 1"))
def era_filter(spark, sf):
    era = clean.era_of(F.col("season"), {"discovery": [1995, 1996, 1997], "validation": [1998, 1999], "holdout": [2000]})
    return games(spark, sf).withColumn("era", era).where(F.col("era").isNotNull()).groupBy("era").agg(F.count("*").alias("n"))


# O3, O4, O5, J10
@query("union_disjoint", with_("games", """SELECT 'archive' AS source, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM games WHERE season < 1999
  UNION ALL SELECT 'live', count(*), strftime(min(date), '%Y-%m-%d'), strftime(max(date), '%Y-%m-%d') FROM games WHERE season >= 1999"""))
def union_disjoint(spark, sf):
    from slatemill.sources.tables import union_sources

    g = games(spark, sf)
    u = union_sources({"archive": g.where("season < 1999"), "live": g.where("season >= 1999")}, "date")
    return u.groupBy("source").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("common_sample", with_("games", "SELECT season, count(*) AS n FROM games WHERE ok_close AND ok_open AND ok_2h GROUP BY 1"))
def common_sample(spark, sf):
    """Games every model predicted: chained semi joins on the key."""
    g = games(spark, sf)
    keep = g.where("ok_close").join(g.where("ok_open").select("game_key"), "game_key", "left_semi")
    return keep.join(g.where("ok_2h").select("game_key"), "game_key", "left_semi").groupBy("season").agg(F.count("*").alias("n"))


@query("bet_changes", with_("bets", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.game_key IS NULL THEN 'added' WHEN b.game_key IS NULL THEN 'dropped' ELSE 'kept' END AS status
  FROM (SELECT game_key FROM bets WHERE p >= 0.5) a FULL JOIN (SELECT game_key FROM bets WHERE p * price >= 1.0) b USING (game_key)) GROUP BY 1"""))
def bet_changes(spark, sf):
    """Bets kept, dropped and added between two rules."""
    b = bets(spark, sf)
    x = b.where(F.col("p") >= 0.5).select("game_key", F.lit(1).alias("a"))
    y = b.where(F.col("p") * F.col("price") >= 1.0).select("game_key", F.lit(1).alias("b"))
    s = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").otherwise("kept")
    return x.join(y, "game_key", "full").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("drop_all_copies", "SELECT l_orderkey, l_linenumber, any_value(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def drop_all_copies(spark, sf):
    """A repeated key loses every copy; one aggregate, no window."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_suppkey").alias("l_suppkey")).where("n = 1").drop("n")


# O1, O2
@query("top_value", with_("bets", f"SELECT game_key, {reals(value='p * price')} FROM bets ORDER BY p * price DESC, p, game_key LIMIT 20"))
def top_value(spark, sf):
    """The day's report keeps the best 20 by value at the price (TakeOrderedAndProject)."""
    v = F.col("p") * F.col("price")
    return bets(spark, sf).orderBy(v.desc(), F.col("p").asc(), "game_key").limit(20).select("game_key", v.alias("value"))


# J1, J16
@query("outer_daily", with_("bets", f"""SELECT strftime(date, '%Y-%m-%d') AS date, coalesce(a.n, 0) AS overs, coalesce(b.n, 0) AS unders, {reals(u='coalesce(a.u, 0) + coalesce(b.u, 0)')}
  FROM (SELECT date, count(*) AS n, sum(pnl) AS u FROM bets WHERE side = 1 GROUP BY 1) a FULL JOIN (SELECT date, count(*) AS n, sum(pnl) AS u FROM bets WHERE side = -1 GROUP BY 1) b USING (date)"""))
def outer_daily(spark, sf):
    b = bets(spark, sf)
    part = lambda s, n: b.where(F.col("side") == s).groupBy("date").agg(F.count("*").alias(n), F.sum("pnl").alias(f"u_{n}"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return part(1, "overs").join(part(-1, "unders"), "date", "full").select(
        "date", z("overs").alias("overs"), z("unders").alias("unders"), (F.coalesce("u_overs", F.lit(0.0)) + F.coalesce("u_unders", F.lit(0.0))).alias("u"))


# J13, F8
@query("threshold_grid", with_("games", f"""SELECT side, CAST(k AS BIGINT) AS k, count(*) AS n, {reals(mean_thr='avg(thr)', win_rate='avg(CASE WHEN side * (total - thr) > 0 THEN 1.0 ELSE 0.0 END)')} FROM (
  SELECT total, side, k, CASE WHEN side = 1 THEN ceil(line_open + 0.5) - 0.5 ELSE floor(line_open - 0.5) + 0.5 END - side * k AS thr FROM games, (VALUES (1), (-1)) s(side), (SELECT unnest(range(0, 21)) AS k)) GROUP BY 1, 2"""))
def threshold_grid(spark, sf):
    g = games(spark, sf).select("total", "line_open", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    g = g.select("total", "line_open", "side", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    thr = numbers.half_point_threshold(F.col("line_open"), F.col("side")) - F.col("side") * F.col("k")
    g = g.withColumn("thr", thr)
    return g.groupBy("side", "k").agg(F.count("*").alias("n"), F.avg("thr").alias("mean_thr"), F.avg((F.col("side") * (F.col("total") - F.col("thr")) > 0).cast("double")).alias("win_rate"))


# F2, F3, F4, F5
@query("name_functions", r"""SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '([a-z0-9]{3,})'), lambda x: x NOT IN ('basketball','basket','club','the','bc','kk','bk','sad','team','fc','as','cb')), ' ') AS tokens,
  CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS brand_no, list_last(string_split(lower(trim(p_name)), ' ')) AS nick,
  CASE WHEN round(1 - levenshtein(p_name, 'small ring') * 1.0 / greatest(length(p_name), 10), 6) = 0 THEN 0.0 ELSE round(1 - levenshtein(p_name, 'small ring') * 1.0 / greatest(length(p_name), 10), 6) END AS sim FROM part""")
def name_functions(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.name_tokens(n), " ").alias("tokens"),
                                           F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("brand_no"), text.nickname(n).alias("nick"),
                                           text.edit_ratio(n, F.lit("small ring")).alias("sim"))


@query("person_keys", """SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(s_name || '-' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || 'Şa Jr.'), 'ş', 's'), '-', ' ', 'g'), '[^a-z ]', '', 'g'), '( |^)jr( |$)', ' ', 'g')) AS key FROM supplier""")
def person_keys(spark, sf):
    """A hyphen parts names, so both spellings of a double name meet."""
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", text.person_key(F.concat("s_name", F.lit("-"), F.char((65 + F.col("s_suppkey") % 26).cast("int")), F.lit("Şa Jr."))).alias("key"))


@query("paired_list", "SELECT s_suppkey, array_to_string([s_name || ', ' || s_suppkey, 'B, ' || s_nationkey], '|') AS refs FROM supplier")
def paired_list(spark, sf):
    s = F.concat(F.col("s_name"), F.lit(", "), F.col("s_suppkey"), F.lit(", B, "), F.col("s_nationkey"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(text.paired_list(s), "|").alias("refs"))


# F7, F9, F10, F11, F12, F13, F17, F18
@query("odds_functions", with_("book_quotes", f"""SELECT game_key, book, {reals(over='o', under='u', p='(1/o)/(1/o+1/u)', margin='1/o+1/u-1', kelly='CASE WHEN o IS NOT NULL THEN greatest(0, (0.55*o - 1)/(o - 1)) / 8 END', american='CASE WHEN o >= 2 THEN (o-1)*100 WHEN o > 1 THEN -100/(o-1) END', clv_points='close - open')}
  FROM (SELECT *, CASE WHEN open_over >= 100 THEN 1 + open_over / 100.0 WHEN open_over <= -100 THEN 1 + 100.0 / abs(open_over) END AS o, CASE WHEN open_under >= 100 THEN 1 + open_under / 100.0 WHEN open_under <= -100 THEN 1 + 100.0 / abs(open_under) END AS u FROM book_quotes)"""))
def odds_functions(spark, sf):
    q = book_quotes(spark, sf).withColumns({"o": odds.american_to_decimal(F.col("open_over")), "u": odds.american_to_decimal(F.col("open_under"))})
    o, u = F.col("o"), F.col("u")
    return q.select("game_key", "book", o.alias("over"), u.alias("under"), odds.no_vig(o, u).alias("p"), odds.book_margin(o, u).alias("margin"),
                    odds.kelly_fraction(F.lit(0.55), o, 1 / 8).alias("kelly"), odds.decimal_to_american(o).alias("american"),
                    odds.points_clv(F.lit(1), F.col("close"), F.col("open")).alias("clv_points"))


def _over_sql() -> str:
    from slatemill.plans.q_market import cdf_sql

    return with_("games", "").rstrip() + f""", z AS (SELECT game_key, line_open = floor(line_open) AS whole, (floor(line_open) + 0.5 - line_open - mu) / 17.0 AS z1, (0.5 - mu) / 17.0 AS z2, (-0.5 - mu) / 17.0 AS z3
     FROM (SELECT *, (home % 5 + away % 5 - 4) * 0.5 AS mu FROM games)),
   p AS (SELECT game_key, 1 - {cdf_sql('z1')} AS po, CASE WHEN whole THEN {cdf_sql('z2')} - {cdf_sql('z3')} ELSE 0 END AS pp FROM z)
   SELECT game_key, {reals(p_over='greatest(1e-4, least(1 - 1e-4, po / greatest(1 - pp, 1e-9)))', p_push='pp')} FROM p"""


@query("over_probability", _over_sql())
def over_probability(spark, sf):
    """continuity-corrected, push-aware normal probability at the line."""
    from slatemill.operators.models import add_over_probability

    g = games(spark, sf).withColumn("mu", (F.col("home") % 5 + F.col("away") % 5 - 4) * 0.5)
    return add_over_probability(g, F.col("mu"), F.col("line_open"), F.lit(17.0)).select("game_key", "p_over", "p_push")


# F17
@query("settlement", with_("bets", "").rstrip() + f""", r AS (SELECT *, lead(sign) OVER w AS sign_b, lead(price) OVER w AS price_b FROM bets WINDOW w AS (PARTITION BY league, date ORDER BY game_key))
  SELECT game_key, sign AS result, {reals(single='pnl', card='CASE WHEN sign = -1 OR sign_b = -1 THEN -1.0 ELSE CASE WHEN sign = 1 THEN price ELSE 1 END * CASE WHEN sign_b = 1 THEN price_b ELSE 1 END - 1 END')} FROM r WHERE sign_b IS NOT NULL""")
def settlement(spark, sf):
    w = Window.partitionBy("league", "date").orderBy("game_key")
    r = bets(spark, sf).select("game_key", "sign", "price", "pnl", F.lead("sign").over(w).alias("sb"), F.lead("price").over(w).alias("pb")).where(F.col("sb").isNotNull())
    return r.select("game_key", F.col("sign").alias("result"), F.col("pnl").alias("single"), odds.double_profit(F.col("sign"), F.col("price"), F.col("sb"), F.col("pb")).alias("card"))


# F19, F20, F21
@query("json_maps", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS missing, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS rebuilt FROM events""")
def json_maps(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), m["absent"].alias("missing"),
                                             F.to_json(F.struct(F.col("event_type").alias("type"), m["k"].alias("k"))).alias("rebuilt"))
