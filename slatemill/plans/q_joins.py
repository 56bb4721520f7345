"""Queries for matching and resolution."""
from __future__ import annotations

from pyspark.sql import functions as F

from slatemill.operators import resolve
from slatemill.plans.registry import query, reals
from slatemill.plans.standins import CTES, games, player_box, table, with_
from slatemill.session import cut_lineage

# a second source of the same games: other ids, dates a day off for some, home and away exchanged for others
CTES["feed"] = (("games",), """SELECT game_key * 10 + 1 AS ext_id, CAST(date + INTERVAL 1 DAY * CASE WHEN game_key % 5 = 0 THEN 1 WHEN game_key % 7 = 0 THEN -1 ELSE 0 END AS DATE) AS date,
  CASE WHEN game_key % 6 = 0 THEN away ELSE home END AS home, CASE WHEN game_key % 6 = 0 THEN home ELSE away END AS away,
  CASE WHEN game_key % 6 = 0 THEN away_pts ELSE home_pts END AS home_pts, CASE WHEN game_key % 6 = 0 THEN home_pts ELSE away_pts END AS away_pts FROM games WHERE game_key % 11 <> 0""")


def feed(spark, sf):
    g, k = games(spark, sf).where(F.col("game_key") % 11 != 0), F.col("game_key")
    off = F.when(k % 5 == 0, 1).when(k % 7 == 0, -1).otherwise(0)
    pick = lambda a, b: F.when(k % 6 == 0, F.col(a)).otherwise(F.col(b))
    return g.select((k * 10 + 1).alias("ext_id"), F.date_add("date", off).alias("date"), pick("away", "home").alias("home"), pick("home", "away").alias("away"),
                    pick("away_pts", "home_pts").alias("home_pts"), pick("home_pts", "away_pts").alias("away_pts"))


# J2, A15
@query("match_by_score", with_("feed", """SELECT game_key, ext_id FROM (SELECT *, count(*) OVER (PARTITION BY ext_id) AS claims FROM (
  SELECT g.game_key, min(f.ext_id) AS ext_id FROM games g JOIN feed f ON greatest(g.home_pts, g.away_pts) = greatest(f.home_pts, f.away_pts) AND least(g.home_pts, g.away_pts) = least(f.home_pts, f.away_pts)
   AND abs(g.date - f.date) <= 1 GROUP BY 1 HAVING count(DISTINCT f.ext_id) = 1)) WHERE claims = 1"""))
def match_by_score(spark, sf):
    key = lambda d: d.withColumns({"hi": F.greatest("home_pts", "away_pts"), "lo": F.least("home_pts", "away_pts")})
    c = resolve.date_candidates(key(games(spark, sf)), key(feed(spark, sf)), ["hi", "lo"], "game_key", "ext_id")
    return resolve.match_unique(c, "game_key", "ext_id")


@query("match_by_teams", with_("feed", """SELECT game_key, ext_id FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY pri, game_key) AS r2 FROM (
  SELECT g.game_key, f.ext_id, abs(g.date - f.date) * 2 + CASE WHEN g.home = f.home THEN 0 ELSE 1 END AS pri, row_number() OVER (PARTITION BY g.game_key ORDER BY abs(g.date - f.date) * 2 + CASE WHEN g.home = f.home THEN 0 ELSE 1 END, f.ext_id) AS rn
  FROM games g JOIN feed f ON abs(g.date - f.date) <= 1 AND ((g.home = f.home AND g.away = f.away) OR (g.home = f.away AND g.away = f.home))) WHERE rn = 1) WHERE r2 = 1"""))
def match_by_teams(spark, sf):
    """Exact date, then a day off; either orientation; each feed game used once."""
    c = resolve.date_candidates(games(spark, sf), feed(spark, sf), ["home", "away"], "game_key", "ext_id", {"home": "away", "away": "home"})
    return resolve.match_first(c, "game_key", "ext_id")


@query("match_by_name_and_score", with_("feed", """SELECT game_key, ext_id FROM (SELECT *, count(*) OVER (PARTITION BY ext_id) AS claims FROM (
  SELECT g.game_key, min(f.ext_id) AS ext_id FROM games g JOIN feed f ON least(g.home, g.away) = least(f.home, f.away) AND greatest(g.home, g.away) = greatest(f.home, f.away) AND greatest(g.home_pts, g.away_pts) = greatest(f.home_pts, f.away_pts)
   AND least(g.home_pts, g.away_pts) = least(f.home_pts, f.away_pts) AND abs(g.date - f.date) <= 1 GROUP BY 1 HAVING count(DISTINCT f.ext_id) = 1)) WHERE claims = 1"""))
def match_by_name_and_score(spark, sf):
    key = lambda d: d.withColumns({"a": F.least("home", "away"), "b": F.greatest("home", "away"),
                                   "hi": F.greatest("home_pts", "away_pts"), "lo": F.least("home_pts", "away_pts")})
    c = resolve.date_candidates(key(games(spark, sf)), key(feed(spark, sf)), ["a", "b", "hi", "lo"], "game_key", "ext_id")
    return resolve.match_unique(c, "game_key", "ext_id")


# J15
@query("duplicate_records", with_("feed", "").rstrip() + """, rec AS (SELECT game_key * 2 AS game_key, date, home, away, home_pts, away_pts FROM games UNION ALL
   SELECT game_key * 2 + 1, CAST(date + INTERVAL 1 DAY AS DATE), away, home, away_pts, home_pts FROM games WHERE game_key % 20 = 3),
  k AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b, greatest(home_pts, away_pts) AS hi, least(home_pts, away_pts) AS lo FROM rec),
  c AS (SELECT *, sum(nw) OVER (PARTITION BY a, b, hi, lo ORDER BY date, game_key) AS isl FROM (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY a, b, hi, lo ORDER BY date, game_key) <= 1 THEN 0 ELSE 1 END AS nw FROM k)),
  z AS (SELECT *, count(*) OVER (PARTITION BY a, b, hi, lo, isl) AS size FROM c), fs AS (SELECT year(date) AS y, min(date) AS f FROM feed GROUP BY 1),
  sn AS (SELECT DISTINCT date, home, home_pts, away_pts, true AS seen FROM feed)
  SELECT game_key, coalesce(z.date < fs.f - INTERVAL 1 DAY, false) AS preseason, size > 1 AND seen IS NULL AS duplicate
  FROM z LEFT JOIN fs ON fs.y = year(z.date) LEFT JOIN sn ON sn.date = z.date AND sn.home = z.home AND sn.home_pts = z.home_pts AND sn.away_pts = z.away_pts""")
def duplicate_records(spark, sf):
    g = games(spark, sf)
    a = g.select((F.col("game_key") * 2).alias("game_key"), "date", "home", "away", "home_pts", "away_pts")
    b = g.where(F.col("game_key") % 20 == 3).select((F.col("game_key") * 2 + 1).alias("game_key"), F.date_add("date", 1).alias("date"), F.col("away").alias("home"),
                                                    F.col("home").alias("away"), F.col("away_pts").alias("home_pts"), F.col("home_pts").alias("away_pts"))
    return resolve.duplicates_and_preseason(a.unionByName(b), feed(spark, sf))


# J5
@query("majority_id", """SELECT p_name, p_brand, votes FROM (SELECT p_name, p_brand, count(*) AS votes, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1""")
def majority_id(spark, sf):
    return resolve.majority_id(table(spark, sf, "part"), "p_name", "p_brand")


# Fixtures are orders named after two parts; the feed writes the names differently
CTES["named"] = (("games",), """SELECT g.game_key, g.date, a.p_name || ' club ' || repeat(chr(CAST(97 + g.home % 26 AS INTEGER)), 3) || repeat(chr(CAST(97 + g.home % 7 AS INTEGER)), 3) AS home_name,
  b.p_name || ' club ' || repeat(chr(CAST(97 + g.away % 26 AS INTEGER)), 3) || repeat(chr(CAST(97 + g.away % 7 AS INTEGER)), 3) AS away_name FROM games g JOIN part a ON a.p_partkey = g.home JOIN part b ON b.p_partkey = g.away""")


def named(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    tail = lambda c: F.concat(F.lit(" club "), F.repeat(F.char(97 + F.col(c) % 26), F.lit(3)), F.repeat(F.char(97 + F.col(c) % 7), F.lit(3)))
    g = games(spark, sf).select("game_key", "date", "home", "away")
    g = g.join(p.select(F.col("p_partkey").alias("home"), F.col("p_name").alias("hn")), "home").join(p.select(F.col("p_partkey").alias("away"), F.col("p_name").alias("an")), "away")
    return g.select("game_key", "date", F.concat("hn", tail("home")).alias("home_name"), F.concat("an", tail("away")).alias("away_name"))


def _fuzzy_sql() -> str:
    stop = "('basketball','basket','club','the','bc','kk','bk','sad','team','fc','as','cb')"
    tok = lambda c: f"list_filter(regexp_extract_all(lower({c}), '([a-z0-9]{{3,}})'), lambda x: x NOT IN {stop})"
    share = lambda a, b: f"len(list_filter({a}, lambda t: len(list_filter({b}, lambda u: 1 - levenshtein(t, u) * 1.0 / greatest(length(t), length(u)) >= 0.8)) > 0)) * 1.0 / len({a})"
    sim = lambda a, b: f"(CASE WHEN len({a}) <= len({b}) THEN {share(a, b)} ELSE {share(b, a)} END)"
    return with_("named", "").rstrip() + f""", l AS (SELECT game_key + 1000000 AS fixture_id, CAST(date + INTERVAL 1 DAY * (game_key % 3 - 1) AS DATE) AS date, {tok("CASE WHEN game_key % 4 = 0 THEN away_name ELSE home_name || 'x' END")} AS ht,
      {tok("CASE WHEN game_key % 4 = 0 THEN home_name ELSE away_name END")} AS awt FROM named),
   r AS (SELECT game_key, date, {tok('home_name')} AS rht, {tok('away_name')} AS rat FROM named),
   s AS (SELECT fixture_id, game_key, least({sim('ht', 'rht')}, {sim('awt', 'rat')}) AS s1, least({sim('ht', 'rat')}, {sim('awt', 'rht')}) AS s2 FROM l JOIN r ON abs(l.date - r.date) <= 1),
   b AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY greatest(s1, s2) DESC, game_key) AS rn FROM s)
   SELECT fixture_id, CASE WHEN greatest(s1, s2) >= 0.5 THEN game_key END AS game_key, {reals(match_score='greatest(s1, s2)')}, greatest(s1, s2) >= 0.5 AND s2 > s1 AS swapped FROM b WHERE rn = 1"""


def _left_named(spark, sf):
    n, k = named(spark, sf), F.col("game_key")
    return n.select((k + 1000000).alias("fixture_id"), F.date_add("date", (k % 3 - 1).cast("int")).alias("date"),
                    F.when(k % 4 == 0, F.col("away_name")).otherwise(F.concat("home_name", F.lit("x"))).alias("home_name"),
                    F.when(k % 4 == 0, F.col("home_name")).otherwise(F.col("away_name")).alias("away_name"))


@query("fuzzy_fixtures", _fuzzy_sql())
def fuzzy_fixtures(spark, sf):
    """Edit-distance ratio, so SQL can say the same; the matcher ratio is the next query."""
    return resolve.match_fixtures(_left_named(spark, sf), named(spark, sf), exact_matcher=False)


@query("fuzzy_fixtures_matcher")
def fuzzy_fixtures_matcher(spark, sf):
    return resolve.match_fixtures(_left_named(spark, sf), named(spark, sf), exact_matcher=True)


@query("resolve_names")
def resolve_names(spark, sf):
    """Club names written with a stray last letter, resolved against the known ones."""
    n = named(spark, sf)
    known = n.select(F.col("home_name").alias("name"), F.col("home_name").alias("key"))
    return resolve.resolve_names(n.select(F.regexp_replace("home_name", "(.)$", "$1q").alias("name")), known)


# J14
@query("match_ids", with_("player_box", "").rstrip() + f""", lines AS (SELECT player * 7 + 3 AS pid, game, points + 0.5 * (game % 3 - 1) AS line FROM player_box),
  pair AS (SELECT l.pid, b.player, count(*) AS k, median(abs(l.line - b.points)) AS d FROM lines l JOIN player_box b USING (game) GROUP BY 1, 2),
  c AS (SELECT pid, player, d + 20 * (1 - k * 1.0 / n) AS cost FROM pair JOIN (SELECT pid, count(*) AS n FROM lines GROUP BY 1) USING (pid) WHERE k * 1.0 / n >= 0.5),
  f AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY cost, player) AS rk, lead(cost) OVER (PARTITION BY pid ORDER BY cost, player) AS nx, row_number() OVER (PARTITION BY player ORDER BY cost, pid) AS rb FROM c)
  SELECT pid, player, {reals(cost='cost', margin='nx - cost')} FROM f WHERE rk = 1 AND rb = 1""")
def match_ids(spark, sf):
    b = cut_lineage(player_box(spark, sf).select("game", "player", "points"))
    lines = b.select((F.col("player") * 7 + 3).alias("pid"), "game", (F.col("points") + 0.5 * (F.col("game") % 3 - 1)).alias("line"))
    return resolve.match_ids(lines, b.select("game", "player", F.col("points").alias("mu")))


# How sure a match is, from named ids hidden a fifth at a time
@query("id_margins", with_("player_box", "").rstrip() + f""", named AS (SELECT DISTINCT player * 7 + 3 AS pid, player, (player * 7 + 3) % 5 AS fold FROM player_box WHERE player % 4 <> 0),
  ln AS (SELECT player * 7 + 3 AS pid, game, points + 3.5 * ((game + player) % 5 - 2) AS line FROM player_box), hd AS (SELECT unnest(range(0, 5)) AS hidden),
  lines AS (SELECT l.*, hidden FROM ln l CROSS JOIN hd LEFT JOIN named n USING (pid) WHERE n.fold IS NULL OR n.fold = hidden), fc AS (SELECT b.*, hidden FROM player_box b CROSS JOIN hd LEFT JOIN named n USING (player) WHERE n.fold IS NULL OR n.fold = hidden),
  pair AS (SELECT hidden, l.pid, b.player, count(*) AS k, median(abs(l.line - b.points)) AS d FROM lines l JOIN fc b USING (hidden, game) GROUP BY 1, 2, 3),
  c AS (SELECT hidden, pid, player, d + 20 * (1 - k * 1.0 / n) AS cost FROM pair JOIN (SELECT hidden, pid, count(*) AS n FROM lines GROUP BY 1, 2) USING (hidden, pid) WHERE k * 1.0 / n >= 0.5),
  f AS (SELECT *, row_number() OVER (PARTITION BY hidden, pid ORDER BY cost, player) AS rk, lead(cost) OVER (PARTITION BY hidden, pid ORDER BY cost, player) AS nx, row_number() OVER (PARTITION BY hidden, player ORDER BY cost, pid) AS rb FROM c),
  v AS (SELECT coalesce(nx - cost, 1e6) AS gap, f.player = n.player AS hit FROM f JOIN named n ON n.pid = f.pid AND n.fold = f.hidden WHERE rk = 1 AND rb = 1),
  g AS (SELECT m AS margin, count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy FROM v, (SELECT unnest([0.0e0, 0.5e0, 1.0e0, 2.0e0, 4.0e0]) AS m) WHERE gap >= m GROUP BY 1)
  SELECT {reals(margin='margin', accuracy='accuracy')}, n, n >= 10 AND accuracy >= 0.9 AS ok FROM g""")
def id_margins(spark, sf):
    b = player_box(spark, sf)
    lines = b.select((F.col("player") * 7 + 3).alias("pid"), "game", (F.col("points") + 3.5 * ((F.col("game") + F.col("player")) % 5 - 2)).alias("line"))
    named = b.where(F.col("player") % 4 != 0).select((F.col("player") * 7 + 3).alias("pid"), "player").distinct()
    return resolve.margin_for_accuracy(lines, b.select("game", "player", F.col("points").alias("mu")), named, F.col("pid") % 5, [0.0, 0.5, 1.0, 2.0, 4.0], 0.9)
