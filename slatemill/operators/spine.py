"""The feature frames that models train on: ratings, histories, style, league level and market joined game by game.

Every builder carries the latest date it has seen (`asof`), and the frame's `asof` is the latest of them, so a leak
anywhere shows as asof >= date (`history.leakage_violations`).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.operators import clean, history, ratings
from slatemill.session import cut_lineage

#: Feature names of the ladder, each rung added to those before it; the rungs of scores alone leave out the box columns.
LADDER = [
    ("F0_market_only", []), ("F1_naive_ppg", ["x_naive"]), ("F2_ratings", ["x_rating"]), ("F3_pace_eff", ["x_box", "x_pace_rel"]),
    ("F4_matchup", ["m_efg", "m_3par", "m_ftr", "m_orb", "m_tov"]), ("F5_rest_home", ["rest_sum", "b2b_any"]),
    ("F6_market", ["abs_spread", "line_tend_sum", "lg_total_minus_line", "line_rel"]),
    ("F7_context", ["early_season", "postseason", "log_games"]), ("F8_trends", ["ou_trend_sum"])]
BOX_FEATURES = {"x_box", "x_pace_rel", "m_efg", "m_3par", "m_ftr", "m_orb", "m_tov"}
MATCHUPS = (("efg", "efg", "efg_allowed"), ("3par", "tpar", "tpar_allowed"), ("ftr", "ftr", "ftr_allowed"), ("orb", "orb", "orb_allowed"), ("tov", "tov", "tov_forced"))


def feature_set(name: str, box: bool = True) -> list[str]:
    """All features up to and including the named rung; without `box` those that need a box score are left out."""
    names = [n for n, _ in LADDER]
    return [c for _, cols in LADDER[: names.index(name) + 1] for c in cols if box or c not in BOX_FEATURES]


def ladder_frame(games: DataFrame) -> DataFrame:
    """Games with both teams' states and every column of the ladder, as far as past dates allow.

    games: league, season, date, home, away, home_pts, away_pts, line, home_spread, postseason, box_home, box_away."""
    g = ratings.expected_points(games, ratings.team_states(games))
    long = clean.team_long(games, ["league", "season", "date"])
    rest = history.rest_and_count(long, ["league", "team"], "date", 7, ["season"])
    for side in ("home", "away"):
        g = g.join(rest.select("league", "season", "date", F.col("team").alias(side), F.col("rest").alias(f"{side}_rest")), ["league", "season", "date", side])
    pace = history.rolling_before(g, ["league", "season"], "date", ["box_exp_pace"], None, prefix="_m_")
    g = history.attach(g, pace, ["league", "season"])
    c, both = F.col, lambda n: F.col(f"home_{n}") + F.col(f"away_{n}")
    played = F.least("home_games", "away_games")
    return g.withColumns({
        "x_naive": c("naive_total") - c("line"), "x_rating": c("exp_home") + c("exp_away") - c("line"), "x_box": c("box_exp_total") - c("line"), "x_pace_rel": c("box_exp_pace") - c("_m_box_exp_pace"),
        **{f"m_{n}": both(own) + both(allowed) for n, own, allowed in MATCHUPS},
        "rest_sum": both("rest"), "b2b_any": (c("home_rest") == 1).cast("int") + (c("away_rest") == 1).cast("int"),
        "abs_spread": F.abs("home_spread"), "line_tend_sum": both("line_tend"), "lg_total_minus_line": c("lg_gap"), "line_rel": c("line") - c("lg_line"),
        "early_season": (played < 10).cast("int"), "postseason": c("postseason").cast("int"), "log_games": F.log1p(played), "ou_trend_sum": both("ou_trend")}).drop("_m_box_exp_pace")


# ------------------------------------------------------------------ market spine
def league_environment(games: DataFrame, dates: int = 21) -> DataFrame:
    """Per league date: slate size, and over the league's previous `dates` dates the mean closing line and how far totals ran
    above it; `league_asof` is the latest date seen."""
    ok = F.col("ok_close")
    d = games.groupBy("league", "date").agg(F.count("*").alias("slate_size"), F.sum(F.when(ok, F.col("total"))).alias("t"), F.sum(F.when(ok, F.col("line_close"))).alias("l"), F.count_if(ok).alias("n"))
    w = history._past(["league"], "date", dates)
    n = F.nullif(F.sum("n").over(w), F.lit(0))
    return d.select("league", "date", "slate_size", ((F.sum("t").over(w) - F.sum("l").over(w)) / n).alias("lg_drift"), (F.sum("l").over(w) / n).alias("lg_line"),
                    F.max("date").over(w).alias("league_asof"))


def spine(games: DataFrame, hist: DataFrame, style: DataFrame, past: list[str], styles: list[str], rated: DataFrame | None = None) -> DataFrame:
    """One row per game: both teams' histories (`home_h_..`), rest and games, style (`home_s_..`), league environment and, with
    `rated` (games with possessions), opponent-adjusted ratings as rt_..; `asof` is the latest date any of them saw.

    hist: team, season, date and the columns `past`; style: the same with `styles`."""
    h = history.ew_before(hist, ["team", "season"], "date", past, 8.0, asof="hist_asof")
    r = history.rest_and_count(hist, ["team"], "date", 10, ["season"], asof="rest_asof")
    s = history.ew_before(style, ["team", "season"], "date", styles, 8.0, "s_", asof="style_asof")
    per_team = h.join(r, ["team", "season", "date"]).join(s, ["team", "season", "date"], "left")
    g = games.join(league_environment(games), ["league", "date"])
    seen = ["hist_asof", "rest_asof", "style_asof"]
    for side in ("home", "away"):
        cols = [F.col(c).alias(f"{side}_{c}") for c in [f"h_{x}" for x in past] + ["rest", "games"] + [f"s_{x}" for x in styles] + seen]
        g = g.join(per_team.select(F.col("team").alias(side), "season", "date", *cols), [side, "season", "date"], "left")
    parts = ["league_asof", *[f"{side}_{c}" for side in ("home", "away") for c in seen]]
    if rated is not None:
        rt = cut_lineage(ratings.daily_ratings(rated))         # solved once, whatever reads the frame twice
        keys = ["league", "date", "home", "away", "neutral"]
        g = g.join(rt.select(*keys, F.col("asof").alias("rating_asof"), *[F.col(c).alias(f"rt_{c}") for c in ("n_home", "n_away", "pts_home", "pts_away", "poss", "eff_total")]), keys, "left")
        parts.append("rating_asof")
    return g.withColumn("asof", F.greatest(*parts))


def market_spine(frame: DataFrame) -> DataFrame:
    """The spine by market (opening, closing, second half): `clean.market_frame` and the columns that need the league, the
    histories of both teams and, where the spine has ratings, what these expect of points, efficiency and tempo
    against the market."""
    d = clean.market_frame(frame)
    c, both = F.col, lambda n: F.col(f"home_{n}") + F.col(f"away_{n}")
    d = d.withColumns({"line_rel": c("full_line") - c("lg_line"), "open_bias_sum": both("h_resid_open"), "move_hist_sum": both("h_move"), "log_slate": F.log1p("slate_size"),
                       "m_pace": both("s_pace"), **{f"m_{a}": both(f"s_{a}") + both(f"s_{b}") for a, b in (("efg", "efg_allowed"), ("tpar", "tpar_allowed"), ("ftr", "ftr_allowed"), ("orb", "orb_allowed"), ("tovr", "tovr_forced"))}})
    if "rt_poss" not in frame.columns:
        return d
    # a date's mean tempo per market, then the mean of its previous 30 dates
    tempo = d.groupBy("league", "market", "date").agg(F.avg("rt_poss").alias("_p"))
    w = Window.partitionBy("league", "market").orderBy("date").rowsBetween(-30, -1)
    d = d.join(tempo.select("league", "market", "date", F.avg("_p").over(w).alias("_trail")), ["league", "market", "date"])
    few = F.least("rt_n_home", "rt_n_away")
    d = d.withColumns({"x_pts": c("rt_pts_home") + c("rt_pts_away") - c("full_line"), "x_eff": c("rt_eff_total") - c("full_line"), "x_poss": c("rt_poss") - c("_trail"),
                       "early": F.coalesce((few < 6).cast("int"), F.lit(0)), "log_games": F.log1p(F.coalesce(few, F.lit(0.0))),
                       "x_home_tt": c("rt_pts_home") - c("implied_home"), "x_away_tt": c("rt_pts_away") - c("implied_away")}).drop("_trail")
    return d.withColumns({"x_tt_absdiff": F.abs(c("x_home_tt") - c("x_away_tt")), "x_pts_early": c("x_pts") * c("early"), "x_poss_early": c("x_poss") * c("early")})


#: Features of the mean and of the spread of the walk-forward models on the spine.
MEAN = ["x_pts", "x_eff", "x_poss", "line_rel", "mkt_bias_sum", "open_bias_sum", "move_hist_sum", "m_pace", "rest_min", "log_games", "x_tt_absdiff", "neutral_i"]
SPREAD = ["vol_sum", "abs_spread", "log_games", "line_rel"]
