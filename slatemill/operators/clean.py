"""Column clean-up, quality flags and reshaping of game and box tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip


# ------------------------------------------------------------------ names and coercion
def map_names(df: DataFrame, aliases: DataFrame, name: str, out: str, soft: bool = False) -> DataFrame:
    """Attach a code by name (aliases: name, code). Soft keeps unknown names as 'x:<name>'."""
    j = df.join(aliases.select(F.col("name").alias(name), F.col("code").alias(out)), name, "left")
    return j.withColumn(out, F.coalesce(out, F.concat(F.lit("x:"), F.col(name)))) if soft else j


def require_mapped(df: DataFrame, aliases: DataFrame, name: str) -> None:
    """Fail with a few examples when any name has no alias."""
    lost = df.select(name).distinct().join(aliases, df[name] == aliases["name"], "left_anti").take(5)
    if lost:
        raise ValueError(f"unmapped names: {[r[0] for r in lost]}")


# ------------------------------------------------------------------ quality
def quality_flags(games: DataFrame, lo: float, hi: float, max_move: float, placeholder: int = 3) -> DataFrame:
    """Outcome-blind tags: implausible total line, open-to-close jump, the same line and spread on
    `placeholder` or more games of a date, and repeated keys (every copy is flagged). The counts are
    grouped aggregates joined back, so a date with many games is not one window."""
    same = games.groupBy("date", "line_close", "home_spread_close").agg(F.count("*").alias("_same"))
    copies = games.groupBy("game_key").agg(F.count("*").alias("_copies"))
    g = (games.join(same, ["date", "line_close", "home_spread_close"], "left").join(copies, "game_key"))
    tag = lambda bad, text: F.when(bad, F.lit(text))
    tags = F.array_compact(F.array(
        tag(~F.col("line_close").between(lo, hi), "line_range"),
        tag(F.abs(F.col("line_close") - F.col("line_open")) > max_move, "move"),
        tag(F.col("first_half") > F.col("total"), "half_score"),
        tag(F.col("_same") >= placeholder, "placeholder"),
        tag(F.col("_copies") > 1, "duplicate")))
    return (g.withColumn("quality_flags", F.concat_ws(";", tags)).withColumn("clean", F.size(tags) == 0)
            .drop("_same", "_copies"))


def spread_sign(games: DataFrame, raw: str, favourite: Column, limit: float = 30.0) -> DataFrame:
    """Normalise a raw spread whose sign convention differs by season: multiply by the sign of its
    correlation with the known favourite, null beyond the limit."""
    sign = games.groupBy("season").agg(F.signum(F.corr(favourite, F.col(raw))).alias("_sign"))
    s = F.col(raw) * F.col("_sign")
    return games.join(F.broadcast(sign), "season").withColumn(       # one row per season
        "home_spread", F.when(F.abs(s) <= limit, s)).drop("_sign")


# ------------------------------------------------------------------ box scores
def possessions(ft: float) -> Column:
    """Mean of both teams' FGA - OREB + TOV + ft*FTA."""
    one = lambda x: F.col(f"fga{x}") - F.col(f"oreb{x}") + F.col(f"tov{x}") + ft * F.col(f"fta{x}")
    return 0.5 * (one("") + one("_opp"))


def style_ratios() -> dict[str, Column]:
    """Shooting, free-throw, rebound and turnover tendencies for and against, with guarded denominators."""
    c = F.col
    at_least_one = lambda x: F.greatest(x, F.lit(1))
    fga, fgo = at_least_one(c("fga")), at_least_one(c("fga_opp"))
    return {
        "efg": (c("fgm") + 0.5 * c("fg3m")) / fga, "efg_allowed": (c("fgm_opp") + 0.5 * c("fg3m_opp")) / fgo,
        "tpar": c("fg3a") / fga, "tpar_allowed": c("fg3a_opp") / fgo, "ftr": c("fta") / fga, "ftr_allowed": c("fta_opp") / fgo,
        "orb": c("oreb") / at_least_one(c("oreb") + c("dreb_opp")),
        "orb_allowed": c("oreb_opp") / at_least_one(c("oreb_opp") + c("dreb")),
        "tovr": c("tov") / c("poss"), "tovr_forced": c("tov_opp") / c("poss"), "pace": c("poss"),
        "ortg": 100.0 * c("pts") / c("poss"), "drtg": 100.0 * c("pts_opp") / c("poss")}


def with_opponent(box: DataFrame, stats: list[str]) -> DataFrame:
    """Attach the other side's counts: one aggregate per game puts both sides on a row, which is
    then unfolded again, so the table is read and shuffled once. A game has two sides."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.struct(*stats))).alias(side)
    wide = box.groupBy("game_key").agg(pick("home"), pick("away")).na.drop(subset=["home", "away"])
    both = F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("own"), F.col("away").alias("opp")),
                             F.struct(F.lit("away").alias("side"), F.col("away").alias("own"), F.col("home").alias("opp"))))
    return wide.select("game_key", both.alias("x")).select(
        "game_key", "x.side", *[F.col(f"x.own.{s}").alias(s) for s in stats], *[F.col(f"x.opp.{s}").alias(f"{s}_opp") for s in stats])


# ------------------------------------------------------------------ reshape
def team_long(games: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows per game (home and away view) from one pass over the games."""
    row = lambda s, o: F.struct(F.lit(s).alias("side"), F.col(s).alias("team"), F.col(f"{s}_pts").alias("pf"),
                                F.col(f"{o}_pts").alias("pa"))
    return games.select(*keep, F.explode(F.array(row("home", "away"), row("away", "home"))).alias("r")).select(*keep, "r.*")


def market_frame(f: DataFrame) -> DataFrame:
    """Rows per (game, market) for the opening, closing and second-half markets, with residual,
    result and the derived features that only need the row itself. One scan: the three markets are
    an exploded array, filtered by each market's own eligibility."""
    m = lambda name, ok, line, outcome, spread: F.when(F.col(ok), F.struct(
        F.lit(name).alias("market"), F.col(line).alias("line"), F.col(outcome).cast("double").alias("outcome"),
        F.col(spread).alias("spread"), F.col("line_open" if name == "open" else "line_close").alias("full_line")))
    d = f.withColumn("m", F.explode(F.array_compact(F.array(
        m("open", "ok_open", "line_open", "total", "home_spread_open"),
        m("close", "ok_close", "line_close", "total", "home_spread_close"),
        m("second_half", "ok_2h", "line_2h", "second_half", "home_spread_close")))))
    d = d.select("*", "m.*").drop("m")
    half = F.col("market") == "second_half"
    exp_1h = F.col("line_close") * F.coalesce((F.col("home_h_fh_share") + F.col("away_h_fh_share")) / 2,
                                              F.col("home_h_fh_share"), F.col("away_h_fh_share"), F.lit(0.48))
    c = F.col
    d = d.withColumns({
        "move": F.when(c("ok_open") & (c("market") != "open"), c("line_close") - c("line_open")),
        "fh_surplus": F.when(half, c("first_half") - exp_1h),
        "naive_2h": F.when(half, c("line_close") - c("first_half")),
        "x_2h_vs_naive": F.when(half, c("line_2h") - (c("line_close") - c("first_half"))),
        "x_2h_vs_pregame": F.when(half, c("line_2h") - (c("line_close") - exp_1h)),
        "fh_margin_abs": F.when(half, F.abs(c("home_1h") - c("away_1h"))),
        "abs_spread": F.abs("spread"), "vol_sum": c("home_h_absres_close") + c("away_h_absres_close"),
        "mkt_bias_sum": c("home_h_resid_close") + c("away_h_resid_close"),
        "rest_min": F.least("home_rest", "away_rest"),
        "min_games": F.least("home_games", "away_games"),
        "dow": F.weekday("date"), "month": F.month("date")})
    return d.withColumns({
        "early": (c("min_games") < 6).cast("int"), "log_games": F.log1p(F.coalesce(c("min_games"), F.lit(0))),
        "neutral_i": c("neutral").cast("int"), "weekend": c("dow").isin(5, 6).cast("int"), "march": (c("month") == 3).cast("int"),
        "implied_home": (c("full_line") + c("spread")) / 2, "implied_away": (c("full_line") - c("spread")) / 2,
        "resid": c("outcome") - c("line"), "over": (c("outcome") > c("line")).cast("int"), "push": c("outcome") == c("line")})


def derived_features(d: DataFrame) -> DataFrame:
    """Sums, differences and offence-versus-defence matchups used by the stage-one models."""
    c = F.col
    cols: dict[str, Column] = {}
    for side, opp in (("home", "away"), ("away", "home")):
        for name, own, allowed in (("efg", "efg", "efg_allowed"), ("3par", "tpar", "tpar_allowed"), ("ftr", "ftr", "ftr_allowed"),
                                   ("orb", "orb", "orb_allowed"), ("tov", "tovr", "tovr_forced")):
            cols[f"m_{side}_{name}"] = c(f"{side}_s_{own}") + c(f"{opp}_s_{allowed}")
    d = d.withColumns(cols)
    return d.withColumns({
        **{f"m_{n}": c(f"m_home_{n}") + c(f"m_away_{n}") for n in ("efg", "3par", "ftr", "orb", "tov")},
        "rest_sum": c("home_rest") + c("away_rest"), "b2b_any": (c("home_rest") == 1).cast("int") + (c("away_rest") == 1).cast("int"),
        "log_games": F.log1p(F.least("home_games", "away_games"))})


def season_stage(s: dict[str, Column]) -> Column:
    """Ordered stage of the season: national tournament, other postseason, conference tournament,
    conference regular, neutral non-conference, home non-conference."""
    return (F.when(s["post"] & s["national"], "ncaa_tournament").when(s["post"], "other_postseason")
            .when(s["tournament"], "conf_tournament").when(s["conference"], "conf_regular")
            .when(s["neutral"], "nonconf_neutral").otherwise("nonconf_home"))


def edge_bucket(x: Column, edges: list[float]) -> Column:
    """Half-open fixed bins [lo, hi) with labels; null outside."""
    b: Column | None = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond, label = (x >= lo) & (x < hi), F.lit(f"[{lo}, {hi})")
        b = F.when(cond, label) if b is None else b.when(cond, label)
    return b


def bin_index(x: Column, edges: Column) -> Column:
    """0-based quantile bin of x given sorted distinct edges; (a, b] bins, lowest edge included."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return clip((below - 1).cast("double"), 0.0).cast("long")


def body_clock(local_hour: Column, zone_home: Column, zone_away: Column) -> dict[str, Column]:
    """Tip time on the away team's home clock and zones crossed (zones are UTC offsets)."""
    return {"away_clock": local_hour + (F.coalesce(zone_away, F.lit(-5)) + 5),
            "zone_shift": F.abs(F.coalesce(zone_home, F.lit(-5)) - F.coalesce(zone_away, F.lit(-5)))}


def add_slate(history: DataFrame, slate: DataFrame) -> DataFrame:
    """Future games enter the same feature path as history, with null outcomes."""
    return history.withColumn("pending", F.lit(False)).unionByName(slate.withColumn("pending", F.lit(True)), allowMissingColumns=True)


def era_of(season: Column, eras: dict[str, list]) -> Column:
    """Season to research period; seasons of no period are null (may not be predicted)."""
    out: Column | None = None
    for name, seasons in eras.items():
        out = F.when(season.isin(*seasons), name) if out is None else out.when(season.isin(*seasons), name)
    return out


# ------------------------------------------------------------------ study frames
def study_columns(stages: list[str], base: str) -> dict[str, Column]:
    """Extra model columns of the studies: a dummy for each stage but `base`, gaps of tempo and efficiency between the teams, and
    roster continuity with its interaction. Needs stage, tempo_*, off_*, def_*, *_cont, *_xfer (home and away) and x_pts."""
    c = F.col
    both = lambda n: (c(f"home_{n}") + c(f"away_{n}")) / 2  # noqa: E731  null where either is
    cols = {f"st_{s}": (c("stage") == s).cast("double") for s in stages if s != base}
    return cols | {"tempo_gap": F.abs(c("tempo_home") - c("tempo_away")), "eff_gap": F.abs(c("off_home") - c("def_away") - (c("off_away") - c("def_home"))),
                   "cont_avg": both("cont"), "xfer_avg": both("xfer"), "lowcont": 1 - both("cont"), "x_pts_lowcont": c("x_pts") * (1 - both("cont"))}
