"""Leg pricing and two-leg cards per slate."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip, effective_threshold, half_point_threshold
from slatemill.functions.odds import double_profit
from slatemill.functions.probability import add_copula_joint, joint_normal
from slatemill.operators.calibrate import add_latent_probability
from slatemill.operators.running import counts_below
from slatemill.session import cut_lineage

# Default price of a main leg without a real quote, and the flat -110 price used by slates.
MAIN_PRICE = 1.909
# Fixed value: games of a date among which the closest pair is looked for.
CLOSEST_OF = 8


def _attach(df: DataFrame, cal: DataFrame) -> DataFrame:
    return df.join(F.broadcast(cal.select("season", "beta", "v")), "season")          # one row per season


def _sides(df: DataFrame) -> DataFrame:
    return df.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))


def price_legs(legs: DataFrame, cal: DataFrame, market: DataFrame, ref: Column | None = None, terms: str = "base") -> DataFrame:
    """Adds model p, conservative p_cons, market p_mkt and p_mkt_close to legs at threshold `t_eff`.
    `ref` is the line the book prices around (default the market line)."""
    s = F.col("side")
    ref = F.col("line") if ref is None else ref
    d = _attach(legs, cal)
    d = add_latent_probability(d, "p", s * F.col("mu") / F.col("sd"), s * (F.col("line") - F.col("t_eff")) / F.col("sd"), s, terms).drop("beta", "v")
    d = d.withColumnRenamed("p_cons", "_pc")
    d = _attach(d, market)
    mm = s * F.col("mu_mkt") / F.col("sd_mkt")
    d = add_latent_probability(d, "p_mkt", mm, s * (ref - F.col("t_eff")) / F.col("sd_mkt"), s, "base", None)
    d = add_latent_probability(d, "p_mkt_close", mm, s * (F.col("line_close") - F.col("t_eff")) / F.col("sd_mkt"), s, "base", None)
    return d.drop("beta", "v").withColumnRenamed("_pc", "p_cons")


def leg_cube(preds: DataFrame, cal: DataFrame, market: DataFrame, k_max: float = 20.0, step: float = 0.5) -> DataFrame:
    """Long legs: every calibrated game x side x buffer, thresholds on the half-point grid."""
    n = int(round(k_max / step))
    d = _sides(preds).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("k", F.col("k") * step)
    thr = half_point_threshold(F.col("line"), F.col("side")) - F.col("side") * F.col("k")
    d = d.withColumn("thr", thr).withColumns({"t_eff": F.col("thr"), "win": F.col("side") * (F.col("outcome") - F.col("thr")) > 0})
    return price_legs(d, cal, market).drop("t_eff")


def main_line_view(preds: DataFrame, cal: DataFrame, market: DataFrame) -> DataFrame:
    """Both sides at the actual line, the better side and its result (pushes possible)."""
    d = leg_cube(preds, cal, market, 0.0)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    g = d.groupBy("game_key", "season", "date", "line", "line_close", "outcome", "eligible").agg(
        side(1, "p").alias("p_over"), side(1, "p_cons").alias("p_over_cons"), side(-1, "p").alias("p_under"), side(-1, "p_cons").alias("p_under_cons"))
    over = F.col("p_over") >= F.col("p_under")
    g = g.withColumns({"p_push": F.greatest(1 - F.col("p_over") - F.col("p_under"), F.lit(0.0)), "best_side": F.when(over, 1).otherwise(-1),
                       "p_best": F.greatest("p_over", "p_under"), "p_best_cons": F.when(over, F.col("p_over_cons")).otherwise(F.col("p_under_cons"))})
    return g.withColumns({"best_win": F.col("best_side") * (F.col("outcome") - F.col("line")) > 0, "best_push": F.col("outcome") == F.col("line")})


def ladder_legs(preds: DataFrame, cal: DataFrame, market: DataFrame, quotes: DataFrame | None = None, margin: float = 0.045,
                alt_ref: str = "median", main_only: bool = False) -> DataFrame:
    """The main leg (best book's number at its real price, else the market line at 1.909) and integer
    alternates k -6..15 around the median or the best book's line, priced (1 - margin) / p_mkt off
    the open (`odds`) and off the close (`odds_close`). quotes: best_quotes output."""
    d = preds.where("eligible")
    d = _sides(d if quotes is None else d.join(quotes, "game_key", "left"))
    if quotes is None:
        d = d.withColumns({"best_line": F.lit(None).cast("double"), "best_price": F.lit(None).cast("double")})
    else:
        over = F.col("side") == 1
        d = d.withColumns({
            "best_line": F.when(over, F.col("over_line")).otherwise(F.col("under_line")),
            "best_price": F.when(over, F.col("over_price")).otherwise(F.col("under_price"))})
    d = d.withColumn("main_line", F.coalesce("best_line", "line"))
    d = d.withColumn("ref", F.col("main_line") if alt_ref == "best_book" else F.col("line"))
    base = half_point_threshold(F.col("ref"), F.col("side"))
    main = F.struct(F.lit(True).alias("main"), F.lit(0).alias("k"), F.col("main_line").cast("double").alias("thr"))
    alts = F.transform(F.sequence(F.lit(-6), F.lit(15)), lambda k: F.struct(
        F.lit(False).alias("main"), k.alias("k"), (base - F.col("side") * k).cast("double").alias("thr")))
    d = d.withColumn("l", F.explode(F.array(main) if main_only else F.concat(F.array(main), alts))).select("*", "l.*").drop("l")
    d = d.withColumns({"t_eff": effective_threshold(F.col("thr"), F.col("side")),
                       "win": F.col("side") * (F.col("outcome") - F.col("thr")) > 0, "push": F.col("outcome") == F.col("thr")})
    d = price_legs(d, cal, market, F.col("ref"))
    real = F.coalesce("best_price", F.lit(MAIN_PRICE))
    model = lambda c: (1 - margin) / F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(1e-3))
    return d.withColumns({"odds": F.when(F.col("main"), real).otherwise(model("p_mkt")),
                          "odds_close": F.when(F.col("main"), real).otherwise(model("p_mkt_close"))})


# ------------------------------------------------------------------ pair search
LEG = ["game_key", "side", "k", "main", "thr", "odds", "p", "p_cons", "outcome", "win", "push"]
# Ids of a pair: an option number below OPTIONS, and two leg-and-option ids side by side in one long.
OPTIONS, PAIR = 1 << 12, 1 << 31


def top_legs(options: DataFrame, score: Column, n: int, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The n best (game, side) legs of each date by their best option, ties to the larger game key;
    `leg` is the rank. This limit is the card rule itself; it also bounds the pair join to n^2 per date.
    The short list is written first, so that options are priced anew and dropped where they stand instead of being
    shuffled: only one best score a leg moves. `again` gives the options of a few games (date, game_key) and spares the pricing of
    all others."""
    best = options.groupBy("date", "game_key", "side").agg(F.max(score).alias("_s")).where(F.col("_s").isNotNull())
    w = Window.partitionBy("date").orderBy(F.col("_s").desc(), F.col("game_key").desc(), F.col("side").asc())
    keep = cut_lineage(best.withColumn("leg", F.row_number().over(w)).where(F.col("leg") <= n).drop("_s"))
    if again is not None:
        options = again(keep.select("date", "game_key").distinct())
    return options.join(F.broadcast(keep), ["date", "game_key", "side"])               # n rows per date


def undominated(options: DataFrame, first: str, second: str) -> DataFrame:
    """Options of one leg that no other option beats on both measures; a pair optimum never needs
    the rest. A leg has a few dozen options."""
    w = Window.partitionBy("date", "game_key", "side").orderBy(F.col(first).desc(), F.col(second).desc(), "k")
    best = F.max(second).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return options.withColumn("_b", best).where(F.col("_b").isNull() | (F.col(second) > F.col("_b"))).drop("_b")


def leg_pairs(options: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of options of different games on a date, each once."""
    tag = lambda s: options.select("date", "season", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return tag("a").join(tag("b").drop("season"), "date").where(F.col("game_key_a") < F.col("game_key_b"))


def best_option_pair(options: DataFrame, needs: list[str], ok: Column, score: Column, detail: list[str]) -> DataFrame:
    """The date's best pair of options among those where `ok` holds, with both legs' `detail`.

    Every option carries a small id (`leg` rank and `opt` position), so the search aggregates plain
    numbers (hash aggregation, no sorting of wide rows): first the best score of each date, then the
    lowest pair id reaching it. The two winners fetch their details by id. Numbers too large for the ids are an error.
    """
    # read six times below, so the short list is written once instead of repricing every leg
    o = cut_lineage(options.withColumn("oid", F.when(
        (F.col("opt") < OPTIONS) & (F.col("leg") < PAIR // OPTIONS), F.col("leg").cast("long") * OPTIONS + F.col("opt"))
        .otherwise(F.raise_error(F.lit("too many legs or options of a date for the pair ids")).cast("long"))))
    x = leg_pairs(o.select("date", "season", "game_key", "oid", *needs), ["game_key", "oid", *needs]).where(ok).withColumn("_v", score)
    top = x.groupBy("date").agg(F.max("_v").alias("_top"))
    pid = F.col("oid_a") * PAIR + F.col("oid_b")
    # one row per date: the pairs are formed again rather than shuffled to their date's best score
    pick = x.join(F.broadcast(top), "date").where(F.col("_v") == F.col("_top")).groupBy("date").agg(F.min(pid).alias("pid"), F.max("_v").alias("score"))
    pick = pick.select("date", "score", F.expr(f"pid div {PAIR}").alias("oid_a"), (F.col("pid") % PAIR).alias("oid_b"))
    side = lambda s, more: o.select("date", *more, F.col("oid").alias(f"oid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in detail])
    return pick.join(side("a", ["season"]), ["date", "oid_a"]).join(side("b", []), ["date", "oid_b"]).drop("oid_a", "oid_b")


def buffered_cards(cube: DataFrame, target: float = 0.60, margin: float = 0.0455, legs: int = 14, rho_lo: float = 0.0,
                   max_buffer: float | None = None, value_gate: bool = False) -> DataFrame:
    """One card per date: the pair of legs and buffers with the highest value subject to a joint
    conservative probability of at least `target`."""
    c = cube.where("eligible")
    if max_buffer is not None:
        c = c.where(F.col("k") <= max_buffer)
    price = lambda p: (1 - margin) / F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(1e-3))
    c = c.select("date", "season", "game_key", "side", "k", "thr", "win", "p", "p_cons", "p_mkt", price("p_mkt").alias("odds"), price("p_mkt_close").alias("odds_close"))
    c = c.withColumns({"val": F.col("p") * F.col("odds"), "opt": (F.col("k") * 2).cast("int")})
    c = top_legs(c, F.when(F.col("p_cons") >= math.sqrt(target), F.col("val")), legs)
    if rho_lo == 0.0:
        # filtered after the window: a filter on a computed probability would be pushed below and
        # evaluate the whole pricing expression a second time
        c = undominated(c, "p_cons", "val").where(F.col("p_cons") >= target)
    a, b = F.col("p_cons_a"), F.col("p_cons_b")
    joint = a * b if rho_lo == 0.0 else a * b + rho_lo * F.sqrt(a * (1 - a) * b * (1 - b))
    detail = ["game_key", "side", "k", "thr", "win", "p", "p_cons", "p_mkt", "odds", "odds_close", "val"]
    best = best_option_pair(c, ["p_cons", "val"], joint >= target, F.col("val_a") * F.col("val_b"), detail)
    won = F.col("win_a") & F.col("win_b")
    r = best.withColumns({"ev": F.col("val_a") * F.col("val_b") - 1, "joint_model": F.col("p_a") * F.col("p_b"), "joint_cons": a * b,
                          "joint_mkt": F.col("p_mkt_a") * F.col("p_mkt_b"), "card_win": won,
                          "profit": F.when(won, F.col("odds_a") * F.col("odds_b") - 1).otherwise(-1.0),
                          "profit_close": F.when(F.col("odds_close_a").isNotNull() & F.col("odds_close_b").isNotNull(),
                                                 F.when(won, F.col("odds_close_a") * F.col("odds_close_b") - 1).otherwise(-1.0))})
    return r.withColumn("released", F.col("ev") > 0 if value_gate else F.lit(True))


def odds_cards(ladder: DataFrame, floor: float = 2.5, legs: int = 16, band: tuple[float, float] | None = None, cap: float | None = None,
               objective: str = "ev", gate: str = "conservative", force: bool = False, settle: str = "odds",
               again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One card per date with combined odds at the floor: the pair maximising conservative EV (or,
    for `joint`, the conservative chance of both winning among pairs of positive EV), released when
    the gate EV is positive. `settle` names the price column used for the result. `again`, if given, builds the ladder of
    some games (date, game_key) only, so that short-listed legs are priced anew without the others."""
    def options(of: DataFrame) -> DataFrame:
        d = of.withColumn("settle", F.col(settle))
        if band is not None:      # out-of-band options lose their price, which keeps pricing evaluated once
            d = d.withColumn("odds", F.when(F.col("odds").between(*band), F.col("odds")))
        d = d.withColumns({"vc": F.col("p_cons") * F.col("odds"), "vm": F.col("p") * F.col("odds")})
        return d.withColumn("opt", F.when(F.col("main"), 0).otherwise(F.col("k") + 7))

    few = None if again is None else lambda games: options(again(games))
    d = top_legs(options(ladder), F.col("vc"), legs, few).select("date", "season", "leg", "opt", *LEG, "settle", "vc", "vm")
    if cap is None and objective == "ev":
        d = undominated(d, "odds", "vc")
    combo = F.col("odds_a") * F.col("odds_b")
    evc = F.col("vc_a") * F.col("vc_b")
    ok = combo >= floor
    if cap is not None:
        ok = ok & (combo <= cap)
    score = evc
    if objective == "joint":
        ok, score = ok & (evc > 1), F.col("p_cons_a") * F.col("p_cons_b")
    best = best_option_pair(d, ["odds", "vc", "p_cons"], ok, score, LEG + ["settle", "vc", "vm"])
    best = best.withColumns({"ev_cons": F.col("vc_a") * F.col("vc_b") - 1, "ev_model": F.col("vm_a") * F.col("vm_b") - 1})
    if not force:
        best = best.where((F.col("ev_cons") if gate == "conservative" else F.col("ev_model")) > 0)
    sign = lambda s: F.when(F.col(f"win_{s}"), 1).when(F.col(f"push_{s}"), 0).otherwise(-1)
    return best.withColumns({"combined_odds": F.col("settle_a") * F.col("settle_b"), "joint_cons": F.col("p_cons_a") * F.col("p_cons_b"),
                             "joint_model": F.col("p_a") * F.col("p_b"),
                             "profit": double_profit(sign("a"), F.col("settle_a"), sign("b"), F.col("settle_b"))})


# ------------------------------------------------------------------ stage-one slate decision
def pair_skyline(cand: DataFrame, first: str, second: str) -> DataFrame:
    """Legs beaten on both measures by at most one other leg of their date. The best pair under any
    rule rising in both measures lies inside, so pairs are formed on this short list only."""
    w = Window.partitionBy("date").orderBy(F.col(first).desc(), F.col(second).desc(), "game_key")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = cand.withColumn("_top", F.max(second).over(before))
    d = d.withColumn("_lose", F.when(F.col("_top").isNotNull(), F.least(F.col(second), F.col("_top"))))
    d = d.withColumn("_second", F.max("_lose").over(before))
    return d.where(F.col("_second").isNull() | (F.col(second) > F.col("_second"))).drop("_top", "_lose", "_second")


def qualifying_pairs(cand: DataFrame, p: str, rho: Column, target: float) -> DataFrame:
    """(date, n_qualifying): pairs of a date whose joint chance reaches `target`, counted without forming any. The joint
    chance rises in both legs, so every leg has a least partner chance that reaches the target (`least_partner`), and a
    shared axis tells how many legs have it. cand: date and one dependence per date; equal chances count together."""
    d = cand.groupBy("date", clip(F.col(p), 1e-6, 1 - 1e-6).alias("x")).agg(F.count("*").alias("m"), F.max(rho).alias("rho"))
    d = cut_lineage(d.withColumn("need", least_partner("x", "rho", target)))
    asks = d.where("need <= 1").select("date", F.col("need").alias("x"), F.col("x").cast("string").alias("id"), F.lit(False).alias("closed"))
    below = counts_below(d.select("date", "x", F.col("m").cast("double").alias("m")), asks, ["date"], "x", "m", weight="m")
    size = d.groupBy("date").agg(F.sum("m").alias("n"))
    own = d.where("need <= 1").select("date", F.col("x").cast("string").alias("id"), "m", (F.col("x") >= F.col("need")).cast("long").alias("self"))
    j = own.join(below, ["date", "id"]).join(size, "date")
    return j.groupBy("date").agg(F.expr("sum(m * (n - below - self)) div 2").alias("n_qualifying"))


def least_partner(p: str, rho: str, target: float) -> Column:
    """Least second chance that with `p` reaches the joint target; above 1 where none does. By bisection on the copula; at
    rho 0 the smallest double whose product with `p` does."""
    @F.pandas_udf("double")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        a, t = x.to_numpy(float), r.to_numpy(float)
        lo, hi = np.full(len(a), 1e-6), np.full(len(a), 1 - 1e-6)
        top = joint_normal(a, hi, t)
        low = joint_normal(a, lo, t)
        for _ in range(60):
            mid = (lo + hi) / 2
            up = joint_normal(a, mid, t) >= target
            hi, lo = np.where(up, mid, hi), np.where(up, lo, mid)
        plain = t == 0
        q = target / a
        for _ in range(3):
            q = np.where(plain & (a * q < target), np.nextafter(q, 2.0), q)
            down = np.nextafter(q, 0.0)
            q = np.where(plain & (a * down >= target), down, q)
        out = np.where(plain, q, np.where(low >= target, 0.0, hi))
        return pd.Series(np.where(~plain & (top < target), 2.0, out))

    return run(F.col(p), F.col(rho).cast("double"))


def decide_slates(preds: DataFrame, rhos: DataFrame, joint_target: float = 0.60, floor: float = 0.60, single_min: float = 0.5238,
                  min_edge: float = 0.0, odds: float = MAIN_PRICE) -> DataFrame:
    """Per date: a two-pick card, one qualifying pick or no bet.
    preds: game_key, season, date, p_cal, p_cons, line, proj_total, total, calibrated, eligible;
    rhos: season, rho, rho_lo (copula dependence from earlier seasons)."""
    d = preds.where(F.col("calibrated") & F.col("eligible"))
    good = (F.col("p_cal") >= floor) & (F.col("p_cal") * odds > 1) & (F.col("proj_total") - F.col("line") > min_edge)
    per = d.groupBy("date", "season").agg(F.count("*").alias("n_games"), F.count_if(good).alias("n_candidates"))
    single_ok = good & (F.col("p_cons") >= single_min) & (F.col("p_cons") * odds > 1)
    single = d.where(single_ok).groupBy("date").agg(F.min_by(F.struct("game_key", "line", "total"), F.struct(-F.col("p_cal"), F.col("game_key"))).alias("s"))
    cols = ["game_key", "p_cal", "p_cons", "line", "total"]
    c = pair_skyline(d.where(good), "p_cal", "p_cons")
    x = leg_pairs(c, cols).join(F.broadcast(rhos), "season")                          # one row per season
    x = add_copula_joint(x, "joint_cal", F.col("p_cal_a"), F.col("p_cal_b"), F.col("rho"))
    x = add_copula_joint(x, "joint_cons", F.col("p_cons_a"), F.col("p_cons_b"), F.col("rho_lo"))
    ok = F.col("joint_cons") >= joint_target
    order = F.when(ok, F.struct(-F.col("joint_cal"), F.col("game_key_a"), F.col("game_key_b")))
    pick = F.struct("game_key_a", "game_key_b", "line_a", "line_b", "total_a", "total_b", "joint_cal", "joint_cons", (F.col("p_cal_a") * F.col("p_cal_b")).alias("joint_indep"))
    card = x.groupBy("date").agg(F.min_by(F.when(ok, pick), order).alias("c"))
    # the near miss is taken among a date's most likely games, whether candidates or not
    nearest = F.row_number().over(Window.partitionBy("date").orderBy(F.col("p_cal").desc(), "game_key"))
    pool = d.withColumn("_rk", nearest).where(F.col("_rk") <= CLOSEST_OF)
    near = add_copula_joint(leg_pairs(pool, ["game_key", "p_cons"]).join(F.broadcast(rhos), "season"), "joint_cons", F.col("p_cons_a"), F.col("p_cons_b"), F.col("rho_lo"))
    near = near.groupBy("date").agg(F.max("joint_cons").alias("closest_joint_cons"))
    r = per.join(card, "date", "left").join(single, "date", "left").join(near, "date", "left")
    res = lambda t, l: F.signum(F.col(t) - F.col(l)).cast("int")
    two, one = F.col("c").isNotNull(), F.col("s").isNotNull()
    sa, sb = res("c.total_a", "c.line_a"), res("c.total_b", "c.line_b")
    n = F.col("n_candidates")
    count = qualifying_pairs(d.where(good).join(F.broadcast(rhos), "season"), "p_cons", F.col("rho_lo"), joint_target)       # one row per season
    r = r.join(count, "date", "left")
    return r.select(
        "date", "season", "n_games", "n_candidates", (n * (n - 1) / 2).cast("long").alias("n_pairs"), F.coalesce("n_qualifying", F.lit(0)).cast("long").alias("n_qualifying"),
        F.when(two, "TWO-PICK CARD").when(one, "ONE QUALIFYING PICK").otherwise("NO BET").alias("outcome"),
        F.when(two, F.col("c.game_key_a")).when(one, F.col("s.game_key")).alias("pick_a"), F.when(two, F.col("c.game_key_b")).alias("pick_b"),
        F.col("c.joint_cal").alias("joint_cal"), F.col("c.joint_cons").alias("joint_cons"), F.col("c.joint_indep").alias("joint_indep"), "closest_joint_cons",
        F.when(two, (sa == 1).cast("int") + (sb == 1).cast("int")).alias("card_wins"),
        F.when(two, double_profit(sa, F.lit(odds), sb, F.lit(odds))).alias("double_profit"))


def slate_picks(preds: DataFrame, decisions: DataFrame, odds: float = MAIN_PRICE) -> DataFrame:
    """One row per pick of the decided slates: date, season, game_key, role (the slate's outcome), leg, line, proj_total,
    p_cal, p_cons, total, result (W, P for a push, L) and flat profit."""
    picks = decisions.select("date", "outcome", F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col("pick_a").alias("game_key")), F.struct(F.lit(1).alias("leg"), F.col("pick_b").alias("game_key")))).alias("x"))
    picks = picks.select("date", F.col("outcome").alias("role"), "x.*").where("game_key IS NOT NULL")
    sign = F.signum(F.col("total") - F.col("line"))
    j = picks.join(preds.select("game_key", "date", "season", "line", "proj_total", "p_cal", "p_cons", "total"), ["date", "game_key"])
    return j.select("date", "season", "game_key", "role", "leg", "line", "proj_total", "p_cal", "p_cons", "total",
                    F.when(sign > 0, "W").when(sign == 0, "P").otherwise("L").alias("result"), F.when(sign > 0, odds - 1).when(sign == 0, 0.0).otherwise(-1.0).alias("profit"))


# ------------------------------------------------------------------ singles and lines
def shop_sides(view: DataFrame) -> DataFrame:
    """Line shopping: the side whose best offer has the higher value (p_over, odds_over, ...)."""
    vo, vu = F.col("p_over") * F.col("odds_over"), F.col("p_under") * F.col("odds_under")
    over = vo >= vu
    pick = lambda c: F.when(over, F.col(f"{c}_over")).otherwise(F.col(f"{c}_under"))
    return view.where(vo.isNotNull() & vu.isNotNull()).withColumns(
        {"side": F.when(over, 1).otherwise(-1), "p_shop": pick("p"), "line_shop": pick("line"), "odds_shop": pick("odds"), "value": F.greatest(vo, vu)})


def max_playable_line(preds: DataFrame, cal: DataFrame, market: DataFrame, min_p: float, step: float = 0.5, reach: float = 15.0) -> DataFrame:
    """Highest half-point line at which the Over still clears `min_p` conservatively: a short grid of
    lines per game, filtered and maximised."""
    n = int(reach / step)
    d = preds.withColumn("i", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn("thr", F.floor("line") + 0.5 + F.col("i") * step)
    d = d.withColumns({"side": F.lit(1), "t_eff": effective_threshold(F.col("thr"), F.lit(1))})
    ok = F.col("p_cons") >= min_p
    return price_legs(d, cal, market).groupBy("game_key").agg(F.max(F.when(ok, F.col("thr"))).alias("max_line"))


def improve_by_best_book(cards: DataFrame, quotes: DataFrame, median: DataFrame) -> DataFrame:
    """Chosen cards with each leg moved by the best book's advantage over the median line, and graded there at unchanged
    prices: adds thr_shop, win_shop and push_shop per leg, and profit_shop."""
    q = quotes.join(median.select("game_key", F.col("line").alias("median_line")), "game_key")
    gain = q.select("game_key", F.greatest(F.col("median_line") - F.col("over_line"), F.lit(0.0)).alias("gain_over"),
                    F.greatest(F.col("under_line") - F.col("median_line"), F.lit(0.0)).alias("gain_under"))
    d = cards
    for s in ("a", "b"):
        g = gain.select(F.col("game_key").alias(f"game_key_{s}"), F.col("gain_over").alias(f"_go_{s}"), F.col("gain_under").alias(f"_gu_{s}"))
        d = d.join(g, f"game_key_{s}", "left")
        adv = F.coalesce(F.when(F.col(f"side_{s}") == 1, F.col(f"_go_{s}")).otherwise(F.col(f"_gu_{s}")), F.lit(0.0))
        d = d.withColumn(f"thr_shop_{s}", F.col(f"thr_{s}") - F.col(f"side_{s}") * adv).drop(f"_go_{s}", f"_gu_{s}")
        d = d.withColumns({f"win_shop_{s}": F.col(f"side_{s}") * (F.col(f"outcome_{s}") - F.col(f"thr_shop_{s}")) > 0,
                           f"push_shop_{s}": F.col(f"outcome_{s}") == F.col(f"thr_shop_{s}")})
    sign = lambda s: F.when(F.col(f"win_shop_{s}"), 1).when(F.col(f"push_shop_{s}"), 0).otherwise(-1)
    return d.withColumn("profit_shop", double_profit(sign("a"), F.col("settle_a"), sign("b"), F.col("settle_b")))
