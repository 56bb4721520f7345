"""Studies of soft books against the sharp one: prices on its line, gaps to its fair line, recorded picks against the close.

Boards come from `asof` as aggregates; everything here joins on (decision, fixture[, line]) and reduces again, so no price
history is collected and a busy fixture costs one row a cell.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.functions.odds import flat_profit, no_vig, outcome_sign
from slatemill.operators.asof import board_at, close_board, side_sign, two_way
from slatemill.operators.clean import edge_bucket
from slatemill.operators.market import add_fair_probability, fair_curve, is_half_line
from slatemill.session import cut_lineage

# Least expected value of a bet and the edges of its bands.
EV_MIN = 0.02
EV_BANDS = [0.02, 0.04, 0.07, 0.12, 9]


def sharp_chances(board: DataFrame, sharp: str, keys: list[str]) -> DataFrame:
    """The sharp book's lines priced on both sides: keys, line, p_over without its margin, both prices."""
    w = two_way(board.where(F.col("book") == sharp), keys + ["line"])
    return w.select(*keys, "line", no_vig(F.col("over"), F.col("under")).alias("p_over"), F.col("over").alias("sharp_over"), F.col("under").alias("sharp_under"))


def _side_chance(p_over: str) -> Column:
    return F.when(F.col("side") == "over", F.col(p_over)).otherwise(1 - F.col(p_over))


def on_sharp_lines(board: DataFrame, soft: list[str], sharp: str, keys: list[str]) -> DataFrame:
    """Every soft price on a line that the sharp book prices too: keys, book, line, side, price, its fair chance p and value ev.
    A soft book need not price both sides."""
    s = board.where(F.col("book").isin(soft)).join(sharp_chances(board, sharp, keys).select(*keys, "line", "p_over"), keys + ["line"])
    return s.withColumn("p", _side_chance("p_over")).withColumn("ev", F.col("p") * F.col("price") - 1).select(*keys, "book", "line", "side", "price", "p", "ev")


def best_value(prices: DataFrame, keys: list[str], ev_min: float = EV_MIN) -> DataFrame:
    """One bet per keys and book: the price of highest value, `ev_min` at least; ties to the higher line, then the under."""
    bet = F.struct("line", "side", "price", "p", "ev")
    best = prices.groupBy(*keys, "book").agg(F.max_by(bet, F.when(F.col("ev") >= ev_min, F.struct("ev", "line", "side"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select(*keys, "book", "b.*")


def graded_value(bets: DataFrame, closing: DataFrame, finals: DataFrame, sharp: str) -> DataFrame:
    """Bets with their value at the sharp close of the same line (null where it has none there) and their result: `sign` +1, 0 or -1 and `pnl`,
    both null for a bet without a result, which is void. `closing` is a board, `finals` holds fixture_id, final."""
    c = sharp_chances(closing, sharp, ["fixture_id"]).select("fixture_id", "line", F.col("p_over").alias("_c"))
    j = bets.join(c, ["fixture_id", "line"], "left").join(finals.select("fixture_id", "final"), "fixture_id", "left")
    s = outcome_sign(F.col("final"), F.col("line"), side_sign(F.col("side")))
    return j.withColumns({"clv": _side_chance("_c") * F.col("price") - 1, "sign": s, "pnl": flat_profit(s, F.col("price"))}).drop("_c", "final")


def bet_measures() -> list[Column]:
    """Aggregates over graded bets. Void bets count in `all_bets` and `clv_all` alone: the value at the close needs no result."""
    done = F.col("sign").isNotNull()
    return [F.count("*").alias("all_bets"), F.avg("clv").alias("clv_all"), F.count_if(done).alias("bets"), F.count_if(F.col("sign") == 0).alias("pushes"),
            F.avg(F.when(F.col("sign") != 0, (F.col("sign") == 1).cast("double"))).alias("won"), F.avg(F.when(done, F.col("price"))).alias("avg_price"),
            F.avg("pnl").alias("roi"), (F.stddev_samp("pnl") / F.sqrt(F.count("pnl"))).alias("roi_se"), F.avg(F.when(done, F.col("clv"))).alias("clv")]


def value_summary(bets: DataFrame, decision: str, window: Column) -> DataFrame:
    """Measures of graded bets by decision and book, by decision, window and book, and by decision and value band; columns
    that a row does not divide by are null. One pass for all three."""
    b = bets.withColumns({"window": window, "band": edge_bucket(F.col("ev"), EV_BANDS)})
    d, bk, w, bd = (F.col(c) for c in (decision, "book", "window", "band"))
    return b.groupingSets([[d, bk], [d, w, bk], [d, bd]], d, bk, w, bd).agg(*bet_measures())


def pricing_by_book(prices: DataFrame, keys: list[str], ev_min: float = EV_MIN) -> DataFrame:
    """How each book prices against the sharp chance, every quote counted: mean value and the shares above fair and by `ev_min`."""
    share = lambda c: F.avg(c.cast("double"))
    return prices.groupBy(*keys, "book").agg(F.count("*").alias("prices"), F.avg("ev").alias("mean_value"), share(F.col("ev") > 0).alias("above_fair"),
                                             share(F.col("ev") >= ev_min).alias("well_above"))


def sharp_calibration(closing: DataFrame, finals: DataFrame, sharp: str, edges: list[float]) -> DataFrame:
    """Predicted and observed share of overs by the band of the sharp chance at the close; pushes and games without a result take no part."""
    c = sharp_chances(closing, sharp, ["fixture_id"]).join(finals, "fixture_id").where(F.col("final").isNotNull() & (F.col("final") != F.col("line")))
    return c.groupBy(edge_bucket(F.col("p_over"), edges).alias("band")).agg(
        F.count("*").alias("lines"), F.avg("p_over").alias("predicted"), F.avg((F.col("final") > F.col("line")).cast("double")).alias("happened"))


def favoured_side(board: DataFrame, finals: DataFrame, sharp: str, keys: list[str], least: float = 0.005) -> DataFrame:
    """The side that the sharp price favours by more than `least`, bet at that price: keys, line, side, price, sign, pnl."""
    c = sharp_chances(board, sharp, keys).where(F.abs(F.col("p_over") - 0.5) > least).join(finals.select("fixture_id", "final"), "fixture_id")
    over = F.col("p_over") > 0.5
    c = c.withColumns({"side": F.when(over, "over").otherwise("under"), "price": F.when(over, F.col("sharp_over")).otherwise(F.col("sharp_under"))})
    s = outcome_sign(F.col("final"), F.col("line"), side_sign(F.col("side")))
    return c.withColumns({"sign": s, "pnl": flat_profit(s, F.col("price"))}).where(s.isNotNull() & (s != 0)).select(*keys, "line", "side", "price", "sign", "pnl")


# ------------------------------------------------------------------ gaps at the later of two first posts
def both_posted(quotes: DataFrame, soft: list[str], sharp: str) -> DataFrame:
    """When both the soft book and the sharp one first have a half-point line with both sides posted, plus a millisecond: fixture_id, soft, when.
    A log of single changes shows the sides of a line one after the other, so the later of the two counts."""
    live = F.col("active") & (F.col("price") > 1)
    side = lambda s: F.min(F.when(live & (F.col("side") == s), F.col("t"))).alias(s)
    lines = quotes.where(is_half_line(F.col("line"))).groupBy("fixture_id", "book", "line").agg(side("over"), side("under")).na.drop(subset=["over", "under"])
    first = lines.groupBy("fixture_id", "book").agg(F.min(F.greatest("over", "under")).alias("t"))
    s = first.where(F.col("book") == sharp).select("fixture_id", F.col("t").alias("_s"))
    return first.where(F.col("book").isin(soft)).join(s, "fixture_id").select(
        "fixture_id", F.col("book").alias("soft"), (F.greatest("t", "_s") + F.expr("INTERVAL '0.001' SECOND")).alias("when"))


def opening_gaps(quotes: DataFrame, finals: DataFrame, soft: list[str], sharp: str) -> DataFrame:
    """Per fixture and soft book, when both are first posted: the soft main line (half-point, most balanced, ties to the lower), its gap to the
    sharp fair line, the bet towards the sharp book, whether the close stays on its side, the value at the close and the result."""
    q = cut_lineage(quotes)
    keys = ["soft", "fixture_id"]
    when = both_posted(q, soft, sharp)
    b = cut_lineage(board_at(q, when, extra=["soft"]).where((F.col("book") == F.col("soft")) | (F.col("book") == sharp)))
    now = fair_curve(b, sharp, keys).select(*keys, "fair_mu")
    w = two_way(b.where((F.col("book") == F.col("soft")) & is_half_line(F.col("line"))), keys + ["line"])
    imbalance = F.abs(1 / F.col("over") - 1 / F.col("under"))
    m = w.groupBy(*keys).agg(F.min_by(F.struct("line", "over", "under"), F.struct(imbalance, "line")).alias("m")).select(*keys, "m.*")
    close = fair_curve(close_board(q), sharp).select("fixture_id", "a", "b", F.col("fair_mu").alias("close_mu"))
    j = m.join(now, keys).join(close, "fixture_id").join(finals.select("fixture_id", "final"), "fixture_id").where(F.col("final").isNotNull())
    j = j.withColumn("gap", F.col("line") - F.col("fair_mu")).withColumn("side", F.when(F.col("gap") > 0, "under").otherwise("over"))
    j = j.withColumns({"price": F.when(F.col("side") == "under", F.col("under")).otherwise(F.col("over")),
                       "stays": F.signum(F.col("line") - F.col("close_mu")) == F.signum("gap")})
    j = add_fair_probability(j, "p_close", F.col("a"), F.col("b"))
    s = outcome_sign(F.col("final"), F.col("line"), side_sign(F.col("side")))
    return j.select(*keys, "line", "gap", "side", "price", "stays", (F.col("p_close") * F.col("price") - 1).alias("clv"), flat_profit(s, F.col("price")).alias("pnl"))


def gap_table(gaps: DataFrame, steps: list[float]) -> DataFrame:
    """Measures of opening gaps of at least so many points, for every step at once."""
    g = gaps.withColumn("least_gap", F.explode(F.filter(F.array(*[F.lit(float(s)) for s in steps]), lambda s: s <= F.abs(F.col("gap")))))
    share = lambda c: F.avg(c.cast("double"))
    return g.groupBy("soft", "least_gap").agg(
        F.count("*").alias("games"), F.avg(F.abs("gap")).alias("mean_gap"), share(F.col("stays")).alias("stays"), F.avg("clv").alias("clv"),
        share(F.col("pnl") > 0).alias("won"), F.avg("pnl").alias("roi"), (F.stddev_samp("pnl") / F.sqrt(F.count("*"))).alias("roi_se"))


# ------------------------------------------------------------------ recorded picks
def closing_value(picks: DataFrame, quotes: DataFrame, finals: DataFrame, sharp: str) -> DataFrame:
    """Recorded picks (fixture_id, line, side, price, t) with result and value at the close: the sharp fair chance of the last board before
    the start, where that book moved after the pick was recorded; otherwise there is no later price and close_p is null.

    result is pending, push, won or lost; pnl is null while pending."""
    q = cut_lineage(quotes)
    curve = fair_curve(close_board(q), sharp, whole_lines=True).select("fixture_id", "a", "b")
    last = q.where(F.col("book") == sharp).groupBy("fixture_id").agg(F.max("t").alias("_last"))
    j = picks.join(curve, "fixture_id", "left").join(last, "fixture_id", "left").join(finals.select("fixture_id", "final"), "fixture_id", "left")
    j = add_fair_probability(j, "_p", F.col("a"), F.col("b")).withColumn("close_p", F.when(F.col("_last") > F.col("t"), F.col("_p")))
    s = outcome_sign(F.col("final"), F.col("line"), side_sign(F.col("side")))
    result = F.when(s.isNull(), "pending").when(s == 0, "push").when(s == 1, "won").otherwise("lost")
    return j.withColumns({"clv": F.col("close_p") * F.col("price") - 1, "result": result, "pnl": flat_profit(s, F.col("price"))}).drop("a", "b", "_p", "_last", "final")
