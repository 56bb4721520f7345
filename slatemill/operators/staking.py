"""Stakes, bankroll paths and ledger grading."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.functions.odds import flat_profit, kelly_fraction, outcome_sign
from slatemill.operators.running import drawdown, running_total

# Confidence tiers (floor, units), Kelly share, cap on a day's stakes, doubling steps.
TIERS = [(0.50, 1.0), (0.55, 1.5), (0.58, 2.0), (0.60, 2.5)]
KELLY_SHARE = 1 / 8
DAY_CAP = 0.25
LEVELS = 3


def tiered_units(p: Column) -> Column:
    out = F.lit(TIERS[0][1])
    for floor, units in TIERS:
        out = F.when(p >= floor, units).otherwise(out)
    return out


def capped_kelly(bets: DataFrame, day: list[str], p: Column, price: Column, share: float = KELLY_SHARE, cap: float = DAY_CAP) -> DataFrame:
    """Fractional Kelly, scaled down on days whose stakes together exceed the cap. The day's total is
    a grouped sum joined back, so a day with very many bets is not one window."""
    b = bets.withColumn("_f", kelly_fraction(p, price, share))
    tot = b.groupBy(*day).agg(F.sum("_f").alias("_tot"))
    scale = F.when(F.col("_tot") > cap, cap / F.col("_tot")).otherwise(1.0)
    return b.join(tot, day).withColumn("stake", F.col("_f") * scale).drop("_f", "_tot")


def staking_report(bets: DataFrame, keys: list[str], stake: Column, chunk: Column, order: list[str]) -> DataFrame:
    """Stakes, profit, ROI per unit staked and drawdown of one scheme on a fixed bankroll."""
    b = bets.withColumn("_st", stake).withColumn("_pl", F.col("_st") * F.col("pnl"))
    s = b.groupBy(*keys).agg(F.count("*").alias("bets"), F.sum("_st").alias("staked"), F.sum("_pl").alias("profit"))
    dd = drawdown(b, keys, chunk, order, "_pl").drop("units")
    return s.join(dd, keys).withColumn("roi", F.try_divide("profit", "staked"))


def day_grain(bets: DataFrame, keys: list[str]) -> DataFrame:
    return bets.groupBy(*keys, "date").agg(F.sum("pnl").alias("u"), F.count("*").alias("n"))


def compounding_balance(bets: DataFrame, keys: list[str], share: float, start: float) -> DataFrame:
    """Balance after staking `share` of each morning's balance per bet (a day never stakes more than
    the balance): the product over days is a sum of logs."""
    d = day_grain(bets, keys)
    f = F.when(F.col("n") * share > 1, 1 / F.col("n")).otherwise(share)
    grow = F.greatest(1 + f * F.col("u"), F.lit(1e-300))
    return d.groupBy(*keys).agg((F.exp(F.sum(F.log(grow))) * start).alias("balance"), F.count("*").alias("days"))


def capped_compounding(bets: DataFrame, keys: list[str], share: float, cap: float, start: float) -> DataFrame:
    """As above with a money cap per bet: an ordered fold over day rows (at most one per calendar day)."""
    d = day_grain(bets, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "u", "n"))).alias("days"))
    step = lambda bal, x: bal + F.least(share * bal, F.lit(float(cap)), bal / x["n"]) * x["u"]
    return d.select(*keys, F.aggregate("days", F.lit(float(start)), step).alias("balance"))


def doubling_by_night(bets: DataFrame, keys: list[str], base: float, share: float | None, start: float) -> DataFrame:
    """Stake doubled after a losing night, back to base after a winning one or the third loss.
    Nights are the grain, so each fold runs over at most one row per day; all keys fold in parallel.
    `share` None stakes `base` flat, else that share of the balance."""
    d = day_grain(bets, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "u", "n"))).alias("days"))
    zero = F.struct(F.lit(float(start)).alias("acct"), F.lit(0).alias("lvl"), F.lit(0.0).alias("staked"), F.lit(0).alias("busts"), F.lit(float(start)).alias("low"))

    def step(s: Column, x: Column) -> Column:
        unit = F.lit(float(base)) if share is None else share * s["acct"]
        stake = F.least(unit * F.pow(F.lit(2.0), s["lvl"]), F.greatest(s["acct"], F.lit(0.0)) / x["n"])
        net = stake * x["u"]
        top = s["lvl"] == LEVELS - 1
        return F.struct((s["acct"] + net).alias("acct"), F.when((net >= 0) | top, 0).otherwise(s["lvl"] + 1).alias("lvl"),
                        (s["staked"] + stake * x["n"]).alias("staked"), (s["busts"] + ((net < 0) & top).cast("int")).alias("busts"),
                        F.least(s["low"], s["acct"] + net).alias("low"))

    return d.select(*keys, F.aggregate("days", zero, step).alias("r")).select(
        *keys, F.col("r.acct").alias("balance"), F.col("r.staked").alias("staked"), F.col("r.busts").alias("busts"), F.col("r.low").alias("lowest"))


def doubling_levels(bets: DataFrame, keys: list[str], chunk: Column, order: list[str]) -> DataFrame:
    """Doubling level of every bet, reset by a win or the third straight loss; pushes keep it. The
    level is the number of losses since the last win, modulo three, so no sequential state is needed:
    one running count of losses and one running maximum of that count at wins."""
    from pyspark.sql import Window

    b = bets.withColumn("_loss", (F.col("pnl") < 0).cast("double"))
    b = running_total(b, keys, chunk, order, "_loss", "_L").withColumn("_before", F.col("_L") - F.col("_loss"))
    b = b.withColumn("_chunk", chunk).withColumn("_mark", F.when(F.col("pnl") > 0, F.col("_L")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "_chunk").agg(F.max("_mark").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_chunk", F.max("_t").over(earlier).alias("_prev"))
    b = b.withColumn("_in", F.max("_mark").over(inside)).join(tops, keys + ["_chunk"])
    since = F.col("_before") - F.coalesce(F.greatest("_in", "_prev"), F.lit(0.0))
    return b.withColumn("level", (since % LEVELS).cast("int")).drop("_loss", "_L", "_before", "_chunk", "_mark", "_in", "_prev")


# ------------------------------------------------------------------ ledgers
def grade_singles(ledger: DataFrame, finals: DataFrame, keys: list[str]) -> DataFrame:
    """Result (+1/0/-1, null while pending) and profit of recorded singles at their own line."""
    j = ledger.join(finals.select(*keys, F.col("total").alias("final_total")), keys, "left")
    s = outcome_sign(F.col("final_total"), F.col("line"), F.col("side"))
    return j.withColumn("result", s).withColumn("profit", F.col("stake") * flat_profit(s, F.col("price")))


def grade_cards(legs: DataFrame, finals: DataFrame, keys: list[str]) -> DataFrame:
    """Cards from their legs: pending until every leg is known; any loss loses; pushes count as one."""
    g = legs.join(finals.select(*keys, F.col("total").alias("final_total")), keys, "left")
    s = outcome_sign(F.col("final_total"), F.col("line"), F.col("side"))
    factor = F.when(s == 1, F.log("price")).otherwise(0.0)
    c = g.groupBy("card").agg(F.count("*").alias("legs"), F.count("final_total").alias("known"), F.min(s).alias("worst"),
                              F.count_if(s == 1).alias("won_legs"), F.exp(F.sum(factor)).alias("pays"))
    done = F.col("known") == F.col("legs")
    lost = F.col("worst") == -1
    status = (F.when(lost & (F.col("known") > 0), "lost").when(~done, "pending").when(F.col("won_legs") == 0, "void").otherwise("won"))
    return c.select("card", "legs", "known", status.alias("status"),
                    F.when(lost, F.lit(-1.0)).when(done, F.col("pays") - 1).alias("profit"))


def failure_categories(losers: DataFrame, blowout: int = 20, sds: float = 1.5) -> DataFrame:
    """Blowout, model error or variance, decided mechanically. The error is outcome - line - mu, subtracted in this order: an
    error of exactly the limit must not change its category by how a sum of line and mu was rounded."""
    err = F.col("outcome") - F.col("line") - F.col("mu")
    cat = (F.when(F.abs(F.col("home_pts") - F.col("away_pts")) >= blowout, "blowout")
           .when(F.abs(err) > sds * F.col("sd"), "model_error").otherwise("variance"))
    return losers.withColumns({"error": err, "category": cat})


def shooting_luck(box: DataFrame) -> DataFrame:
    """Points above the season's league rate from threes, twos and free throws, per game."""
    b = box.withColumns({"fg2m": F.col("fgm") - F.col("fg3m"), "fg2a": F.col("fga") - F.col("fg3a")})
    rates = b.groupBy("season").agg(*[(F.sum(m) / F.sum(a)).alias(n) for m, a, n in (("fg3m", "fg3a", "r3"), ("ftm", "fta", "rf"), ("fg2m", "fg2a", "r2"))])
    g = b.groupBy("game_key", "season").agg(*[F.sum(c).alias(c) for c in ("fg3m", "fg3a", "ftm", "fta", "fg2m", "fg2a")], F.first("poss").alias("poss"))
    c = F.col
    return g.join(F.broadcast(rates), "season").select(                                # one row per season
        "game_key", "poss", (3 * (c("fg3m") - c("fg3a") * c("r3"))).alias("three_luck"), (c("ftm") - c("fta") * c("rf")).alias("ft_luck"),
        (2 * (c("fg2m") - c("fg2a") * c("r2"))).alias("two_luck"))

