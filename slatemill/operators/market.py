"""Fair curves, value legs, best quotes and two-leg cards from a quote log."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip
from slatemill.functions.odds import american_to_decimal, no_vig
from slatemill.functions.probability import add_norm_cdf, add_norm_ppf
from slatemill.operators.asof import board_at, starting_times, two_way
from slatemill.operators.history import centre_before
from slatemill.operators.running import grid_quantiles
from slatemill.session import cut_lineage

# Spread used for a single line, flattest slope accepted, combined odds floor.
SIGMA_SINGLE = 16.0
FLATTEST = 1 / 40
MIN_CARD_ODDS = 2.5


def is_half_line(line: Column) -> Column:
    return (line * 2) % 2 == 1


def fair_curve(board: DataFrame, book: str, keys: list[str] | None = None, whole_lines: bool = False) -> DataFrame:
    """P(over at x) = Phi(a - b x) per fixture, a straight line through the sharp book's no-vig
    probits. One aggregate per fixture; a single line or a flat fit falls back to a fixed spread.
    `whole_lines` lets a fixture without half-point lines use its whole ones."""
    keys = keys or ["fixture_id"]
    w = two_way(board.where(F.col("book") == book), keys + ["line"])
    half = is_half_line(F.col("line"))
    if whole_lines:
        any_half = w.groupBy(*keys).agg(F.max(half).alias("_half"))
        w = w.join(any_half, keys).where(half | ~F.col("_half")).drop("_half")
    else:
        w = w.where(half)
    w = w.withColumn("p", no_vig(F.col("over"), F.col("under")))
    w = add_norm_ppf(w, "z", clip(F.col("p"), 0.02, 0.98))
    s = w.groupBy(*keys).agg(
        F.regr_slope("z", "line").alias("slope"), F.avg("z").alias("mz"), F.avg("line").alias("ml"),
        # mirrored prices miss 0.5 by the same but for rounding; the smaller line wins such a tie
        F.min_by("line", F.abs(F.col("p") - 0.5) + F.col("line") * 1e-13).alias("main"), F.count("*").alias("lines"))
    b = F.when(-F.col("slope") > FLATTEST, -F.col("slope")).otherwise(1 / SIGMA_SINGLE)
    return s.withColumn("b", b).withColumn("a", F.col("mz") + F.col("b") * F.col("ml")).select(
        *keys, "a", "b", (F.col("a") / F.col("b")).alias("fair_mu"), "main", "lines")


def add_fair_probability(df: DataFrame, out: str, a: Column, b: Column) -> DataFrame:
    """Adds the curve's probability that `side` wins at `line`."""
    d = add_norm_cdf(df, "_over", a - b * F.col("line"))
    return d.withColumn(out, F.when(F.col("side") == "over", F.col("_over")).otherwise(1 - F.col("_over"))).drop("_over")


def value_legs(quotes: DataFrame, when: DataFrame, closing: DataFrame, soft: list[str], sharp: str,
               finals: DataFrame, date_of: Column, extra: list[str] | None = None) -> DataFrame:
    """Soft-book prices in force at `when`, valued against the sharp curve of the same moment (EV)
    and of the close (CLV), with the model's view centred on earlier dates and the result.
    `closing` is a fair curve; `finals` holds fixture_id, final, model."""
    extra = extra or []
    keys = extra + ["fixture_id"]
    b = cut_lineage(board_at(quotes, when, extra=extra))          # read twice below
    now = fair_curve(b, sharp, keys).select(*keys, "a", "b", "fair_mu")
    cl = closing.select("fixture_id", F.col("a").alias("ca"), F.col("b").alias("cb"))
    starts = starting_times(quotes)
    s = (b.where(F.col("book").isin(soft) & is_half_line(F.col("line"))).join(now, keys).join(cl, "fixture_id")
         .join(starts, "fixture_id").join(finals, "fixture_id", "left").withColumn("date", date_of))
    s = cut_lineage(s)                                            # read twice below
    # one deviation per fixture, centred on the mean of earlier dates
    dev = s.groupBy(*keys, "date").agg(F.first(F.col("model") - F.col("fair_mu")).alias("dev"))
    dev = centre_before(dev, extra, "date", "dev", "dev_c").select(*keys, "dev_c")
    s = s.join(dev, keys, "left")
    over = F.col("side") == "over"
    agrees = F.coalesce(F.when(over, F.col("dev_c") > 0).otherwise(F.col("dev_c") < 0), F.lit(False))
    s = add_fair_probability(s, "p_now", F.col("a"), F.col("b"))
    s = add_fair_probability(s, "p_close", F.col("ca"), F.col("cb"))
    won = F.when(over, F.col("final") > F.col("line")).otherwise(F.col("final") < F.col("line"))
    return s.select(*keys, "date", "book", "line", "side", "price", (F.col("p_now") * F.col("price") - 1).alias("ev_now"),
                    (F.col("p_close") * F.col("price") - 1).alias("clv"), agrees.alias("model_agrees"),
                    F.when(F.col("final").isNotNull(), won).alias("win"))


def best_leg_per_game(legs: DataFrame, keys: list[str], rule: Column | None = None) -> DataFrame:
    """Highest-EV leg per game among those meeting `rule`: a map-side-combining aggregate, no sort.
    The rule sits inside the aggregate, so EV is computed once and not again in a pushed filter."""
    rest = [c for c in legs.columns if c not in keys]
    rule = F.lit(True) if rule is None else rule
    order = F.when(rule, F.struct("ev_now", "price", "line", "side", "book"))
    best = legs.groupBy(*keys).agg(F.max_by(F.when(rule, F.struct(*rest)), order).alias("l"))
    return best.where(F.col("l").isNotNull()).select(*keys, "l.*")


def best_partner(legs: DataFrame, group: list[str], key: str, price: str, value: str, floor: float) -> DataFrame:
    """For every leg its best partner of the same group whose price brings the pair to the odds
    floor. No pairs are formed: legs (at their own price) and requests (at floor / price) are laid
    on one descending price axis, and a running top two of `value` answers each request."""
    me = F.struct(F.col(value).alias("v"), F.col(key).alias("k"), F.col(price).alias("o"))
    req = F.lit(floor) / F.col(price) * (1 - 1e-12)
    axis = legs.select(*group, F.explode(F.array(
        F.struct(F.lit(0).alias("ask"), F.col(price).alias("x"), me.alias("me")),
        F.struct(F.lit(1).alias("ask"), req.alias("x"), me.alias("me")))).alias("e")).select(*group, "e.*")
    w = Window.partitionBy(*group).orderBy(F.col("x").desc(), "ask", "me.k")
    offer = F.when(F.col("ask") == 0, F.col("me"))
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    axis = axis.withColumn("top", F.max(offer).over(upto)).withColumn("prev", F.max(offer).over(before))
    loser = F.when(F.col("ask") == 0, F.least("me", "prev"))
    loser = F.when(F.col("prev").isNotNull(), loser)
    axis = axis.withColumn("second", F.max(loser).over(upto))
    partner = F.when(F.col("top.k") == F.col("me.k"), F.col("second")).otherwise(F.col("top"))
    return (axis.where("ask = 1").withColumn("p", partner).where(F.col("p").isNotNull())
            .select(*group, F.col("me.k").alias("leg"), F.col("p.k").alias("partner"), (F.col("me.v") * F.col("p.v")).alias("joint")))


def best_pair(legs: DataFrame, group: list[str], key: str = "fixture_id", price: str = "price",
              value: str = "v", floor: float = MIN_CARD_ODDS) -> DataFrame:
    """The pair with the highest joint value per group: (group, leg_a, leg_b, joint), a < b."""
    p = best_partner(legs, group, key, price, value, floor)
    a, b = F.least("leg", "partner"), F.greatest("leg", "partner")
    best = F.struct(a.alias("leg_a"), b.alias("leg_b"), "joint")
    return p.groupBy(*group).agg(F.min_by(best, F.struct(-F.col("joint"), a, b)).alias("m")).select(*group, "m.*")


class BestPartners:
    """Legs in the order of falling price under a tournament tree of their values: the best partner of a leg is the
    winner of a prefix, the legs dear enough for the pair to reach the odds floor. Legs leave as they are taken."""

    def __init__(self, price: np.ndarray, value: np.ndarray, floor: float):
        """Legs must come in the order of their keys: equal values go to the earlier leg."""
        self.order = np.argsort(-price, kind="stable")
        self.value, n = value, len(price)
        self.size = 1 << max(0, n - 1).bit_length()
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.order] = np.arange(n)
        need = floor / price * (1 - 1e-12)
        self.reach = np.searchsorted(-price[self.order], -need, side="right")       # legs with a price of at least `need`
        leaves = np.full(self.size, -1, dtype=np.int64)
        leaves[:n] = self.order
        self.tree = [0] * self.size + leaves.tolist()
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = self.winner(self.tree[2 * i], self.tree[2 * i + 1])

    def winner(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        va, vb = self.value[a], self.value[b]
        return a if va > vb or (va == vb and a < b) else b

    def best(self, leg: int) -> int:
        """The partner of the highest value, -1 if there is none."""
        own, stop = int(self.place[leg]), int(self.reach[leg])
        return self.winner(self._over(0, min(own, stop)), self._over(own + 1, stop))

    def _over(self, a: int, b: int) -> int:
        won, a, b = -1, a + self.size, b + self.size
        while a < b:
            if a & 1:
                won, a = self.winner(won, self.tree[a]), a + 1
            if b & 1:
                b -= 1
                won = self.winner(won, self.tree[b])
            a, b = a >> 1, b >> 1
        return won

    def leave(self, leg: int) -> None:
        i = int(self.place[leg]) + self.size
        self.tree[i] = -1
        while i > 1:
            i >>= 1
            self.tree[i] = self.winner(self.tree[2 * i], self.tree[2 * i + 1])


def greedy_matching(price: np.ndarray, value: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Pairs (a < b) that greedy picking would take: the pair of the highest joint value, then the highest among the
    legs left, while it is above 1; ties go to the smaller legs. Follows best partners until two legs are each
    other's best: such a pair is taken by any order of greedy picks, so every leg is asked a bounded number of times."""
    legs, out = BestPartners(price, value, floor), []
    live, chain = [True] * len(price), []
    edge = lambda i, j: (-(value[i] * value[j]), min(i, j), max(i, j))
    for start in range(len(price)):
        chain = [start] if live[start] else []
        while chain:
            i = chain[-1]
            j = legs.best(i)
            if j < 0 or value[i] * value[j] <= 1:
                legs.leave(i)           # none of its pairs is worth its stake, now or later
                live[i] = False
                chain.pop()
            elif len(chain) > 1 and edge(i, j) >= edge(chain[-2], i):
                j = chain[-2]
                out.append((min(i, j), max(i, j)))
                for x in (i, j):
                    legs.leave(x)
                    live[x] = False
                del chain[-2:]
            else:
                chain.append(j)
    return out


def disjoint_pairs(legs: DataFrame, group: list[str], key: str = "fixture_id", price: str = "price", value: str = "v", floor: float = MIN_CARD_ODDS) -> DataFrame:
    """Greedy matching (best pair, then the best among the remaining games, ...) of every group, in one job whatever the
    number of pairs. Stops when no pair is worth more than its stake. A group's legs, one a game and three plain
    columns each, are held by one task; legs that no partner could lift above 1 are left out before."""
    d = legs.select(*group, key, F.col(price).cast("double").alias("_p"), F.col(value).cast("double").alias("_v")).where("_p > 0 AND _v > 0")
    top = d.groupBy(*group).agg(F.max("_v").alias("_top"), F.max("_p").alias("_dear"))
    d = d.join(top, group).where((F.col("_v") * F.col("_top") > 1) & (F.col("_p") * F.col("_dear") >= floor * (1 - 1e-9))).drop("_top", "_dear")
    kinds = {f.name: f.dataType.simpleString() for f in legs.schema.fields}
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], f"leg_a {kinds[key]}, leg_b {kinds[key]}, joint double"])

    def match(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        names, p, v = rows[key].tolist(), rows["_p"].to_numpy(), rows["_v"].to_numpy()
        found = greedy_matching(p, v, floor)
        return pd.DataFrame([(*ids, names[a], names[b], v[a] * v[b]) for a, b in found], columns=[*group, "leg_a", "leg_b", "joint"])

    return d.groupBy(*group).applyInPandas(match, schema)


def card_rows(pairs: DataFrame, legs: DataFrame, group: list[str], key: str = "fixture_id") -> DataFrame:
    """Attach both legs' prices and results to the chosen pairs."""
    side = lambda s: legs.select(*group, F.col(key).alias(f"leg_{s}"), F.col("price").alias(f"price_{s}"),
                                 F.col("ev_now").alias(f"ev_{s}"), F.col("clv").alias(f"clv_{s}"), F.col("win").alias(f"win_{s}"))
    c = pairs.join(side("a"), group + ["leg_a"]).join(side("b"), group + ["leg_b"])
    odds = F.col("price_a") * F.col("price_b")
    win = F.col("win_a") & F.col("win_b")
    return c.select(*group, "leg_a", "leg_b", odds.alias("odds"), (F.col("joint") - 1).alias("ev"),
                    ((1 + F.col("clv_a")) * (1 + F.col("clv_b")) - 1).alias("clv"), win.alias("win"),
                    F.when(win, odds - 1).when(~win, F.lit(-1.0)).alias("pnl"))


# ------------------------------------------------------------------ book quotes of a game
def explode_books(games: DataFrame, books: str = "books") -> DataFrame:
    """A map book -> quote becomes one row per (game, book)."""
    return games.select("game_key", F.explode(books).alias("book", "x")).select("game_key", "book", "x.*")


def consensus(quotes: DataFrame) -> DataFrame:
    """Cross-book opener per game: median, population spread and count. Lines are half points, so
    the median's partial state is a short table of distinct values."""
    return quotes.where(F.col("open").isNotNull()).groupBy("game_key").agg(
        F.median("open").alias("line"), F.stddev_pop("open").alias("book_sd"), F.count("*").alias("books"))


def without_outliers(quotes: DataFrame, max_dev: float = 3.0) -> DataFrame:
    """Books further than `max_dev` points from the game's median opener are data errors."""
    return quotes.join(consensus(quotes).select("game_key", F.col("line").alias("median_line")), "game_key").where(
        F.abs(F.col("open") - F.col("median_line")) <= max_dev)


def best_quotes(quotes: DataFrame, max_dev: float = 3.0) -> DataFrame:
    """Per game: the best opening number for each side (lowest for Over, highest for Under), then
    the best price; books without a real price do not count."""
    q = without_outliers(quotes, max_dev).withColumns(
        {"dec_over": american_to_decimal(F.col("open_over")), "dec_under": american_to_decimal(F.col("open_under"))})

    def pick(side: int, price: str, tag: str) -> Column:
        ok = F.col(price).isNotNull()
        return F.min_by(F.when(ok, F.struct(F.col("open").alias("line"), F.col(price).alias("price"), "book")),
                        F.when(ok, F.struct((side * F.col("open")).alias("l"), (-F.col(price)).alias("d"), "book"))).alias(tag)

    b = q.groupBy("game_key").agg(pick(1, "dec_over", "o"), pick(-1, "dec_under", "u"))
    return b.select("game_key", *[F.col(f"{t}.{c}").alias(f"{n}_{c}") for t, n in (("o", "over"), ("u", "under"))
                                  for c in ("line", "price", "book")])


def median_price_at_median(quotes: DataFrame) -> DataFrame:
    """Median decimal price of each side among books quoting the median opener exactly."""
    q = quotes.join(consensus(quotes).select("game_key", "line"), "game_key").where(F.col("open") == F.col("line"))
    return q.groupBy("game_key", "line").agg(
        F.median(american_to_decimal(F.col("open_over"))).alias("over"),
        F.median(american_to_decimal(F.col("open_under"))).alias("under"), F.count("*").alias("books"))


def result_quantiles(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """p10 .. p90 of an outcome per group, exact and without holding a group in one task."""
    q = grid_quantiles(df, keys, col, 20).where(F.col("i").isin(2, 5, 10, 15, 18))
    name = {2: "p10", 5: "p25", 10: "p50", 15: "p75", 18: "p90"}
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in name.items()])
