"""Prices, fair probabilities, value and settlement."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatemill.functions.numbers import clip

FLAT_PRICE = 1 + 100 / 110     # -110 as decimal odds


def american_to_decimal(a: Column) -> Column:
    """+150 -> 2.5, -110 -> 1.909...; |a| < 100 is not a price."""
    return F.when(a >= 100, 1 + a / 100.0).when(a <= -100, 1 + 100.0 / F.abs(a))


def decimal_to_american(d: Column) -> Column:
    return F.when(d >= 2, (d - 1) * 100.0).when(d > 1, -100.0 / (d - 1))


def no_vig(over: Column, under: Column) -> Column:
    """Proportional no-vig probability of the Over."""
    return (1 / over) / (1 / over + 1 / under)


def book_margin(over: Column, under: Column) -> Column:
    return 1 / over + 1 / under - 1


def expected_value(p: Column, price: Column) -> Column:
    return p * price - 1


def outcome_sign(outcome: Column, line: Column, side: Column) -> Column:
    """+1 win, 0 push, -1 loss for a bet on `side` (+1 Over, -1 Under)."""
    return F.signum((outcome - line) * side).cast("long")


def flat_profit(sign: Column, price: Column) -> Column:
    """Profit of one unit; a push returns the stake."""
    return F.when(sign == 1, price - 1).when(sign == -1, F.lit(-1.0)).when(sign == 0, F.lit(0.0))


def double_profit(sign_a: Column, price_a: Column, sign_b: Column, price_b: Column) -> Column:
    """Two-leg card: any loss loses, a pushed (void) leg counts as a factor of one."""
    factor = lambda s, p: F.when(s == 1, p).otherwise(F.lit(1.0))
    return (F.when((sign_a == -1) | (sign_b == -1), F.lit(-1.0))
            .otherwise(factor(sign_a, price_a) * factor(sign_b, price_b) - 1))


def points_clv(side: Column, close: Column, opened: Column) -> Column:
    """How far the line moved our way, in points."""
    return side * (close - opened)


def kelly_fraction(p: Column, price: Column, share: float) -> Column:
    return clip(F.try_divide(p * price - 1, price - 1), 0.0) * share
