"""Scalar helpers on numeric columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; null stays null (greatest/least alone would skip it)."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def coerce_number(text: Column) -> Column:
    """Free text to double: 'PK'/'P' (pick'em) is 0, anything unreadable is null."""
    t = F.upper(F.trim(text))
    return F.when(t.isin("PK", "P"), F.lit(0.0)).otherwise(null_if_nan(t.try_cast("double")))


def half_point_above(line: Column) -> Column:
    """Smallest half-point threshold an Over at `line` must clear."""
    return F.ceil(line + 0.5).cast("double") - 0.5


def half_point_below(line: Column) -> Column:
    """Largest half-point threshold an Under at `line` must stay below."""
    return F.floor(line - 0.5).cast("double") + 0.5


def half_point_threshold(line: Column, side: Column) -> Column:
    return F.when(side == 1, half_point_above(line)).otherwise(half_point_below(line))


def effective_threshold(thr: Column, side: Column) -> Column:
    """A whole-number line wins only on the next whole point, so it acts half a point tighter."""
    return F.when(thr == F.floor(thr), thr + 0.5 * side).otherwise(thr)


def row_max(cols: list[Column]) -> Column:
    return F.greatest(*cols)


def total_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def polynomial(x: Column, coefs: list[float]) -> Column:
    """Horner evaluation, highest power first."""
    acc: Column = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc
