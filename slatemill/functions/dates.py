"""Calendar helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_label(d: Column, first_month: int) -> Column:
    """'2015-16' style label; seasons start in `first_month`."""
    start = F.year(d) - (F.month(d) < first_month).cast("int")
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_clock(ts: Column, zone: str, hour: int) -> Column:
    """UTC instant of `hour` o'clock on the local calendar day of ts."""
    midnight = F.date_trunc("day", F.from_utc_timestamp(ts, zone))
    return F.to_utc_timestamp(midnight + F.make_dt_interval(F.lit(0), F.lit(hour)), zone)


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))
