"""Price boards: the state of an append-only quote log at a moment.

The log records changes only, so the price in force is the last update at or before the moment.
`max_by` on plain numbers aggregates in a hash map on the map side, so a fixture with a third of all
updates costs one partial row per task, and no update history is ever sorted or collected. `seq` is
the log order (time, then arrival); a source without one uses unix_micros(t).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["fixture_id", "book", "line", "side"]


def board_at(quotes: DataFrame, when: DataFrame, cell: list[str] = CELL, extra: list[str] | None = None) -> DataFrame:
    """Quotes in force at `when` (fixture_id, when[, extra keys such as the decision name]);
    cells whose last update was inactive are not offered."""
    extra = extra or []
    q = quotes.join(when, "fixture_id").where(F.col("t") <= F.col("when"))
    last = q.groupBy(*extra, *cell).agg(F.max("t").alias("t"), F.max_by("price", "seq").alias("price"), F.max_by("active", "seq").alias("active"))
    return last.where(F.col("active") & (F.col("price") > 1)).drop("active")


def next_change(board: DataFrame, quotes: DataFrame, when: DataFrame) -> DataFrame:
    """Minutes each offered cell survived after `when`: time of its first later update."""
    later = (quotes.join(when, "fixture_id").where(F.col("t") > F.col("when"))
             .groupBy(*CELL).agg(F.min("t").alias("next_t")))
    return (board.join(later, CELL, "left").join(when, "fixture_id")
            .withColumn("minutes", (F.col("next_t").cast("double") - F.col("when").cast("double")) / 60)
            .drop("when"))


def close_board(quotes: DataFrame, tolerance_minutes: float = 30) -> DataFrame:
    """Last active price per cell, kept if the cell was still offered within the tolerance of the
    book's last update on the fixture (books suspend everything just before the start)."""
    live = F.col("active") & (F.col("price") > 1)
    cells = quotes.groupBy(*CELL).agg(
        F.max("t").alias("last_t"), F.max_by("active", "seq").alias("last_active"),
        F.max(F.when(live, F.col("t"))).alias("t"), F.max_by("price", F.when(live, F.col("seq"))).alias("price"))
    end = cells.groupBy("fixture_id", "book").agg(F.max("last_t").alias("end_t"))
    gap = (F.col("end_t").cast("double") - F.col("last_t").cast("double")) / 60
    return (cells.join(end, ["fixture_id", "book"])
            .where((F.col("last_active") | (gap <= tolerance_minutes)) & F.col("t").isNotNull())
            .select(*CELL, "t", "price"))


def open_close_ladder(quotes: DataFrame, tolerance_minutes: float = 30) -> DataFrame:
    """First and last active price per cell, with whether the cell was still offered at the close."""
    live = F.col("active") & (F.col("price") != 0)          # a null or zero price is no offer
    when_live = lambda c: F.when(live, F.col(c))
    cells = quotes.groupBy(*CELL).agg(
        F.min(when_live("t")).alias("open_t"), F.min_by("price", when_live("seq")).alias("open_price"),
        F.max(when_live("t")).alias("close_t"), F.max_by("price", when_live("seq")).alias("close_price"),
        F.max("t").alias("last_t"), F.max_by("active", "seq").alias("last_active"))
    cells = cells.where(F.col("open_t").isNotNull())
    end = cells.groupBy("fixture_id", "book").agg(F.max("last_t").alias("end_t"))
    gap = (F.col("end_t").cast("double") - F.col("last_t").cast("double")) / 60
    return cells.join(end, ["fixture_id", "book"]).select(
        *CELL, "open_price", "open_t", "close_price", "close_t", (F.col("last_active") | (gap <= tolerance_minutes)).alias("close_active"))


def prefer_overtime_lines(ladder: DataFrame) -> DataFrame:
    """Drop regulation-only lines where the same book prices overtime-inclusive ones."""
    flags = ladder.groupBy("fixture_id", "book").agg(F.max("incl_ot").alias("has_ot"))
    return ladder.join(flags, ["fixture_id", "book"]).where(F.col("incl_ot") | ~F.col("has_ot")).drop("has_ot")


def two_way(board: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Over and Under side by side; one-sided cells drop out."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col(price))).alias(s)
    return board.groupBy(*keys).agg(side("over"), side("under")).na.drop(subset=["over", "under"])


def main_lines(ladder: DataFrame, balance: float = 0.08, window_seconds: float = 600) -> DataFrame:
    """Per fixture and book: the opening main line (most balanced among near-balanced lines posted
    in the first ten minutes) and the closing one (most balanced still offered)."""
    s = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    key = ["fixture_id", "book"]
    o = ladder.groupBy(*key, "line").agg(s("over", "open_price").alias("po"), s("under", "open_price").alias("pu"),
                                        F.min("open_t").alias("first_t")).na.drop(subset=["po", "pu"])
    o = o.withColumn("imb", F.abs(1 / F.col("po") - 1 / F.col("pu"))).where(F.col("imb") < balance)
    first = o.groupBy(*key).agg(F.min("first_t").alias("f0"))
    o = o.join(first, key).where(F.col("first_t").cast("double") <= F.col("f0").cast("double") + window_seconds)
    opened = o.groupBy(*key).agg(F.min_by(F.struct("line", "po", "pu"), F.struct("imb", "line")).alias("o"))
    c = ladder.where("close_active").groupBy(*key, "line").agg(
        s("over", "close_price").alias("po"), s("under", "close_price").alias("pu")).na.drop(subset=["po", "pu"])
    c = c.withColumn("imb", F.abs(1 / F.col("po") - 1 / F.col("pu")))
    closed = c.groupBy(*key).agg(F.min_by(F.struct("line", "po", "pu"), F.struct("imb", "line")).alias("c"))
    return opened.join(closed, key, "full").select(
        *key, F.col("o.line").alias("open_line"), F.col("o.po").alias("open_over"), F.col("o.pu").alias("open_under"),
        F.col("c.line").alias("close_line"), F.col("c.po").alias("close_over"), F.col("c.pu").alias("close_under"))


def starting_times(quotes: DataFrame) -> DataFrame:
    """Start of each fixture as its last update has it; a fixture may be moved."""
    return quotes.groupBy("fixture_id").agg(F.max_by("start", "seq").alias("start"))


def decision_at(quotes: DataFrame, hours: float) -> DataFrame:
    """Act `hours` before the scheduled start."""
    starts = starting_times(quotes)
    return starts.select("fixture_id", (F.col("start") - F.make_dt_interval(secs=F.lit(hours * 3600.0))).alias("when"))


def first_post(quotes: DataFrame, book: str, delay_minutes: float = 0.0) -> DataFrame:
    """Act when `book` first shows a price, plus a delay."""
    t = quotes.where(F.col("book") == book).groupBy("fixture_id").agg(F.min("t").alias("t0"))
    return t.select("fixture_id", (F.col("t0") + F.make_dt_interval(secs=F.lit(delay_minutes * 60.0))).alias("when"))


def at_local_hour(quotes: DataFrame, zone: str, hour: int) -> DataFrame:
    """Act at a local clock hour of the game day, where that is before the start."""
    from slatemill.functions.dates import local_clock

    starts = starting_times(quotes)
    return starts.withColumn("when", local_clock(F.col("start"), zone, hour)).where(F.col("when") < F.col("start")).drop("start")


def side_sign(side: Column) -> Column:
    return F.when(side == "over", 1).otherwise(-1)
