"""Running totals, drawdown, streaks and exact quantiles without one task per group.

A plain ordered window puts a whole group into one task. Here every group is first cut into
ordered chunks; windows run inside a chunk, and only one small row per chunk is combined across
the group. A group holding a third of all rows is therefore spread like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.session import cut_lineage


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of `value` in `order`; `chunk` must never decrease along the order."""
    d = df.withColumn("_chunk", chunk)
    sums = d.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_t"))
    base = sums.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(_earlier(keys)), F.lit(0.0)).alias("_base"))
    local = d.withColumn("_local", F.sum(value).over(_inside(keys, order)))
    return (local.join(base, keys + ["_chunk"])
            .withColumn(name, F.col("_base") + F.coalesce("_local", F.lit(0.0)))
            .drop("_chunk", "_base", "_local"))


def running_max(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running maximum of `value` (nulls ignored), chunk by chunk."""
    d = df.withColumn("_chunk", chunk)
    tops = d.groupBy(*keys, "_chunk").agg(F.max(value).alias("_t"))
    base = tops.select(*keys, "_chunk", F.max("_t").over(_earlier(keys)).alias("_base"))
    local = d.withColumn("_local", F.max(value).over(_inside(keys, order)))
    return local.join(base, keys + ["_chunk"]).withColumn(name, F.greatest("_base", "_local")).drop("_chunk", "_base", "_local")


def drawdown(df: DataFrame, keys: list[str], chunk: Column, order: list[str], pnl: str) -> DataFrame:
    """Units and deepest fall from the running peak (the peak starts at 0), per key."""
    d = df.withColumn("_chunk", chunk)
    d = d.withColumn("_eq", F.sum(pnl).over(_inside(keys, order)))
    d = d.withColumn("_pk", F.max("_eq").over(_inside(keys, order)))
    parts = d.groupBy(*keys, "_chunk").agg(
        F.sum(pnl).alias("_t"), F.max("_eq").alias("_hi"), F.min("_eq").alias("_lo"),
        F.max(F.col("_pk") - F.col("_eq")).alias("_dd"))
    parts = parts.withColumn("_base", F.coalesce(F.sum("_t").over(_earlier(keys)), F.lit(0.0)))
    parts = parts.withColumn(
        "_peak", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_hi")).over(_earlier(keys))))
    worst = F.greatest(F.col("_dd"), F.col("_peak") - F.col("_base") - F.col("_lo"))
    return parts.groupBy(*keys).agg(F.sum("_t").alias("units"), F.max(worst).alias("max_drawdown"))


def longest_run(df: DataFrame, keys: list[str], chunk: Column, order: list[str], hit: Column, name: str) -> DataFrame:
    """Longest run of consecutive rows where `hit` holds (gaps and islands, chunk by chunk)."""
    d = df.withColumn("_chunk", chunk).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    d = d.withColumn("_isl", F.sum((~F.col("_hit")).cast("long")).over(_inside(keys, order)))
    pieces = d.groupBy(*keys, "_chunk", "_isl").agg(F.count_if("_hit").alias("_n"))
    last = pieces.groupBy(*keys, "_chunk").agg(F.max("_isl").alias("_m"))
    base = last.select(*keys, "_chunk", F.coalesce(F.sum("_m").over(_earlier(keys)), F.lit(0)).alias("_base"))
    runs = (pieces.join(base, keys + ["_chunk"])
            .groupBy(*keys, (F.col("_base") + F.col("_isl")).alias("_island")).agg(F.sum("_n").alias("_len")))
    return runs.groupBy(*keys).agg(F.max("_len").alias(name))


def in_ranges(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Adds `_chunk`, the number of a range of (keys, col) with about as many rows as any other, whatever the spread of
    the values: Spark samples the edges, so outliers and heavy tails make no chunk large. Written once, since the
    edges must be the same wherever the chunks are read; small inputs come out as one chunk."""
    return cut_lineage(df.repartitionByRange(*keys, col).withColumn("_chunk", F.spark_partition_id()))


def chunk_sums(ranged: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Inclusive running sums of `values`, as c_<value>, over a table made by `in_ranges`; one row a chunk is combined."""
    w = _inside(keys, order)
    parts = ranged.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    base = parts.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{v}").over(_earlier(keys)), F.lit(0)).alias(f"_b_{v}") for v in values])
    local = ranged.withColumns({f"c_{v}": F.sum(v).over(w) for v in values})
    return local.join(base, keys + ["_chunk"]).withColumns({f"c_{v}": F.col(f"c_{v}") + F.col(f"_b_{v}") for v in values}).drop("_chunk", *[f"_b_{v}" for v in values])


def value_ranks(df: DataFrame, keys: list[str], col: str, weight: str | None = None) -> DataFrame:
    """One row per distinct value: how many rows hold it (`n`) and how many are <= it (`cum`),
    with the group size `size`. Duplicates collapse map-side before anything is ordered. `weight`
    is a row count already reduced by the caller."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("v")).agg(n.alias("n"))
    size = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    out = chunk_sums(in_ranges(counts, keys, "v"), keys, ["v"], ["n"])
    out = out.join(size, keys) if keys else out.join(F.broadcast(size))       # no keys: one row
    return out.select(*keys, "v", "n", F.col("c_n").cast("long").alias("cum"), F.col("size"))


def grid_quantiles(df: DataFrame, keys: list[str], col: str, steps: int, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles 0, 1/steps, .., 1 per group: rows (keys, i, q)."""
    r = value_ranks(df, keys, col, weight=weight)
    last = F.col("size") - 1
    first_rank, last_rank = F.col("cum") - F.col("n"), F.col("cum") - 1
    lo_i = F.greatest(F.lit(0), F.ceil((first_rank - 1) * steps / F.greatest(last, F.lit(1))) - 1)
    hi_i = F.least(F.lit(steps), F.floor((last_rank + 1) * steps / F.greatest(last, F.lit(1))) + 1)
    r = r.withColumn("i", F.explode(F.when(lo_i <= hi_i, F.sequence(lo_i.cast("long"), hi_i.cast("long")))))
    floor_rank = F.floor(F.col("i") * last / F.lit(steps))
    frac = F.col("i") * last / F.lit(steps) - floor_rank
    ceil_rank = F.least(floor_rank + 1, last)
    inside = lambda k: (k >= first_rank) & (k <= last_rank)
    q = r.groupBy(*keys, "i").agg(
        F.max(F.when(inside(floor_rank), F.col("v"))).alias("_a"),
        F.max(F.when(inside(ceil_rank), F.col("v"))).alias("_b"), F.max(frac).alias("_f"))
    return q.where(F.col("_a").isNotNull()).select(
        *keys, F.col("i").cast("long").alias("i"), (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("q"))


def quantile_edges(df: DataFrame, keys: list[str], col: str, steps: int, weight: str | None = None) -> DataFrame:
    """Distinct bin edges per group as a sorted array (duplicate edges dropped)."""
    g = grid_quantiles(df, keys, col, steps, weight)
    return g.groupBy(*keys).agg(F.array_sort(F.collect_set("q")).alias("edges"))


def counts_below(hist: DataFrame, asks: DataFrame, keys: list[str], x: str, value: str, weight: str | None = None) -> DataFrame:
    """For every ask (keys, id, x, closed): how many history rows lie below x (at or below it when
    `closed`) and the sum of their `value`: rows (keys, id, below, below_value). History and asks
    share one axis, cut into ranges of equal numbers of rows, and a chunked running sum answers all asks. `weight`
    counts rows that the caller has already added up."""
    n = F.count("*") if weight is None else F.sum(weight)
    h = hist.groupBy(*keys, F.col(x).alias("x")).agg(n.cast("double").alias("n"), F.sum(value).cast("double").alias("w"))
    points = h.select(*keys, "x", F.lit(1).alias("pos"), "n", "w", F.lit(None).cast("string").alias("id"))
    q = asks.select(*keys, F.col(x).alias("x"), F.when(F.col("closed"), 2).otherwise(0).alias("pos"),
                    F.lit(0.0).alias("n"), F.lit(0.0).alias("w"), F.col("id").cast("string").alias("id"))
    axis = chunk_sums(in_ranges(points.unionByName(q), keys, "x"), keys, ["x", "pos"], ["n", "w"])
    return axis.where(F.col("id").isNotNull()).select(*keys, "id", F.col("c_n").cast("long").alias("below"), F.col("c_w").alias("below_value"))
