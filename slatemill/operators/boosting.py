"""Boosted regression trees for every season prefix from one table of cells.

Features are binned once, by quantiles of the seasons before the first fit. With a squared loss a forecast depends on the
bins alone, so rows of equal bins share their residual: counts and target sums per (season, cell) are all that
boosting needs, and cells are bounded by the bins, whatever the number of rows. A fit for season s is the sum of
the cells before s. All fits come from one aggregate and grow in parallel, one task a season; trees grow leaf by leaf on
histograms of gradient sums and counts.
"""
from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.operators.running import grid_quantiles
from slatemill.session import cut_lineage

MAX_CELLS, MOST_BINS = 1 << 18, 64


@dataclass(frozen=True)
class Boost:
    """Trees, step, leaves a tree, least rows a leaf, ridge penalty on leaf values, share of features a tree may use."""
    trees: int = 400
    rate: float = 0.02
    leaves: int = 15
    min_rows: float = 300
    penalty: float = 20.0
    columns: float = 0.8
    seed: int = 0


#: Settings of the totals model and of the player points model.
TOTALS = Boost()
POINTS = Boost(trees=500, rate=0.03, leaves=31, min_rows=200, penalty=10.0)


def best_split(flat: np.ndarray, g: np.ndarray, n: np.ndarray, rows: np.ndarray, use: np.ndarray, width: int, b: Boost) -> tuple[float, int, int]:
    """(gain, feature, last bin on the left) of the best split of a leaf; gain 0 where there is none. Ties go to the first
    feature and bin."""
    size = (int(use.max()) + 1) * width
    at = flat[rows][:, use]
    hist = lambda x: np.bincount(at.ravel(), weights=np.repeat(x[rows], len(use)), minlength=size)[:size].reshape(-1, width)[use].cumsum(axis=1)
    gl, nl = hist(g), hist(n)
    total_g, total_n = gl[:, -1:], nl[:, -1:]
    gr, nr = total_g - gl, total_n - nl
    gain = gl ** 2 / (nl + b.penalty) + gr ** 2 / (nr + b.penalty) - total_g ** 2 / (total_n + b.penalty)
    gain = np.where((nl >= b.min_rows) & (nr >= b.min_rows), gain, 0.0)
    i = int(gain.argmax())
    return float(gain.flat[i]), int(use[i // width]), i % width


def boost_cells(bins: np.ndarray, n: np.ndarray, s: np.ndarray, b: Boost) -> np.ndarray:
    """Forecast of every cell from counts `n` and target sums `s`; cells without rows are forecast too."""
    k, width = bins.shape[1], int(bins.max()) + 1
    flat = bins + np.arange(k) * width
    out = np.full(len(bins), s.sum() / n.sum())
    rnd = np.random.default_rng(b.seed)
    for _ in range(b.trees):
        use = np.sort(rnd.choice(k, min(k, max(1, ceil(b.columns * k))), replace=False))
        g = s - n * out
        rows = np.arange(len(bins))
        leaves = [(best_split(flat, g, n, rows, use, width, b), rows)]
        while len(leaves) < b.leaves:
            i = max(range(len(leaves)), key=lambda j: leaves[j][0][0])
            (gain, feature, cut), rows = leaves[i]
            if gain <= 1e-12:
                break
            left = bins[rows, feature] <= cut
            halves = [rows[left], rows[~left]]
            leaves[i:i + 1] = [(best_split(flat, g, n, r, use, width, b), r) for r in halves]
        if len(leaves) == 1 and b.columns >= 1:
            break                               # no tree can split any more
        for _, rows in leaves:
            out[rows] += b.rate * g[rows].sum() / (n[rows].sum() + b.penalty)
    return out


def _bin(x: Column, edges: list[float]) -> Column:
    """1 + the number of edges at or below x; 0 for null."""
    e = F.array(*[F.lit(float(v)) for v in edges]).cast("array<double>")
    return F.when(x.isNull(), 0).otherwise(1 + F.size(F.filter(e, lambda v: v <= x)))


def boosted_walk_forward(df: DataFrame, feats: list[str], target: str, boost: Boost = TOTALS, min_train: int = 2) -> DataFrame:
    """The rows of `df` of every season that has `min_train` seasons before it, with `mu_gbt`: the boosted mean fitted on the
    eligible rows of all earlier seasons. A missing feature has a bin of its own, below the others. Seasons without
    an eligible row before them are forecast as null."""
    seasons = sorted(r[0] for r in df.select("season").distinct().collect())              # a short list
    if len(seasons) <= min_train:
        return df.limit(0).withColumn("mu_gbt", F.lit(None).cast("double"))
    bins = int(min(MOST_BINS, MAX_CELLS ** (1 / len(feats))))
    early = df.where((F.col("season") < seasons[min_train]) & F.col("eligible"))
    long = early.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in feats])).alias("x")).select("x.*")
    edges: dict[str, set] = {c: set() for c in feats}
    for r in grid_quantiles(long, ["col"], "v", bins).where((F.col("i") > 0) & (F.col("i") < bins)).collect():     # at most `bins` a feature
        edges[r["col"]].add(r["q"])
    place = {f"_b{i}": _bin(F.col(c).cast("double"), sorted(edges[c])) for i, c in enumerate(feats)}
    keys = list(place)
    d = df.withColumns(place)
    cells = cut_lineage(d.groupBy("season", *keys).agg(F.count_if(F.col("eligible") & F.col(target).isNotNull()).alias("n"),
                                                       F.coalesce(F.sum(F.when(F.col("eligible"), F.col(target).cast("double"))), F.lit(0.0)).alias("s")))
    kind = df.schema["season"].dataType.simpleString()
    fits = df.sparkSession.createDataFrame([(s,) for s in seasons[min_train:]], f"fit {kind}")
    pairs = cells.join(F.broadcast(fits), F.col("season") <= F.col("fit"))                # one row a season
    now = F.col("season") == F.col("fit")
    given = pairs.groupBy("fit", *keys).agg(F.sum(F.when(now, 0).otherwise(F.col("n"))).cast("double").alias("n"), F.sum(F.when(now, 0.0).otherwise(F.col("s"))).alias("s"))

    def fit(key: tuple, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(keys)
        n, s = c["n"].to_numpy(float), c["s"].to_numpy(float)
        mu = boost_cells(c[keys].to_numpy(np.int64), n, s, boost) if n.sum() else np.full(len(c), np.nan)
        return c[keys].assign(season=key[0], mu_gbt=mu)

    forecast = cut_lineage(given.groupBy("fit").applyInPandas(fit, f"season {kind}, " + ", ".join(f"{k} int" for k in keys) + ", mu_gbt double"))
    return d.join(forecast, ["season", *keys]).drop(*keys).withColumn("mu_gbt", F.nanvl("mu_gbt", F.lit(None).cast("double")))
