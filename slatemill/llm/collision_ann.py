"""Nearest neighbours by inner product with query-aware collision counting.

Every shard projects its vectors on single directions and keeps one sorted array a direction. A query opens a
window around its own projection in each array; a vector whose projections fall into at least `needed` windows
collides often enough and is verified by its true inner product. Virtual rehashing widens the windows: a radius
doubles until k vectors are verified, then jumps to the distance of the k-th, at which every vector as near as
that collides often enough with the chosen probability.

Inner products become distances by one more component that gives every vector the same norm. Shards and query
blocks meet pairwise; each pair returns k rows a query, and the best k of all shards are kept.
"""
from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage
from slatemill.llm.vectors import fit_vectors, spread, stack

DIRECTIONS, WINDOW, MISS = 64, 1.1, 0.05
SHARD, BLOCK, GROUP, SEED = 16_384, 1024, 64, 11
FIRST = 0.2         # first radius, as a share of the largest norm


def collisions_needed(directions: int, window: float, miss: float) -> int:
    """Most collisions that a vector at distance 1 reaches with probability 1 - miss, its projections being normal
    and the half-window `window` of their deviations."""
    p, below = erf(window / sqrt(2)), 0.0
    for n in range(directions + 1):
        below += comb(directions, n) * p ** n * (1 - p) ** (directions - n)
        if below > miss:
            return n
    return directions


class SortedProjections:
    """The sorted arrays of one shard. `top` is the largest norm of all shards."""

    def __init__(self, v: np.ndarray, top: float):
        self.v, self.top = v, top
        rnd, dim = np.random.default_rng(SEED), v.shape[1] + 1
        axes = [np.linalg.qr(rnd.normal(size=(dim, dim)))[0] for _ in range(-(-DIRECTIONS // dim))]
        self.axes = np.vstack(axes)[:DIRECTIONS] * sqrt(dim)          # a projected difference deviates by its length
        lift = np.sqrt(np.maximum(0, top * top - np.einsum("ij,ij->i", v, v)))
        p = np.hstack([v, lift[:, None]]) @ self.axes.T
        order = np.argsort(p, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, axis=0).T)
        self.single = v.astype(np.float32)
        self.needed = collisions_needed(DIRECTIONS, WINDOW, MISS)

    def search(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows of the verified vectors with the k largest inner products, and of those so near to the k-th
        that single precision cannot tell."""
        n, k = len(self.v), min(k, len(self.v))
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = (queries * (self.top / norm)[:, None]) @ self.axes[:, :-1].T
        lo = np.stack([np.searchsorted(row, x) for row, x in zip(self.sorted, at.T)], axis=1)
        hi, radius = lo.copy(), np.full(len(queries), FIRST * self.top)
        hits, inner = np.zeros((len(queries), n), dtype=np.int16), np.full((len(queries), n), -np.inf, dtype=np.float32)
        live, last = np.arange(len(queries)), np.zeros(len(queries), dtype=bool)
        q = queries.astype(np.float32)
        while len(live):
            half = WINDOW * radius[live]
            left = np.stack([np.searchsorted(row, x - half, "left") for row, x in zip(self.sorted, at[live].T)], axis=1)
            right = np.stack([np.searchsorted(row, x + half, "right") for row, x in zip(self.sorted, at[live].T)], axis=1)
            left, right = np.minimum(left, lo[live]), np.maximum(right, hi[live])
            more = []
            for i, a, b in zip(live, left, right):
                ring = [o[x:y] for o, x, y in zip(self.order, a, lo[i])] + [o[x:y] for o, x, y in zip(self.order, hi[i], b)]
                hits[i] += np.bincount(np.concatenate(ring), minlength=n).astype(np.int16)
                new = np.flatnonzero((hits[i] >= self.needed) & (inner[i] == -np.inf))
                inner[i, new] = self.single[new] @ q[i]
                found = np.count_nonzero(inner[i] > -np.inf)
                if last[i] or found == n:
                    continue
                if found >= k:
                    kth = float(np.partition(inner[i], n - k)[n - k])
                    far = sqrt(max(0.0, 2 * self.top * self.top - 2 * self.top * kth / norm[i]))
                    if far <= radius[i]:
                        continue
                    radius[i], last[i] = far, True
                else:
                    radius[i] *= 2
                more.append(i)
            lo[live], hi[live] = left, right
            live = np.array(more, dtype=np.int64)
        kth = np.partition(inner, n - k, axis=1)[:, n - k]
        return [np.flatnonzero(x >= t - 1e-5 * self.top * r) for x, t, r in zip(inner, kth, norm)]


def nearest(embeddings: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets `queries`, its k nearest other rows by inner product in
    double precision, ties to the smaller vec_id.

    `embeddings` has vec_id and embedding; other columns are ignored. Rows that cannot be compared take no part
    (see fit_vectors), nor do rows without a vec_id. A query's own row is no candidate; of rows that share a vec_id
    one takes part, the smallest vector. No rows: no rows."""
    v = fit_vectors(embeddings).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    v = cut_lineage(v)
    top = v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()["m"]
    sharded, shards = spread(v, "vec_id", SHARD, "shard")
    asked, blocks = spread(v.where(queries), "vec_id", BLOCK, "block")
    top = sqrt(top) * (1 + 1e-12) if top else 1.0

    def pair(key: tuple, own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(q):
            own = own.sort_values("vec_id")
            ids, shard = own["vec_id"].to_numpy(), SortedProjections(stack(own["v"]), top)
            asked_ids, x = q["vec_id"].to_numpy(), stack(q["v"])
            for at in range(0, len(q), GROUP):
                found = shard.search(x[at:at + GROUP], k + 1)         # one more: the query itself may be among them
                for i, one, rows in zip(asked_ids[at:at + GROUP], x[at:at + GROUP], found):
                    score = np.einsum("ij,j->i", shard.v[rows], one)
                    best = [j for j in np.lexsort((ids[rows], -score)) if ids[rows[j]] != i][:k]
                    out["query_id"] += [i] * len(best)
                    out["vec_id"] += ids[rows[best]].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = sharded.select("vec_id", "v", "shard", every(blocks, "block"))
    right = asked.select("vec_id", "v", "block", every(shards, "shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(pair, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
