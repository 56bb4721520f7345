"""Hard negatives by exact integer scores from residue-number-system matrix products.

Components become integers. Modulo a small prime their products add up below 2^24 over a slice of columns, so a
float32 matrix product is exact; the scores' residues for several primes give the signed score by Chinese
remaindering (mixed radix with centred digits). As many primes are taken as the largest norm asks for.

Every shard of candidates sits in one partition, sorted by vec_id, and the anchors stream past it. A first pass finds
the positives of each anchor over all shards, a second one the best negatives inside each positive's window of scores.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage

SHARD, LEAST_SHARD, SUB = 65_536, 1024, 64      # candidate rows of a shard, anchors multiplied at a time
SLICE = 64                                      # columns whose products stay below 2^24
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LEAST = np.iinfo(np.int64).min
FOUND = "anchor_row long, slot int, found_row long, found_id long, score long"


def moduli(bound: int) -> list[int]:
    """Falling primes whose product exceeds 2 * bound; SLICE products of centred residues stay within 2^24."""
    out, product, p = [], 1, 2 * int(np.sqrt(2 ** 24 / SLICE)) + 1
    while product <= 2 * bound + 1 or len(out) < 2:
        if all(p % q for q in range(2, int(p ** 0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residues of integers modulo an odd p, from -(p-1)/2 to (p-1)/2."""
    r = x % p
    return r - p * (r > p // 2)


class ResidueScores:
    """Residue matrices of one shard's integer vectors."""

    def __init__(self, v: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [np.ascontiguousarray(centred(v, p).T.astype(np.float32)) for p in primes]

    def residues(self, anchors: np.ndarray, j: int) -> np.ndarray:
        p, a = self.primes[j], centred(anchors, self.primes[j]).astype(np.float32)
        total = np.zeros((len(a), self.parts[j].shape[1]), dtype=np.float32)
        for k in range(0, a.shape[1], SLICE):
            g = a[:, k:k + SLICE] @ self.parts[j][k:k + SLICE]
            total += g - p * np.rint(g / p)         # congruent and small, so the sum of all slices is exact too
        return total.astype(np.int64)

    def score(self, anchors: np.ndarray) -> np.ndarray:
        """Exact signed inner products, (anchors x rows) as int64."""
        value = centred(self.residues(anchors, 0), self.primes[0])
        product = self.primes[0]
        for j, p in enumerate(self.primes[1:], 1):
            digit = centred((self.residues(anchors, j) - value % p) * pow(product, -1, p), p)
            value, product = value + digit * np.int64(product), product * p
        return value


def best(s: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest fitting scores, largest first, ties by column."""
    s = np.where(fit, s, LEAST)
    floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), LEAST)
    q, c = np.nonzero(s >= np.maximum(floor, LEAST + 1)[:, None])
    order = np.lexsort((c, -s[q, c], q))
    q, c = q[order], c[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep]


class Part:
    """Columns of some rows of a batch as arrays."""

    def __init__(self, t: pa.RecordBatch | pa.Table, dim: int):
        get = lambda c: t.column(c).to_numpy() if isinstance(t, pa.Table) else t.column(c).to_numpy(zero_copy_only=False)
        self.row, self.vec_id, self.label = get("row"), get("vec_id"), get("label")
        chunks = t.column("v").chunks if isinstance(t, pa.Table) else [t.column("v")]
        flat = [c.flatten().to_numpy() for c in chunks]
        self.v = (np.concatenate(flat) if flat else np.zeros(0)).reshape(-1, dim).astype(np.int64)
        self.scores = t.column("scores").to_pylist()


def positives(shard: Part, a: Part, s: np.ndarray) -> Iterator[tuple]:
    q, c = best(s, (a.label[:, None] == shard.label) & (a.row[:, None] != shard.row), POSITIVES)
    yield a.row[q], np.zeros(len(q), dtype=np.int32), shard.row[c], shard.vec_id[c], s[q, c]


def negatives(shard: Part, a: Part, s: np.ndarray) -> Iterator[tuple]:
    other = a.label[:, None] != shard.label
    for slot in range(max(map(len, a.scores), default=0)):
        has = np.array([i for i, x in enumerate(a.scores) if len(x) > slot])
        p = np.array([a.scores[i][slot] for i in has], dtype=np.int64)
        low, high = -(-p // 2), p + (-p // 20)      # 50 p <= 100 n <= 95 p in whole numbers
        t = s[has]
        q, c = best(t, other[has] & (t >= low[:, None]) & (t <= high[:, None]), NEGATIVES)
        yield a.row[has[q]], np.full(len(q), slot, dtype=np.int32), shard.row[c], shard.vec_id[c], t[q, c]


def streamed(pick: Callable[[Part, Part, np.ndarray], Iterator[tuple]], primes: list[int], dim: int):
    """For mapInArrow: the partition's candidates come first, then the anchors, batch by batch."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, products = [], None, None
        for b in batches:
            n = int(np.count_nonzero(b.column("is_anchor").to_numpy(zero_copy_only=False) == 0))
            if n:
                held.append(b.slice(0, n))
            if n == b.num_rows or not held:
                continue
            if shard is None:
                shard = Part(pa.Table.from_batches(held), dim)
                products = ResidueScores(shard.v, primes)
            rest = b.slice(n)
            for k in range(0, rest.num_rows, SUB):
                a = Part(rest.slice(k, SUB), dim)
                for found in pick(shard, a, products.score(a.v)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return run


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, v array<int>, norm) of the rows that take part, written to the shared folder."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    good = e.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = good.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x * SCALE) + 1) * (F.abs(x * SCALE) + 1)))
    dim = good.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).first()
    return cut_lineage(size.where((F.size("x") == (dim["n"] if dim else 0)) & (F.col("norm") < 2.0 ** 62))
                       .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
                               F.transform("x", lambda x: F.floor(x * SCALE).cast("int")).alias("v"), "norm"))


def hard_negatives(embeddings: DataFrame, is_anchor: Column) -> DataFrame:
    """Windowed hard negatives of the anchors among all rows: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    Reads vec_id, embedding and label; other columns are ignored. Rows with a null vec_id, label, vector or component or
    a component that is not finite take no part, nor do vectors of another length than the commonest and those whose squared
    norm passes 2^62, whose scores no long could hold. Rows that share a vec_id stay rows of their own. Equal scores
    are ordered by vec_id. No anchor or no rows, no result."""
    e = integer_vectors(embeddings)
    spark = e.sparkSession
    total = e.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.size("v")).alias("dim")).first()
    dim, primes = total["dim"] or 0, moduli(int(total["norm"] or 1))
    n = max(1, -(-total["n"] // SHARD), min(spark.sparkContext.defaultParallelism, -(-total["n"] // LEAST_SHARD)))
    none = F.array().cast("array<long>").alias("scores")
    held = e.select(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("is_anchor"), "row", "vec_id", "label", "v", none)
    anchors = e.where(is_anchor).select("row", "vec_id", "label", "v")

    def against_all(a: DataFrame, pick: Callable) -> DataFrame:
        every = a.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.lit(1).alias("is_anchor"), "row", "vec_id", "label", "v", "scores")
        return (held.unionByName(every).repartitionById(n, F.col("shard")).sortWithinPartitions("is_anchor", "vec_id", "row")
                .mapInArrow(streamed(pick, primes, dim), FOUND))

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "found_id", "found_row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = cut_lineage(ranked(against_all(anchors.withColumn("scores", none), positives), POSITIVES)
                       .select(F.col("anchor_row").alias("row"), (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("s")).select("row", F.col("s.positive_score").alias("scores"))
    found = ranked(against_all(anchors.join(wanted, "row"), negatives), NEGATIVES).withColumnRenamed("anchor_row", "row")
    return (found.join(near, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
