"""Packing by optimal length buckets.

The global histogram of sequence lengths, of a size bounded by the longest sequence allowed, goes to the driver.
Dynamic programming finds the bucket lengths that give the least padding when each sequence is padded to its
bucket's length. Inside each bucket, sequences in doc_id order fill batches of a token budget.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage, n_words, ranked_in_chunks

MAX_LENGTH, BUCKETS, BATCH_TOKENS = 4096, 8, 32_768
CHUNK_ROWS, MOST_CHUNKS = 256, 65_536


def best_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, rising, of the least total padding; as few and as short as reach it.

    cost[j]: least padded tokens of the first j distinct lengths; each round adds one bucket."""
    n = len(lengths)
    if n == 0:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    cost = np.full(n + 1, np.iinfo(np.int64).max // 2)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, cut = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            all_i = cost[:j] + (below[j] - below[:j]) * int(lengths[j - 1])
            i = int(np.argmin(all_i))
            if all_i[i] < new[j]:
                new[j], cut[j] = all_i[i], i
        back.append(cut)
        cost = new
    out, j = [], n
    for cut in reversed(back):
        if cut[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per sequence of `docs` (doc_id, text; other columns are ignored): doc_id, part, start, length, bucket
    (from 1), bucket_length, batch (from 0 in its bucket) and slot in the batch.

    A token is a word. A document longer than `max_length` goes on in further parts, nothing is cut off; null and empty
    texts have one sequence of length 0, which takes no room of its own. A batch holds batch_tokens / bucket_length
    sequences, one at least. Rows that share a doc_id are packed each. No documents: no rows."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text").cast("string")).alias("size"))
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / max_length)).cast("int")
    parts = cut_lineage(
        sized.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
        .select("doc_id", "row", F.col("part").cast("long").alias("part"), (F.col("part").cast("long") * max_length).alias("start"),
                F.least(F.lit(max_length), F.col("size") - F.col("part") * max_length).cast("long").alias("length")))
    hist = parts.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()      # max_length + 1 rows at most
    bounds = best_buckets(hist["length"].to_numpy(), hist["n"].to_numpy(), buckets)
    if not bounds:
        bounds = [0]
    number = F.lit(1) + sum((F.col("length") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(1)
    placed = parts.withColumn("bucket", number.cast("long"))
    placed = placed.withColumn("bucket_length", F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket").cast("int")))
    rows, span = int(hist["n"].sum()), parts.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = span.lo or 0, span.hi or 0
    chunks = max(1, min(MOST_CHUNKS, rows // CHUNK_ROWS))
    chunk = F.coalesce(F.floor((F.col("doc_id").cast("double") - lo) / (float(hi - lo) + 1.0) * chunks), F.lit(-1))
    ranked = ranked_in_chunks(placed, ["bucket"], chunk, [F.col(c) for c in ("doc_id", "part", "length", "row")], F.lit(1), "rank")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("bucket_length"))))
    return ranked.select("doc_id", "part", "start", "length", "bucket", "bucket_length", F.floor(F.col("rank") / room).alias("batch"),
                         (F.col("rank") % room).alias("slot"))
