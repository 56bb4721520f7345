"""Stupid-backoff language-model scores from the corpus itself, each document scored by all others.

Blocks of about 4 MB of text explode their n-grams to 64-bit hashes with counts, already summed within the block.
The count table is partitioned by hash bucket; a bucket adds up each hash over all blocks and answers every block with the
counts elsewhere, in the block's own order, so no hash travels back. There they join the block's exploded n-grams, and scores
are summed a document. No n-gram has more rows than there are blocks, so frequent words make no large key.

With c the count in all other documents, the score of a word after its history is c(history, word) / c(history)
where the n-gram occurs elsewhere, and otherwise `backoff` times the score after the history less its first word; a
single word has c(word) / N, and one that occurs nowhere else `backoff` / (N + 1).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import n_words

BLOCK_BYTES, MOST_BUCKETS = 4 << 20, 1 << 20
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def gram_hashes(texts: list[bytes | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words per text; for k = 1 .. order the hash of the k-gram that ends at each word; each word's place in its text.
    Where a text has too few words before, the hash is of no meaning and `place` tells."""
    split = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    known = {w: xxhash.xxh64_intdigest(w) for words in split for w in set(words)}
    first = np.fromiter((known[w] for words in split for w in words), dtype=np.uint64, count=int(sizes.sum()))
    place = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [_mixed(first + np.uint64(1))]
    for k in range(2, order + 1):
        before = np.concatenate([out[-1][:1], out[-1][:-1]]) if len(first) else out[-1]
        out.append(_mixed(before * np.uint64(31) + first + np.uint64(k)))
    return sizes, out, place


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes of the narrowest width that holds them all."""
    most = int(counts.max(initial=0))
    return counts.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64)


def _distinct(grams: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([g[place >= k] for k, g in enumerate(grams)]), return_counts=True)


def backoff_scores(docs: DataFrame, order: int = 2, backoff: float = 0.4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_words, log_score (the sum over its words of
    the natural log), mean_log_score (0 without words) and backed_off, the words scored below the full order.

    Words are as in n_words, A-Z lower-cased. Null and empty texts have no words and score 0. Rows that share a
    doc_id are documents of their own, so a repeated text is known from its copies. No documents: no rows."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = d.agg(F.sum(n_words(F.col("text"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    words = total["words"] or 0
    blocks = max(1, -(-((total["bytes"] or 0) + 16 * total["rows"]) // block_bytes))
    buckets = min(MOST_BUCKETS, max(16, 2 * blocks))
    blocked = d.select("doc_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def explode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, grams, place = gram_hashes(rows["text"].tolist(), order)
        h, n = _distinct(grams, place)
        at = np.searchsorted(h, np.arange(buckets, dtype=np.float64) * (2.0 ** 64 / buckets)) if len(h) else np.zeros(buckets, dtype=np.int64)
        at = np.append(at, len(h))
        some = np.flatnonzero(np.diff(at))
        return pd.DataFrame({"block": np.full(len(some), key[0], dtype=np.int64), "bucket": some,
                             "hash": [h[at[i]:at[i + 1]].tobytes() for i in some],
                             "n": [_small(n[at[i]:at[i + 1]]) for i in some]})

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["hash"].map(len).to_numpy() // 8
        n = np.concatenate([_wide(raw, k) for raw, k in zip(rows["n"], sizes)])
        _, at = np.unique(np.frombuffer(b"".join(rows["hash"]), dtype=np.uint64), return_inverse=True)
        other = np.bincount(at, weights=n).astype(np.int64)[at] - n
        ends = np.cumsum(sizes)
        return pd.DataFrame({"block": rows["block"], "bucket": key[0], "size": sizes, "other": [_small(other[e - k:e]) for k, e in zip(sizes, ends)]})

    packed = blocked.groupBy("block").applyInPandas(explode, "block long, bucket long, hash binary, n binary")
    counted = packed.groupBy("bucket").applyInPandas(add_up, "block long, bucket long, size long, other binary")

    def score(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        sizes, grams, place = gram_hashes(rows["text"].tolist(), order)
        h, total_of = _distinct(grams, place)
        if len(h):
            known = known.sort_values("bucket")
            total_of = total_of + np.concatenate([_wide(raw, k) for raw, k in zip(known["other"], known["size"])])      # buckets are ranges of h
        doc = np.repeat(np.arange(len(sizes)), sizes)
        others = words - sizes[doc]
        elsewhere = []
        for k, g in enumerate(grams):
            at = np.searchsorted(h, g) if len(h) else np.zeros(0, dtype=np.int64)
            at = np.minimum(at, max(0, len(h) - 1))
            pair = doc * np.int64(len(h) + 1) + np.where(place >= k, at, len(h))
            _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
            elsewhere.append(np.where(place >= k, total_of[at] - own[inverse], 0) if len(g) else np.zeros(0, dtype=np.int64))
        value = np.where(elsewhere[0] > 0, elsewhere[0] / np.maximum(others, 1), backoff / (others + 1.0)) if len(doc) else np.zeros(0)
        deepest = np.zeros(len(doc), dtype=bool) if order > 1 else elsewhere[0] > 0
        for k in range(1, order):
            history = np.concatenate([[0], elsewhere[k - 1][:-1]]) if len(doc) else elsewhere[k - 1]
            seen = elsewhere[k] > 0
            value = np.where(place >= k, np.where(seen, elsewhere[k] / np.maximum(history, 1), backoff * value), value)
            deepest = seen
        logs = np.bincount(doc, weights=np.log(value), minlength=len(sizes)) if len(doc) else np.zeros(len(sizes))
        short = np.bincount(doc, weights=~deepest, minlength=len(sizes)) if len(doc) else np.zeros(len(sizes))
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_words": sizes, "log_score": logs,
                             "mean_log_score": logs / np.maximum(sizes, 1), "backed_off": short.astype(np.int64)})

    return blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(
        score, "doc_id long, n_words long, log_score double, mean_log_score double, backed_off long")
