"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r, each bit position gets a nonzero vector of r + 1 bits, and for each
nonzero vector v of r + 1 bits a table masks the fingerprints to the positions whose vector has an odd product
with v. The vectors of r differing positions cannot span r + 1 dimensions, so some v is orthogonal to all of
them, and in its table the pair is equal: every pair within the radius meets in at least one of the 2^(r+1) - 1
tables. Candidates are verified, so the links are exact.

Equal fingerprints collapse to one before anything is paired. A bucket with very many different fingerprints is
covered once more over the bits that its table leaves free; after three levels a bucket holds a few hundred
fingerprints at most. Inside a bucket only a spanning forest of the verified links goes on, never all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage
from slatemill.llm.components import components, lowest

BITS, SHINGLE, SEED = 64, 4, 42
BLOCK = 65_536          # shingles hashed at a time
SPLIT_ABOVE = 256       # fingerprints in a bucket before it is covered again
STEP = 4096             # fingerprints put into tables at a time


def fingerprint(raw: bytes | None) -> np.uint64:
    """Bitwise majority over the hashes of all shingles of a text given as UTF-8; zero where there is none."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.uint64(0)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_digest
    for at in range(0, len(first), BLOCK):
        h = b"".join([digest(text[s:e], SEED) for s, e in zip(first[at:at + BLOCK], last[at:at + BLOCK])])
        ones += np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(first)).view(">u8")[0].astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long, written to the shared folder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"),
                                "fp": np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return cut_lineage(d.mapInPandas(run, "doc_id long, fp long"))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; any `radius` of these positions are all absent from some mask."""
    top = 1 << (radius + 1)
    vector = {p: 1 + i % (top - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _buckets(members: DataFrame, radius: int) -> DataFrame:
    """One row per (member, table): `fixed` are the bits that the members of a bucket share so far."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[int, list[int]] = {}
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b = whole.iloc[at:at + STEP]
                for f in set(b["fixed"]).difference(tables):
                    own = f % (1 << BITS)
                    tables[f] = [m | own for m in covering_masks([p for p in range(BITS) if not own >> p & 1], radius)]
                masks = np.array([tables[f] for f in b["fixed"]], dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"fp": np.repeat(b["fp"].to_numpy(), masks.shape[1]), "up": np.repeat(b["key"].to_numpy(), masks.shape[1]),
                                    "fixed": masks.reshape(-1)})

    rows = members.select("fp", "key", "fixed").mapInPandas(run, "fp long, up long, fixed long")
    shared = F.col("fp").bitwiseAND(F.col("fixed"))
    return rows.select("fp", "fixed", F.xxhash64("up", "fixed", shared).alias("key"))


def _links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Verified links of buckets that come one after another, as a forest; a bucket may go over a batch's end."""
    held = None
    def out(b: pd.DataFrame) -> pd.DataFrame:
        fp, key = b["fp"].to_numpy(np.int64).view(np.uint64), b["key"].to_numpy(np.int64)
        a, c, at = [], [], np.arange(len(b))
        for d in range(1, len(b)):
            at = at[at < len(b) - d]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
            a.append(hit)
            c.append(hit + d)
        a, c = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, c))
        low = lowest(len(b), a, c)
        own = np.flatnonzero(low != np.arange(len(b)))
        return pd.DataFrame({"a": fp[own].view(np.int64), "b": fp[low[own]].view(np.int64)})

    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        last = b["key"].to_numpy() == b["key"].iloc[-1] if len(b) else np.zeros(0, dtype=bool)
        held = b[last]
        if not last.all():
            yield out(b[~last].reset_index(drop=True))
    if held is not None and len(held):
        yield out(held.reset_index(drop=True))


def near_links(fps: DataFrame, radius: int, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints `fp` linked by chains of steps within `radius`."""
    full = _signed((1 << BITS) - 1)
    members = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("fixed"))
    edges = None
    while True:
        rows = cut_lineage(_buckets(members, radius))
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("fixed").alias("f")).where("n > 1")
        crowded = cut_lineage(rows.join(sizes.select("key", "n"), "key"))
        large = (F.col("n") > split_above) & (F.col("fixed") != full) & (F.bit_count("fixed") < BITS - 8)
        small = crowded.where(~large).select("fp", "key")
        found = (small.repartition("key").sortWithinPartitions("key", "fp")
                 .mapInPandas(lambda it: _links(it, radius), "a long, b long"))
        edges = found if edges is None else edges.union(found)
        members = crowded.where(large).select("fp", "key", "fixed")
        if members.isEmpty():
            return edges


def simhash_components(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, fingerprint (16 hex digits)
    and component_id, the smallest doc_id that links reach, itself included.

    Null, empty and white-space texts have fingerprint zero and link like any other. Rows that share a doc_id
    keep rows of their own. A null doc_id is never a component_id; a component of such rows alone has null."""
    of = fingerprints(docs)
    reps = of.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = cut_lineage(reps)
    roots = components(near_links(reps, radius))
    named = cut_lineage(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    ids = cut_lineage(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    classes = cut_lineage(named.join(ids, "root").select("fp", "component_id"))
    return of.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4) -> DataFrame:
    """Rows of `docs` less near copies: of each component one row stays, that of the smallest doc_id, the first of
    them where several share it. Rows are told apart by a number of their own, so different texts under one doc_id
    each count. A row without a doc_id cannot be named as the one to stay, so it always stays."""
    numbered = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = simhash_components(numbered.select(F.col("_row").alias("doc_id"), "text"), radius)
    named = groups.select(F.col("doc_id").alias("_row"), "component_id").join(numbered.where("doc_id IS NOT NULL").select("_row", "doc_id"), "_row")
    stay = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first._row")
    return numbered.join(cut_lineage(stay), "_row", "left_semi").unionByName(numbered.where("doc_id IS NULL")).select(docs.columns)
