"""Prefix trie of conversations from a sorted array, its LCPs and range minima.

Every turn becomes a fixed-width entry (hash and word count), so a conversation is one binary key whose byte order
sorts by turns. Keys are sorted over range-partitioned blocks, ties by conv_id, and equal keys collapse to one row a
block. A block builds a sparse table of range minima over the LCPs of neighbouring keys; a prefix of d turns then finds
its first and last member by binary descents to the left and to the right, each on its own, and every figure of
the node is a difference of running sums over that interval. Nodes that reach over a block's edge leave as partial
sums under the hash of their prefix and are added up: at most two paths a block.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage, n_words

BLOCK, LEAST_BLOCK, CHUNK = 32_768, 512, 8192
ENTRY = 20          # bytes a turn: 16 of hash, 4 of word count
GROUP, HEADS = 20, 4    # conversations that share opening turns, and the range of the number of shared turns
NO_ENDS = hashlib.sha256(b"").hexdigest()
RUN = "block int, seq int, edge int, key binary, n long, low long, ends string, ids binary"
NODE = ("block int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends string, node binary, parent binary")


def rebuilt_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, key) of every rebuilt conversation. Its turns are ordered by turn, null first; rows that tie there
    are ordered by the hash of role and text. Rows without a conv_id take no part."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    entry = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(n_words(text)), 8, "0"))
    turns = (conversations.where("conv_id IS NOT NULL")
             .select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), "turn", entry.alias("entry")).alias("t")))
    own = cut_lineage(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.entry").alias("t")))
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first_id"), F.slice("t", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "first_id", "left").withColumn("h", h)
    shared = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.unhex(F.array_join(F.concat(shared, F.slice("t", F.col("h") + 1, F.size("t"))), "")).alias("key"))


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Collapses a sorted partition's equal keys. The ids of its first and last key, which neighbours may share, and of
    very long runs also leave as chunks of text."""
    block, seq, out = TaskContext.get().partitionId(), -1, []
    key, n, low, sha, chunk, first, spilled = None, 0, 0, hashlib.sha256(), [], 0, False

    def flush() -> None:
        out.append((block, seq, 0, key, 0, first, None, ",".join(map(str, chunk)).encode()))

    def close(last: bool) -> None:
        edge = (seq == 0) + 2 * last
        if chunk:
            sha.update((b"," if n > len(chunk) else b"") + ",".join(map(str, chunk)).encode())
        if chunk and (edge or spilled):
            flush()
        out.append((block, seq, edge, key, n, low, sha.hexdigest(), None))

    for b in batches:
        for c, k in zip(b["conv_id"].tolist(), b["key"].tolist()):
            if k != key:
                if key is not None:
                    close(False)
                key, n, low, sha, chunk, first, spilled, seq = k, 0, c, hashlib.sha256(), [], c, False, seq + 1
            if len(chunk) == CHUNK:
                sha.update((b"," if n > CHUNK else b"") + ",".join(map(str, chunk)).encode())
                flush()
                chunk, first, spilled = [], c, True
            chunk.append(c)
            n += 1
        if len(out) > 4000:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RUN.split(", ")])
            out = []
    if key is not None:
        close(True)
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RUN.split(", ")])


def joined_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the id chunks of a prefix, which arrive sorted; only the running hash is kept."""
    key, sha, out = None, None, []
    for b in batches:
        for k, ids in zip(b["key"].tolist(), b["ids"].tolist()):
            if k != key:
                if key is not None:
                    out.append((hashlib.blake2b(key, digest_size=16).digest(), sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids)
            else:
                sha.update(b"," + ids)
    if key is not None:
        out.append((hashlib.blake2b(key, digest_size=16).digest(), sha.hexdigest()))
    yield pd.DataFrame(out, columns=["node", "ends"])


def shared_turns(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shared leading turns of each key and the one before it, lengths in turns, first turns' places and word counts."""
    flat = np.frombuffer(b"".join(keys), dtype=">u4").reshape(-1, ENTRY // 4)
    length = np.array([len(k) // ENTRY for k in keys], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(length)])[:-1].astype(np.int64)
    lcp, at, t = np.zeros(len(keys), dtype=np.int64), np.arange(1, len(keys)), 0
    while len(at):
        at = at[(length[at - 1] > t) & (length[at] > t)]
        at = at[(flat[start[at - 1] + t] == flat[start[at] + t]).all(axis=1)]
        lcp[at] += 1
        t += 1
    return lcp, length, start, flat[:, ENTRY // 4 - 1].astype(np.int64)


class RangeMin:
    """Sparse table: level k holds the minimum of each window of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.m, levels = len(values), [values]
        while 2 << len(levels) - 1 <= self.m:
            half = 1 << len(levels) - 1
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        self.levels = levels

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum from a to b, both included."""
        k, out = np.frexp((b - a + 1).astype(np.float64))[1] - 1, np.empty(len(a), dtype=np.int64)
        for level in np.unique(k):
            s = k == level
            out[s] = np.minimum(self.levels[level][a[s]], self.levels[level][b[s] - (1 << level) + 1])
        return out

    def last(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest r for which the values after i, up to r, all reach `depth`."""
        r = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            s = np.flatnonzero(r + (1 << k) < self.m)
            s = s[self.levels[k][r[s] + 1] >= depth[s]]
            r[s] += 1 << k
        return r

    def first(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest l for which the values after l, up to i, all reach `depth`."""
        left = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            s = np.flatnonzero(left - (1 << k) >= 0)
            s = s[self.levels[k][left[s] - (1 << k) + 1] >= depth[s]]
            left[s] -= 1 << k
        return left


def prefix_ids(key: bytes, upto: int) -> list[bytes]:
    """Hashes of the prefixes of 0 to `upto` turns."""
    h, out = hashlib.blake2b(digest_size=16), []
    for d in range(upto + 1):
        out.append(h.copy().digest())
        h.update(key[d * ENTRY:(d + 1) * ENTRY])
    return out


def block_nodes(b: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one block: its distinct keys (edge 0 to 3) and the keys beside it (edge -1 before, -2 after)."""
    before, after = b.loc[b["edge"] == -1, "key"].tolist(), b.loc[b["edge"] == -2, "key"].tolist()
    b = b[b["edge"] >= 0].sort_values("seq")
    keys, m = b["key"].tolist(), len(b)
    lcp, length, start, words = shared_turns(keys)
    lcp[0] = shared_turns([before[0], keys[0]])[0][1] if before else -1
    lcp_after = int(shared_turns([keys[-1], after[0]])[0][1]) if after else -1
    next_lcp = np.append(lcp[1:], lcp_after)

    new_from = np.maximum(lcp + 1, 0)               # a key's own nodes start at this depth
    from_ = new_from.copy()
    from_[0] = 0                                    # the first key also stands for those that began in earlier blocks
    count = length - from_ + 1
    offset = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    i = np.repeat(np.arange(m), count)
    depth = np.arange(offset[-1]) - offset[i] + from_[i]
    own = depth >= new_from[i]

    table, lowest = RangeMin(lcp), RangeMin(b["low"].to_numpy(np.int64))
    r = table.last(i, depth)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64)
    upto = sums(words)
    total = upto[start + length] - upto[start]
    n = b["n"].to_numpy(np.int64)
    convs, said, leaves = sums(n), sums(n * total), sums(next_lcp < length)
    fresh = sums(total - (upto[start + np.maximum(lcp, 0)] - upto[start]))      # words of the nodes that start at each key
    above = upto[start[i] + np.maximum(depth - 1, 0)] - upto[start[i]]          # words of the turns before the last
    first_fresh = total[i] - (upto[start[i] + np.maximum(np.maximum(lcp[i], depth - 1), 0)] - upto[start[i]])
    n_convs = convs[r + 1] - convs[i]
    saved = said[r + 1] - said[i] - n_convs * above - (fresh[r + 1] - fresh[i + 1]) - first_fresh

    # the parent starts at the same key, or at the left end of the interval one turn above
    up = np.maximum(depth - 1, 0)
    at = i.copy()
    look = np.flatnonzero((up < from_[i]) & (depth > 0))
    at[look] = table.first(i[look], up[look])
    parent = np.where(depth > 0, offset[at] + up - from_[at], -1)
    children = np.bincount(parent[own & (depth > 0)], minlength=len(i))

    left, right = (i == 0) & (depth <= lcp[0]), (r == m - 1) & (depth <= lcp_after)
    node = np.full(len(i), None, dtype=object)
    for mask, key, most in ((left, keys[0], lcp[0]), (right, keys[-1], lcp_after)):
        if mask.any():
            ids = prefix_ids(key, int(most))
            node[mask] = [ids[d] for d in depth[mask]]
    low = lowest.between(i, r)
    known = parent >= 0
    parent_low, parent_node = np.full(len(i), None, dtype=object), np.full(len(i), None, dtype=object)
    parent_node[known] = node[parent[known]]
    closed = known & np.array([x is None for x in parent_node])
    parent_low[closed] = low[parent[closed]]
    ends = np.where(depth == length[i], b["ends"].to_numpy(object)[i], None)
    return pd.DataFrame({"block": int(b["block"].iloc[0]), "conv_id": low, "depth": depth, "parent_conv_id": pd.array(parent_low, dtype="Int64"), "n_convs": n_convs,
                         "n_children": children, "n_leaves": leaves[r + 1] - leaves[i], "saved_tokens": saved, "ends": ends, "node": node, "parent": parent_node})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Reads conv_id, turn, role and text; other columns, whatever their names, are ignored. Null role or text is empty,
    a null turn comes first, equal turns of a conversation stand in the order of their hashes and repeated rows are turns
    of their own. Rows without a conv_id take no part. No conversation, no node. One conversation's turns (20 bytes
    each) and one block's keys are held in a task; copies of one conversation are spread by conv_id, and their joint digest
    reads its ids as a stream of chunks."""
    keys = rebuilt_keys(conversations)
    spark = keys.sparkSession
    keys = cut_lineage(keys)
    total = keys.count()
    n = max(1, -(-total // BLOCK), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_BLOCK)))
    table = cut_lineage(keys.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(runs, RUN))
    rows = table.where("ids IS NULL").drop("ids")
    order = Window.orderBy("block", "seq")      # two rows a block
    edges = rows.where("edge > 0").select("block", "edge", F.lag("key").over(order).alias("before"), F.lead("key").over(order).alias("after"))
    beside = edges.select("block", F.explode(F.array(
        F.struct(F.lit(-1).alias("edge"), F.when(F.col("edge") % 2 == 1, F.col("before")).alias("key")),
        F.struct(F.lit(-2).alias("edge"), F.when(F.col("edge") >= 2, F.col("after")).alias("key")))).alias("x")).select("block", "x.*").where("key IS NOT NULL")
    given = rows.unionByName(beside, allowMissingColumns=True)
    nodes = cut_lineage(given.groupBy("block").applyInPandas(block_nodes, NODE))

    part = nodes.where("node IS NOT NULL")
    added = part.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                                     F.max("ends").alias("own_ends"), F.max("parent").alias("parent"))
    digests = (table.where("ids IS NOT NULL").repartition("key").sortWithinPartitions("key", "low").select("key", "ids")
               .mapInPandas(joined_digests, "node binary, ends string"))
    added = cut_lineage(added.join(digests, "node", "left").withColumn("ends", F.coalesce("ends", "own_ends")).drop("own_ends"))
    lows = added.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_low"))
    in_block = part.select("block", F.col("node").alias("parent")).distinct().join(lows, "parent")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    whole = nodes.where("node IS NULL AND parent IS NULL").select(*out)
    under = nodes.where("node IS NULL AND parent IS NOT NULL").drop("parent_conv_id").join(in_block, ["block", "parent"]).withColumnRenamed("parent_low", "parent_conv_id").select(*out)
    across = added.join(lows, "parent", "left").withColumnRenamed("parent_low", "parent_conv_id").select(*out)
    return whole.unionByName(under).unionByName(across).select(*out[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
