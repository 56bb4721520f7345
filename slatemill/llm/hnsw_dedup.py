"""Embedding near-duplicates: hierarchical small-world graphs per shard, audited beams, verified cosine, components.

Equal vectors collapse to one with a count. Hashed shards build one graph each. The vectors of a shard search their own
graph and those of all shards before it, so each pair of shards meets once and a link counts for both ends. Beams start
narrow and widen until two audits pass: probes, made at a cosine just above the threshold from some of the
shard's nodes, must find their nodes, which is evidence where links are rare; and some of the queries must find all
their true links. A beam that ends full of links widens to the whole shard, as all do if the audits never pass.
Candidates are verified in double precision. A task returns counts a vector and a spanning forest of its links,
never all pairs.
"""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage
from slatemill.llm.components import components, lowest
from slatemill.llm.hnsw import SmallWorld
from slatemill.llm.vectors import fit_vectors, spread, stack

SHARD, BLOCK, GROUP = 16_384, 4096, 256     # vectors of a shard, queries audited at a time, queries searched at a time
WIDTH, AUDITED, SLACK = 24, 256, 1e-4
PROBES, BAND, RECALL = 512, 0.02, 0.995     # probes of a shard, how far above the threshold they lie, the share that must find their nodes


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cid").sample(frac=1, random_state=1)
    v = unit(stack(rows["v"]))
    raw = packed({"cid": rows["cid"].to_numpy(), "copies": rows["copies"].to_numpy(), "v": v, **SmallWorld(v).arrays()})
    return pd.DataFrame({"shard": [key[0]], "graph": [raw]})


def probed_width(graph: SmallWorld, v: np.ndarray, above: float, width: int) -> int:
    """The least width, doubling from `width`, at which probes find the nodes they were made from; the size of the
    shard if that takes half of it."""
    if v.shape[1] < 2 or 2 * width >= len(v):
        return len(v)
    node = np.unique(np.linspace(0, len(v) - 1, min(PROBES, len(v))).astype(np.int64))
    rnd = np.random.default_rng(5)
    side = rnd.normal(size=(len(node), v.shape[1]))
    side = unit(side - np.einsum("ij,ij->i", side, v[node])[:, None] * v[node])
    near = rnd.uniform(above, min(above + BAND, 1.0), len(node))[:, None]
    q = near * v[node] + np.sqrt(1 - near ** 2) * side
    while 2 * width < len(v):
        a, b, full = graph.within(q, above - SLACK, width)
        found = full.copy()                 # a full beam is searched again in the whole shard
        found[a[b == node[a]]] = True
        if found.mean() >= RECALL:
            return width
        width *= 2
    return len(v)


def linked(graph: SmallWorld, v: np.ndarray, q: np.ndarray, above: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified (query, node) pairs for groups of queries, `above` being the least cosine."""
    def exact(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.nonzero(q[rows] @ v.T >= above)
        return rows[a], b

    def once(rows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, full = graph.within(q[rows], above - SLACK, w)
        more = exact(rows[full])
        good = ~full[a]
        a, b = rows[a[good]], b[good]
        ok = np.einsum("ij,ij->i", q[a], v[b]) >= above
        return np.concatenate([a[ok], more[0]]), np.concatenate([b[ok], more[1]])

    width = probed_width(graph, v, above, width)
    for start in range(0, len(q), BLOCK):
        block, w = np.arange(start, min(len(q), start + BLOCK)), width
        sample = block[np.unique(np.linspace(0, len(block) - 1, min(AUDITED, len(block))).astype(np.int64))]
        truth = len(exact(sample)[0])
        while 2 * w < len(v) and len(once(sample, w)[0]) < truth:
            w *= 2
        for at in range(0, len(block), GROUP):
            rows = block[at:at + GROUP]
            yield exact(rows) if 2 * w >= len(v) else once(rows, w)


def cosine_groups(embeddings: DataFrame, above: float = 0.9) -> DataFrame:
    """One row per row of `embeddings` (vec_id, embedding; other columns are ignored): vec_id, n_links, component_id, kept.

    Rows that cannot be compared (see fit_vectors) link with nothing and stay by themselves. Rows that share a vec_id are
    vectors of their own. A null vec_id links like any other but is never a component_id, and such a row is
    kept only if its whole component has none."""
    rows = fit_vectors(embeddings)
    classes = cut_lineage(rows.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
                          .withColumn("cid", F.monotonically_increasing_id()))
    sharded, shards = spread(classes.select("cid", "copies", "v"), "cid", SHARD, "shard")
    graphs = cut_lineage(sharded.groupBy("shard").applyInPandas(build, "shard int, graph binary"))

    def pair(key: tuple, graph: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, n): n links of a, or an edge between a and b."""
        out = [pd.DataFrame({"a": [], "b": [], "n": []}).astype("Int64")]
        if len(graph) and len(q):
            z, same = unpacked(graph["graph"].iloc[0]), bool((q["home"] == key[0]).all())
            g, v, ids, copies = SmallWorld.of(z["v"], {k: x for k, x in z.items() if k not in ("v", "cid", "copies")}), z["v"], z["cid"], z["copies"]
            q = q.sort_values("cid")
            qid, qcopies = q["cid"].to_numpy(), q["copies"].to_numpy()
            mine, theirs = np.zeros(len(q), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
            edges = []
            for a, b in linked(g, v, unit(stack(q["v"])), above, WIDTH):
                other = qid[a] != ids[b]
                a, b = a[other], b[other]
                mine += np.bincount(a, weights=copies[b], minlength=len(q)).astype(np.int64)
                if not same:
                    theirs += np.bincount(b, weights=qcopies[a], minlength=len(v)).astype(np.int64)
                nodes, at = np.unique(np.concatenate([qid[a], ids[b]]), return_inverse=True)
                low = lowest(len(nodes), at[:len(a)], at[len(a):])
                own = np.flatnonzero(low != np.arange(len(nodes)))
                edges.append(pd.DataFrame({"a": nodes[own], "b": nodes[low[own]], "n": 0}).astype("Int64"))
            for i, n in ((qid, mine), (ids, theirs)):
                out.append(pd.DataFrame({"a": i[n > 0], "b": None, "n": n[n > 0]}).astype("Int64"))
            out += edges
        return pd.concat(out, ignore_index=True)

    ask = sharded.select("cid", "copies", "v", F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("shard"))
    at = graphs.select("shard", "graph", F.explode(F.sequence(F.col("shard"), F.lit(shards - 1))).alias("home"))
    keys = ["shard", "home"]
    found = cut_lineage(at.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(pair, "a long, b long, n long"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    named = cut_lineage(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
                        .select("v", "copies", "rep", F.coalesce("root", "cid").alias("root"), F.coalesce("n", F.lit(0)).alias("n")))
    ids = cut_lineage(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    of = cut_lineage(named.join(ids, "root").select("v", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id"))
    linked_rows = rows.join(of, "v").select("vec_id", "n_links", "component_id")
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    alone = _unfit(e, rows).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unfit(e: DataFrame, fit: DataFrame) -> DataFrame:
    """The rows that fit_vectors leaves out."""
    some = fit.select(F.size("v").alias("n")).first()
    good = (F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x.isNotNull() & (x != 0))
            & (F.size("v") == F.lit(some["n"] if some else -1)))
    return e.where(~F.coalesce(good, F.lit(False)))
