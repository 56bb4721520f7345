"""Connected components as joins and aggregates over an edge table."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage
from slatemill.session import release


def lowest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in each index's component, for edges between indices a and b."""
    low = np.arange(nodes)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the edges (a, b) of each batch by as many as its nodes at most, keeping what is connected."""
    for e in batches:
        values, at = np.unique(np.concatenate([e["a"].to_numpy(np.int64), e["b"].to_numpy(np.int64)]), return_inverse=True)
        low = lowest(len(values), at[:len(e)], at[len(e):])
        own = np.arange(len(values))
        yield pd.DataFrame({"a": values[own != low], "b": values[low[own != low]]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); root is the smallest node of its component.

    Each batch of edges first shrinks to a forest. Then every round takes the smallest label among a node's
    neighbours and follows labels to their own label, so long chains shrink fast. Rounds are written to the
    shared folder, and both sides of each join come from such tables: a node with very many edges is a skewed
    join that adaptive execution splits."""
    e = edges.where("a <> b").mapInPandas(forest, "a long, b long").dropDuplicates()
    both = cut_lineage(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
                         .select("node", F.least("node", "root").alias("root")))
    held = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = cut_lineage(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next")))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        new = cut_lineage(step.join(up, "next").select("node", F.col("root").alias("old"), F.col("up").alias("root")))
        done = new.where("old <> root").isEmpty()
        release(step, held)
        labels, held = new.select("node", "root"), new
        if done:
            release(both)
            return labels
