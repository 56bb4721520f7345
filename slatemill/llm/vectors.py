"""Embedding rows fit for search, and their spread over shards and blocks."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage


def fit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that can be compared, written to the shared folder. Null and zero
    vectors, null or non-finite components and vectors of another length than the commonest take no part."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = e.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1)
    dim = sizes.first()
    return cut_lineage(good.where(F.size("v") == (dim["n"] if dim else 0)))


def stack(v: pd.Series) -> np.ndarray:
    return np.vstack(v.tolist()).astype(np.float64)


def spread(df: DataFrame, key: str, per: int, name: str) -> tuple[DataFrame, int]:
    """Adds `name`, a hashed shard number with about `per` rows a shard, and gives the number of shards."""
    n = max(1, -(-df.count() // per))
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(name), key), F.lit(n)).cast("int")), n
