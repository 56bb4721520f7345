"""Small helpers that several corpus operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatemill.session import cut_lineage, shared_folder  # noqa: F401

#: One word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; one JVM regular expression over the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_in_chunks(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], size: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `size` over the rows of the same keys that come earlier by (chunk, order).

    `chunk` must never decrease along the order. Only one row per (keys, chunk) is combined across a key, so
    a key with a third of all rows is spread over as many tasks as it has chunks. Null keys form a key."""
    d = df.withColumn("_chunk", chunk).withColumn("_size", size)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (d.groupBy(*keys, "_chunk").agg(F.sum("_size").alias("_t"))
            .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"),
                    F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base")))
    local = d.withColumn("_local", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    on = F.col("_chunk").eqNullSafe(F.col("_kc"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (local.join(base, on).withColumn(name, F.col("_base") + F.col("_local"))
            .drop("_chunk", "_kc", "_size", "_base", "_local", *[f"_k{i}" for i in range(len(keys))]))
