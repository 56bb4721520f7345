"""Append-only ledger with de-duplication, and season-wise refresh of a feature table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatemill.operators.metrics import fingerprint


def new_rows(picks: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Picks whose key is not recorded yet, each key once."""
    return picks.dropDuplicates(keys).join(ledger.select(*keys).distinct(), keys, "left_anti")


def append_ledger(spark: SparkSession, picks: DataFrame, path: str, keys: list[str], run: str) -> None:
    """Append only keys that no other run has recorded, as the partition of this run: a run that is repeated overwrites its
    own rows and touches no others."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = picks.dropDuplicates(keys)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.option("basePath", path).parquet(path).where(F.col("run").cast("string") != run)
        fresh = new_rows(picks, known, keys)
    (fresh.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def stale_seasons(games: DataFrame, stored: DataFrame, cols: list[str]) -> DataFrame:
    """Seasons to rebuild: those whose inputs changed, plus every later one, since histories carry
    forward. stored: season, hash, n of the last build."""
    now = fingerprint(games, ["season"], cols)
    diff = now.join(stored.select("season", F.col("hash").alias("old_hash"), F.col("n").alias("old_n")), "season", "full")
    changed = diff.where(~F.coalesce((F.col("hash") == F.col("old_hash")) & (F.col("n") == F.col("old_n")), F.lit(False)))
    first = changed.agg(F.min("season").alias("first"))                              # one row
    return now.join(F.broadcast(first), F.col("season") >= F.col("first")).select("season", "hash", "n")


def refresh_features(games: DataFrame, build, path: str, stale: DataFrame, lead_in: int) -> None:
    """Rebuild only stale seasons, with the `lead_in` seasons before them that the features look back on, and overwrite just
    their partitions."""
    first = stale.agg(F.min("season")).first()[0]                                     # one value
    if first is None:
        return
    earlier = games.where(F.col("season") >= first - lead_in)
    (build(earlier).where(F.col("season") >= first).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season").parquet(path))
