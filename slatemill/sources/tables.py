"""Parquet, CSV and JDBC scans, source unions and sinks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Exactly the wanted columns and types; absent ones become typed nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def scan(spark: SparkSession, paths: list[str], wanted: dict[str, str], unique: list[str] | None = None) -> DataFrame:
    """Yearly files as one table: merged schema, wanted columns, one row per key."""
    df = conform(spark.read.option("mergeSchema", True).parquet(*paths), wanted)
    return df.dropDuplicates(unique) if unique else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Headered CSV with an explicit schema; header case is normalised and blanks take defaults."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def scan_jdbc(spark: SparkSession, url: str, tables: dict[str, str], key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """One table per season over JDBC (tables: season -> table name), tagged and unioned by name. With a numeric `key`
    every table is read by `parts` connections at a time, over equal spans of the key between its ends (one small
    query a table); rows without a key go to the first."""
    def load(table: str) -> DataFrame:
        read = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **options)
        if key is None:
            return read(table).load()
        ends = read(f"(SELECT MIN({key}) AS LO, MAX({key}) AS HI FROM {table}) ENDS").load().first()
        if ends[0] is None:
            return read(table).load()
        low, high = int(ends[0]), int(ends[1])
        step = max(1, -(-(high - low + 1) // parts))
        cuts = list(range(low + step, high + 1, step))
        spans = [*zip([None, *cuts], [*cuts, None])]
        where = [" AND ".join(x for x in (f"{key} >= {a}" if a is not None else "", f"{key} < {b}" if b is not None else "") if x) or "1 = 1" for a, b in spans]
        if cuts:
            where[0] = f"({where[0]} OR {key} IS NULL)"
        return spark.read.jdbc(url, table, predicates=where, properties=dict(options))

    frames = [load(t).withColumn("season", F.lit(s)).withColumn("source_table", F.lit(t)) for s, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sources(frames: dict[str, DataFrame], date: str) -> DataFrame:
    """Tagged union of sources that must follow each other in time."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source", F.lit(n)) for n, d in frames.items()])
    spans = u.groupBy("source").agg(F.min(date).alias("lo"), F.max(date).alias("hi")).collect()      # one row per source
    spans.sort(key=lambda r: r["lo"])
    for a, b in zip(spans, spans[1:]):
        if a["hi"] >= b["lo"]:
            raise ValueError(f"sources overlap: {a['source']} ends {a['hi']}, {b['source']} starts {b['lo']}")
    return u


def write_table(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet sink laid out by season (and league), so later scans prune partitions."""
    df.write.mode(mode).partitionBy(*by).parquet(path)
