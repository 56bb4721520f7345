"""Named queries and, where SQL can say the same, their oracle text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, reals rounded to 6 digits, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            r = F.round(c.cast("double"), 6)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def real(expr: str, name: str) -> str:
    """Oracle-side rounding to match `tidy`."""
    return f"CASE WHEN round({expr}, 6) = 0 THEN 0.0 ELSE round({expr}, 6) END AS {name}"


def reals(**exprs: str) -> str:
    return ", ".join(real(e, n) for n, e in exprs.items())
