"""Registry of queries: a Spark callable and, where SQL can say it, the SQL to check against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Output types that compare across engines: doubles to six places, exposure to cents, whole numbers long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 2 if f.name == "capital_at_risk" else 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("int").cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.DecimalType)):
            c = c.cast("string" if isinstance(f.dataType, T.DateType) else "double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register
