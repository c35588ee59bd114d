"""Tables laid out for what is asked of them: clustered for lookups, bucketed for joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

SCORE_KEYS = ("project_id", "seq_index")


def with_key_filter(writer: DataFrameWriter, key: str) -> DataFrameWriter:
    """Parquet Bloom filters on `key`, of a size that follows the distinct values of a row group."""
    return writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")


def write_clustered(df: DataFrame, path: str, key: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Rows of one key next to each other, in files of even size: row groups cover narrow ranges of the key.

    `order` goes on where one key fills more than a file.
    """
    sort = [key, *order]
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    with_key_filter(rows.write.mode(mode), key).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The rows of one key: the comparison is on the stored column, so other row groups are not read."""
    table = spark.read.parquet(path)
    return table.filter(F.col(key) == F.lit(value).cast(table.schema[key].dataType))


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = SCORE_KEYS) -> None:
    """A table dealt and sorted by `keys`; all of them, so that a project with very many rows is spread."""
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def side_by_side(spark: SparkSession, tables: Sequence[str], keys: Sequence[str] = SCORE_KEYS) -> DataFrame:
    """Tables of `write_bucketed` with equal buckets, joined row by row without a shuffle."""
    frames = [spark.table(t) for t in tables]
    # Small tables would be broadcast whole; a merge of their buckets holds for any size.
    return reduce(lambda a, b: a.join(b.hint("merge"), list(keys)), frames)
