"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE, min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `share` of all rows, with the number of parts to split each into.

    No more than 1/share keys can pass, whatever the data: the result is safe to broadcast.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"))
    limit = F.greatest(F.col("_all") * F.lit(share), F.lit(float(min_rows)))
    return (
        counts.filter(F.col("_n") > min_rows)
        .crossJoin(F.broadcast(whole))
        .filter(F.col("_n") > limit)
        .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )


def join_attributes(
    rows: DataFrame,
    attributes: DataFrame,
    key: str,
    row_id: str | Sequence[str],
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join of many rows with one attribute row per key: "inner", "left_semi" or "left_anti".

    Rows of a hot key are spread over parts and its attribute row is repeated once per
    part, so no task gets more than about `share` of the rows. Rows without a key match
    nothing and are spread as well.
    """
    hot = F.broadcast(hot_keys(rows, key, share, min_rows))
    spread = F.xxhash64(*([row_id] if isinstance(row_id, str) else row_id))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = rows.join(hot, key, "left").withColumn(
        "_part", F.when(F.col(key).isNull(), F.pmod(spread, F.lit(1 << 20))).when(parts == 1, 0).otherwise(F.pmod(spread, parts)).cast("int")
    )
    right = attributes.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"], how).drop("_part")
