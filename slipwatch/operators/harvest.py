"""Steps of the monthly harvest: collapse slices, resume, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = ["report_month", "harvest_sector_id"]
MOST_SLICES = 100_000  # a few MB; 300 years of 27 sectors


def slice_collapse(records: DataFrame) -> DataFrame:
    """First record per project within one (month, sector) slice; months stay apart."""
    keys = [*SLICE, "project_id"]
    rest = [c for c in records.columns if c not in keys]
    return (
        records.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "harvest_seq").alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}") for c in rest])
    )


def resume(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records of (month, sector) pairs that are not there yet.

    The pairs are months times sectors, so they are counted and broadcast: a plain join
    would send all records of a pair to one task. A list beyond MOST_SLICES is joined plainly.
    """
    pairs = done.select(*SLICE).distinct()
    if pairs.limit(MOST_SLICES + 1).count() <= MOST_SLICES:
        pairs = F.broadcast(pairs)
    return records.join(pairs, SLICE, "left_anti")


def month_spine(bounds: DataFrame) -> DataFrame:
    """All months from `first` to `last` (dates) of a one-row frame, inclusive."""
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    return bounds.select(F.explode(months).alias("month")).select(
        F.date_format("month", "yyyy-MM").alias("report_month")
    )


def slice_counts(records: DataFrame, months: DataFrame, sectors: DataFrame) -> DataFrame:
    """Records per month and sector, with explicit zero rows.

    Records are counted before the join, and the grid holds months x sectors only.
    """
    counts = records.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n"))
    grid = months.crossJoin(sectors)
    return grid.join(counts, SLICE, "left").select(*SLICE, F.coalesce("n", F.lit(0)).alias("n"))


def harvest_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("project_id").alias("n_unique_projects"),
    )
