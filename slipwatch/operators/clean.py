"""From raw snapshot records to ordered, typed snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import coerce as C
from slipwatch.operators.ranked import axis_cell
from slipwatch.operators.skew import HOT_ROWS, join_attributes
from slipwatch.session import cut_lineage

Store = Callable[[DataFrame], DataFrame]

MODAL_FIELDS = ["sanction_date", "original_end_date", "original_cost"]


def dedupe(raw: DataFrame, identity: Sequence[str] = S.IDENTITY) -> DataFrame:
    """One row per project and identity: the first by `harvest_seq`, with `copies`.

    A grouped minimum instead of a window: copies collapse before the shuffle, however
    many there are of one record.
    """
    keys = ["project_id", *identity]
    month = F.coalesce(F.col("report_month"), F.lit(""))
    rest = [c for c in raw.columns if c not in keys and c != "harvest_seq"]
    out = (
        raw.withColumn("report_month", month)
        .groupBy(*keys)
        .agg(
            F.min("harvest_seq").alias("harvest_seq"),
            F.count(F.lit(1)).alias("copies"),
            *([F.min_by(F.struct(*rest), "harvest_seq").alias("_rest")] if rest else []),
        )
    )
    return out.select(*keys, "harvest_seq", "copies", *[F.col(f"_rest.{c}") for c in rest])


def modal_values(df: DataFrame, fields: Sequence[str], key: str = "project_id") -> DataFrame:
    """Most frequent non-empty value of each field per key; the first seen wins a tie."""
    pairs = df.select(
        key,
        "harvest_seq",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        ).alias("_x"),
    ).select(key, "harvest_seq", "_x.field", "_x.value")
    counted = (
        pairs.filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy(key, "field", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("harvest_seq").alias("first_seen"))
    )
    rank = F.struct(F.col("n"), -F.col("first_seen"))
    return counted.groupBy(key).agg(
        *[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, rank)).alias(f) for f in fields]
    )


def axis_mode(unique: DataFrame) -> DataFrame:
    """Per project: does every de-duplicated row carry a reporting month?"""
    return unique.groupBy("project_id").agg(_has_months().alias("dated"))


def _has_months() -> Column:
    return F.bool_and(F.coalesce(F.col("report_month"), F.lit("")) != "")


def project_attributes(raw: DataFrame, unique: DataFrame) -> DataFrame:
    """One row per project: modal dates and cost, name, sector of the first record, axis."""
    modal = modal_values(unique, MODAL_FIELDS).select(
        "project_id",
        C.parse_date(F.col("sanction_date")).alias("modal_sanction"),
        C.parse_date(F.col("original_end_date")).alias("modal_end"),
        C.to_number(F.col("original_cost")).alias("modal_cost"),
    )
    names = modal_values(raw, ["project_name"])
    # A project's first record always survives the de-duplication.
    first = unique.groupBy("project_id").agg(
        _has_months().alias("dated"),
        F.min_by(F.coalesce(F.col("sector_name"), F.lit("")), "harvest_seq").alias("sector_name"),
    )
    return (
        first.join(modal, "project_id", "left")
        .join(names, "project_id", "left")
        .select(
            "project_id",
            "dated",
            C.canonical_sector(F.col("sector_name")).alias("sector"),
            F.coalesce(
                F.col("project_name"), F.concat(F.lit("Central Project "), F.col("project_id").cast("string"))
            ).alias("project_name"),
            "modal_sanction",
            "modal_end",
            F.coalesce(F.col("modal_cost"), F.lit(0.0)).alias("modal_cost"),
        )
    )


def clean(unique: DataFrame, attributes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Typed snapshots: modal cost and dates, units repaired, progress clamped."""
    rows = unique.select("project_id", "harvest_seq", "report_month", "expenditure", "physical_progress", "revised_date", "revised_cost")
    joined = join_attributes(rows, attributes, "project_id", "harvest_seq", min_rows=hot_rows)
    spend, cost = C.to_number(F.col("expenditure")), F.col("modal_cost")
    revised = C.to_number(F.col("revised_cost"), cost)
    return joined.select(
        "project_id",
        "project_name",
        "sector",
        "dated",
        "harvest_seq",
        "report_month",
        C.rescale_units(spend, cost).alias("expenditure"),
        C.wrong_units(spend, cost).alias("units_rescaled"),
        C.clamp(C.to_number(F.col("physical_progress")), 0, 100).alias("physical_progress"),
        C.parse_date(F.col("revised_date")).alias("revised_date"),
        cost.alias("original_cost"),
        F.when(revised > 0, revised).otherwise(cost).alias("revised_cost"),
        F.col("modal_sanction").alias("sanction_date"),
        F.col("modal_end").alias("original_end_date"),
    )


def one_per_month(dated: DataFrame) -> DataFrame:
    """Last row by (spend, progress) of each project and month, as a grouped maximum."""
    keys = ["project_id", "report_month"]
    rest = [c for c in dated.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("expenditure", "physical_progress", "harvest_seq")).alias("_r")
    return (
        dated.groupBy(*keys)
        .agg(last)
        .select(*keys, *[F.col(f"_r.{c}") for c in rest])
        .withColumn("axis", C.month_ordinal(F.col("report_month")).cast("bigint"))
    )


# Orderings of undated snapshots; `harvest_seq` settles what is left.
def _ordering() -> dict[str, list[Column]]:
    e, p, r = F.col("expenditure"), F.col("physical_progress"), F.col("revised_date")
    return {
        "expenditure_progress": [e.asc(), p.asc(), r.asc_nulls_first()],
        "progress_first": [p.asc(), e.asc(), r.asc_nulls_first()],
        "expenditure_only": [e.asc()],
        "revised_date_first": [r.asc_nulls_first(), e.asc(), p.asc()],
        "reversed": [e.desc(), p.desc(), r.desc_nulls_last()],
    }


ORDERINGS = ["expenditure_progress", "progress_first", "expenditure_only", "revised_date_first", "reversed"]
REVERSED = "reversed"


def ordering(name: str = "expenditure_progress") -> list[Column]:
    return [*_ordering()[name], F.col("harvest_seq").asc()]


def sequence(snapshots: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds `seq_index` (from 0) and `n_snapshots` per project, for projects bounded by the calendar."""
    whole = Window.partitionBy("project_id")
    return snapshots.select(
        "*",
        (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint").alias("seq_index"),
        F.count(F.lit(1)).over(whole).alias("n_snapshots"),
    )


def sequence_sorted(snapshots: DataFrame, name: str = "expenditure_progress", store: Store = cut_lineage) -> DataFrame:
    """`sequence` for projects of any size, under a named ordering.

    The rows are sorted across the cluster by project and all order columns down to
    `harvest_seq`, so a project of any size is spread over ranges of even size, also one whose
    leading column is null or equal in all rows. The sorted rows are written once; a row's
    position in its range, and the counts of its project in the ranges before, give its
    index. Only these counts, one row for each project and range, are ranked in a window.
    `store` must write the rows, so that ranges and counts are of one sort.
    """
    order = [F.col("project_id").asc(), *ordering(name)]
    placed = store(
        snapshots.repartitionByRange(*order).sortWithinPartitions(*order)
        # The upper bits are the range, the lower ones the position in it.
        .withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
    )
    counts = placed.groupBy("project_id", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    ranges = Window.partitionBy("project_id").orderBy("_range")
    starts = counts.select(
        "project_id", "_range", "_first",
        (F.sum("_n").over(ranges) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy("project_id")).alias("n_snapshots"),
    )
    return (
        placed.join(starts, ["project_id", "_range"])
        .withColumn("seq_index", F.col("_place") - F.col("_first") + F.col("_before"))
        .select(*snapshots.columns, "seq_index", "n_snapshots")
    )


def sequence_undated(snapshots: DataFrame, name: str = "expenditure_progress") -> DataFrame:
    """`sequence_sorted` without a job of its own, for plans that store nothing.

    A project's rows are cut into cells by a fixed rule on the leading order column (a
    month of dates, or a slice of the number axis). Rows are ranked inside a cell and count
    on from the totals of the cells before, so no task holds more than a cell; rows that
    agree in the leading column stay together, which `sequence_sorted` avoids.
    """
    cells = _cell(name)
    inside = Window.partitionBy("project_id", "_cell").orderBy(*ordering(name))
    rows = snapshots.withColumn("_cell", cells)
    by_cell = Window.partitionBy("project_id").orderBy("_cell")
    starts = (
        rows.groupBy("project_id", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "project_id",
            "_cell",
            F.coalesce(F.sum("_n").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("project_id")).alias("n_snapshots"),
        )
    )
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["project_id", "_cell"])
        .withColumn("seq_index", F.col("_before") + F.col("_row") - 1)
        .select(*snapshots.columns, "seq_index", "n_snapshots")
    )


def _cell(name: str) -> Column:
    """A whole number that never falls along the named ordering; nulls come first, last when reversed."""
    lead = {"progress_first": "physical_progress", "revised_date_first": "revised_date"}.get(name, "expenditure")
    if lead == "revised_date":
        return F.coalesce(F.floor(F.unix_date(F.col(lead)) / 30), F.lit(-(10**9))).cast("bigint")
    cell = F.coalesce(axis_cell(F.col(lead).cast("double")), F.lit(-(2**62)))
    return -cell if name == REVERSED else cell
