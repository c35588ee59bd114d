"""Latest state of each project as a form row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import coerce as C
from slipwatch.functions import features as Fx


def _number(name: str) -> Column:
    """Plain number text, 0 where unreadable; separators are not expected here."""
    text = F.trim(F.col(name))
    return F.coalesce(F.when(text.rlike(C.NUMBER), text.try_cast("double")), F.lit(0.0))


def latest_state(raw: DataFrame, today: date = date(2026, 9, 15)) -> DataFrame:
    """The record with the highest spend per project, with its change since the one before.

    Only the two best rows of a project pass the rank filter, which Spark applies before
    the shuffle, so a project's size does not matter.
    """
    spend = _number("expenditure")
    newest = Window.partitionBy("project_id").orderBy(F.desc("_spend"), F.desc("harvest_seq"))
    top = (
        raw.filter(F.coalesce(F.col("project_id"), F.lit(0)) != 0)
        .withColumn("_spend", spend)
        .withColumn("_rank", F.row_number().over(newest))
        .filter("_rank <= 2")
    )
    fields = [c for c in raw.columns if c != "project_id"]
    one = top.groupBy("project_id").agg(
        F.max_by(F.struct(*fields, "_spend"), -F.col("_rank")).alias("r"),
        F.max(F.when(F.col("_rank") == 2, F.struct("_spend", "physical_progress"))).alias("b"),
    )
    flat = one.select("project_id", "r.*", F.col("b._spend").alias("_spend_before"), F.col("b.physical_progress").alias("_before"), F.col("b").isNotNull().alias("_has_before"))

    cost = _number("original_cost")
    revised = _number("revised_cost")
    spent = C.rescale_units(F.col("_spend"), cost)
    progress = C.clamp(_number("physical_progress"), 0, 100)
    sanction, end = C.parse_date(F.col("sanction_date")), C.parse_date(F.col("original_end_date"))
    moved = C.parse_date(F.col("revised_date"))
    reported = _number("delayed_time")
    delay = F.when(reported > 0, reported).otherwise(Fx.slipped_months(moved, end))
    remarks = F.trim(F.coalesce(F.nullif(F.col("remarks"), F.lit("")), F.col("revised_date_reason"), F.lit("")))
    name = F.trim(F.coalesce(F.col("project_name"), F.lit("")))
    agency = F.trim(F.coalesce(F.nullif(F.col("company_name"), F.lit("")), F.nullif(F.col("line_ministry"), F.lit("")), F.lit("CPSE")))
    now = F.lit(today)
    return flat.filter(cost > 0).select(
        F.col("project_id"),
        F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Central Project "), F.col("project_id").cast("string"))).alias("project_name"),
        C.canonical_sector(F.col("sector_name"), case_sensitive=True).alias("sector"),
        F.when(F.length(agency) > 60, F.concat(F.substring(agency, 1, 57), F.lit("..."))).otherwise(agency).alias("implementing_agency"),
        F.col("state_name").alias("state"),
        F.round(cost, 2).alias("original_cost"),
        F.round(F.when(revised > 0, revised).otherwise(cost), 2).alias("revised_cost"),
        F.round(spent, 2).alias("expenditure"),
        F.round(F.when(F.col("_has_before"), F.greatest(F.lit(0.0), spent - F.col("_spend_before"))).otherwise(0.0), 2).alias("expenditure_change_recent"),
        F.round(progress, 2).alias("physical_progress"),
        F.round(
            F.when(F.col("_has_before"), C.clamp(progress - _number("_before"), -5, 100)).otherwise(0.0), 2
        ).alias("progress_change_recent"),
        F.round(Fx.duration_months(sanction, end), 1).alias("original_duration_months"),
        F.round(
            F.when(sanction.isNotNull(), F.greatest(F.lit(0.0), Fx.months_between(now, sanction))).otherwise(12.0), 1
        ).alias("months_elapsed"),
        F.round(delay, 1).alias("current_delay_months"),
        F.when(delay > 6.0, 1).otherwise(0).alias("overdue_milestones"),
        F.lit(15).alias("days_since_last_update"),
        F.when(C.mentions(remarks, S.CLEARANCE_WORDS), 195).otherwise(0).alias("clearance_pending_days"),
        # The form knows a dispute state, not a flag: litigation words mean arbitration.
        F.when(
            C.mentions(remarks, S.LITIGATION_WORDS) | C.mentions(name, S.LITIGATION_WORDS), "ARBITRATION"
        ).otherwise("NONE").alias("dispute_status"),
        F.nullif(remarks, F.lit("")).alias("delay_remarks"),
    )
