"""The 22 features, written once for panel rows and for single form rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwatch import schema as S

STALL = 0.1


def months_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(S.DAYS_PER_MONTH)


def at_least_one(c: Column) -> Column:
    return F.greatest(F.lit(1.0), c)


def expenditure_pct(expenditure: Column, cost: Column) -> Column:
    return expenditure * 100.0 / at_least_one(cost)


def duration_months(sanction: Column, original_end: Column) -> Column:
    days = F.datediff(original_end, sanction)
    return F.when(days > 0, at_least_one(days / F.lit(S.DAYS_PER_MONTH))).otherwise(36.0)


def elapsed_months(as_of: Column, sanction: Column, original_end: Column, duration: Column) -> Column:
    return (
        F.when(sanction.isNotNull(), F.greatest(F.lit(0.0), months_between(as_of, sanction)))
        .when(
            original_end.isNotNull(),
            F.greatest(F.lit(0.0), months_between(as_of, original_end) + duration),
        )
        .otherwise(duration * 0.5)
    )


def slipped_months(revised: Column, original_end: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), months_between(revised, original_end)), F.lit(0.0))


def required_velocity(remaining: Column, months_left: Column) -> Column:
    return F.when(months_left > 0, remaining / at_least_one(months_left)).otherwise(remaining)


def derived(
    cost: Column,
    expenditure: Column,
    expenditure_delta: Column,
    progress: Column,
    progress_delta: Column,
    progress_delta_3m: Column,
    duration: Column,
    elapsed: Column,
    months_left: Column,
    slipped: Column,
    stall_streak: Column,
    velocity: Column,
) -> dict[str, Column]:
    """All features from their primitive parts, in publication order."""
    spent = expenditure_pct(expenditure, cost)
    remaining = F.greatest(F.lit(0.0), 100.0 - progress)
    ratio = elapsed / duration
    required = required_velocity(remaining, months_left)
    return {
        "original_cost": cost,
        "log_original_cost": F.log1p(F.greatest(F.lit(0.0), cost)),
        "expenditure": expenditure,
        "expenditure_pct": spent,
        "expenditure_delta": expenditure_delta,
        "expenditure_delta_pct": expenditure_delta * 100.0 / at_least_one(cost),
        "physical_progress": progress,
        "progress_delta": progress_delta,
        "progress_delta_3m": progress_delta_3m,
        "remaining_progress_pct": remaining,
        "spend_progress_gap": spent - progress,
        "burn_to_progress_ratio": F.when(progress > 0.5, spent / progress).otherwise(0.0),
        "months_elapsed": elapsed,
        "original_duration_months": duration,
        "elapsed_ratio": ratio,
        "schedule_pressure": ratio - progress / 100.0,
        "months_to_revised_date": months_left,
        "revised_date_already_slipped_months": slipped,
        "stall_streak": stall_streak.cast("double"),
        "progress_velocity": velocity,
        "required_velocity": required,
        "velocity_deficit": required - velocity,
    }


def panel_features() -> dict[str, Column]:
    """Features of a history row (see `operators.panel.history`)."""
    c = F.col
    duration = duration_months(c("sanction_date"), c("original_end_date"))
    delta_3m = c("physical_progress") - F.coalesce(c("progress_prev3"), c("progress_first"))
    steps = F.least(F.lit(3.0), F.greatest(F.lit(1.0), c("seq_index").cast("double")))
    return derived(
        cost=c("original_cost"),
        expenditure=c("expenditure"),
        expenditure_delta=F.coalesce(
            F.greatest(F.lit(0.0), c("expenditure") - c("expenditure_prev")), F.lit(0.0)
        ),
        progress=c("physical_progress"),
        progress_delta=F.coalesce(c("physical_progress") - c("progress_prev"), F.lit(0.0)),
        progress_delta_3m=delta_3m,
        duration=duration,
        elapsed=elapsed_months(c("as_of"), c("sanction_date"), c("original_end_date"), duration),
        months_left=F.coalesce(months_between(c("revised_date"), c("as_of")), F.lit(0.0)),
        slipped=slipped_months(c("revised_date"), c("original_end_date")),
        stall_streak=c("stall_streak"),
        velocity=delta_3m / steps,
    )


# Features a single form row can only approximate.
APPROXIMATED = ["progress_delta_3m", "progress_velocity", "stall_streak"]


def form_features() -> dict[str, Column]:
    """The same features from one form row, which carries no history."""
    c = F.col
    duration = at_least_one(c("original_duration_months"))
    delta = F.coalesce(c("progress_change_recent"), F.lit(0.0))
    return derived(
        cost=c("original_cost"),
        expenditure=c("expenditure"),
        expenditure_delta=F.coalesce(c("expenditure_change_recent"), F.lit(0.0)),
        progress=c("physical_progress"),
        progress_delta=delta,
        progress_delta_3m=delta * 3.0,
        duration=duration,
        elapsed=c("months_elapsed"),
        months_left=duration + c("current_delay_months") - c("months_elapsed"),
        slipped=c("current_delay_months"),
        stall_streak=F.when(delta <= STALL, 1).otherwise(0),
        velocity=delta,
    )


def form_indicators() -> dict[str, Column]:
    """Five indicators a form row derives from its own fields."""
    c = F.col
    cost, progress, elapsed = c("original_cost"), c("physical_progress"), c("months_elapsed")
    spent = F.when(cost > 0, expenditure_on(cost)).otherwise(0.0)
    overrun = F.when(
        c("revised_cost").isNotNull() & (cost > 0),
        F.greatest(F.lit(0.0), F.round((c("revised_cost") - cost) / cost * 100.0, 4)),
    ).otherwise(0.0)
    realised = progress / F.nullif(elapsed, F.lit(0.0))
    needed = F.greatest(F.lit(0.01), 100.0 - progress) / at_least_one(c("original_duration_months") - elapsed)
    return {
        "remaining_progress_pct": F.greatest(F.lit(0.0), F.round(100.0 - progress, 4)),
        "expenditure_pct": spent,
        "cost_overrun_pct_current": overrun,
        "spend_progress_gap": F.round(spent - progress, 4),
        "execution_velocity": F.when((elapsed <= 0) | (progress >= 100.0), 1.0).otherwise(
            F.round(realised / needed, 4)
        ),
    }


def expenditure_on(cost: Column) -> Column:
    return F.round(F.col("expenditure") / F.nullif(cost, F.lit(0.0)) * 100.0, 4)
