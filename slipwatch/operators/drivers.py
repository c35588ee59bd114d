"""Which features drive a score, per row, for a linear model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Our own wording per feature: (raises the risk, lowers it).
DRIVER_TEXT = {
    "original_cost": ("Large projects are harder to steer", "Small projects are easier to steer"),
    "log_original_cost": ("Large projects are harder to steer", "Small projects are easier to steer"),
    "expenditure": ("Much money is already spent", "Little money is spent so far"),
    "expenditure_pct": ("The budget is largely used up", "Most of the budget is left"),
    "expenditure_delta": ("Spending jumped in the last report", "Spending is steady"),
    "expenditure_delta_pct": ("Spending jumped against the budget", "Spending is steady against the budget"),
    "physical_progress": ("The stage of work is prone to delay", "The stage of work is safe"),
    "progress_delta": ("Little was built last month", "Work moved last month"),
    "progress_delta_3m": ("Little was built in three months", "Work moved in three months"),
    "remaining_progress_pct": ("Much work is left", "Little work is left"),
    "spend_progress_gap": ("Spending runs ahead of work", "Spending matches work"),
    "burn_to_progress_ratio": ("Each step of work costs too much", "Work is done within its cost"),
    "months_elapsed": ("The project has run for long", "The project is young"),
    "original_duration_months": ("The plan spans a long time", "The plan is short"),
    "elapsed_ratio": ("Most of the planned time is gone", "Planned time is left"),
    "schedule_pressure": ("Time runs ahead of work", "Work keeps up with time"),
    "months_to_revised_date": ("The declared date is near or past", "The declared date is far off"),
    "revised_date_already_slipped_months": ("The date has slipped before", "The date has held so far"),
    "stall_streak": ("Reports without movement in a row", "No stall on record"),
    "progress_velocity": ("The recent pace is low", "The recent pace is good"),
    "required_velocity": ("The declared date needs a high pace", "The declared date needs a modest pace"),
    "velocity_deficit": ("The pace is below what the date needs", "The pace meets what the date needs"),
}
UP, DOWN, FLAT = "RISK_INCREASING", "RISK_DECREASING", "NEUTRAL"


def linear_contributions(coefficients: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """Exact contribution of each feature to a linear score: coefficient times deviation."""
    return {f: (F.col(f) - F.lit(float(means[f]))) * F.lit(float(b)) for f, b in coefficients.items()}


def contribution_array(contributions: dict[str, Column]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), phi.alias("phi"))
            for f, phi in contributions.items()
        ]
    )


def top_drivers(contributions: dict[str, Column], k: int = 5) -> Column:
    """The k largest contributions by size, ranked, with direction and text; a sort within the row."""
    texts = F.create_map(*[F.lit(x) for f, t in DRIVER_TEXT.items() for x in (f, list(t))])
    keyed = F.transform(
        contribution_array(contributions),
        lambda x: F.struct((-F.abs(x.phi)).alias("size"), x.feature.alias("feature"), x.value.alias("value"), x.phi.alias("phi")),
    )
    top = F.slice(F.array_sort(keyed), 1, k)

    def describe(x: Column, i: Column) -> Column:
        text = F.try_element_at(texts, x.feature)
        return F.struct(
            x.feature.alias("feature_name"),
            x.value.alias("feature_value"),
            x.phi.alias("contribution"),
            F.when(x.phi > 0, UP).when(x.phi < 0, DOWN).otherwise(FLAT).alias("direction"),
            (i + 1).alias("rank"),
            F.coalesce(
                F.when(x.phi > 0, text[0]).when(x.phi < 0, text[1]),
                F.lit("No effect on this row"),
            ).alias("text"),
        )

    return F.transform(top, describe)


def driver_shares(contributions: dict[str, Column]) -> Column:
    """Contributions over the sum of their sizes, as an array of (feature, share)."""
    items = contribution_array(contributions)
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.abs(x.phi))
    total = F.when(total == 0, 1.0).otherwise(total)
    return F.transform(items, lambda x: F.struct(x.feature.alias("feature"), (x.phi / total).alias("share")))


def with_drivers(rows: DataFrame, coefficients: dict[str, float], means: dict[str, float], k: int = 5) -> DataFrame:
    return rows.withColumn("drivers", top_drivers(linear_contributions(coefficients, means), k))
