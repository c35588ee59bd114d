"""Is the label physical? Effect sizes, gap bands, stage bias and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Indicator -> (group, expected direction or none).
INDICATORS = {
    "schedule_pressure": ("schedule_relative", "higher"),
    "velocity_deficit": ("schedule_relative", "higher"),
    "progress_delta": ("absolute_activity", None),
    "progress_velocity": ("absolute_activity", None),
    "stall_streak": ("absolute_activity", None),
    "spend_progress_gap": ("spend_pattern", None),
}


def magnitude(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(d.isNull(), "not evaluable")
        .when(size < 0.10, "negligible")
        .when(size < 0.30, "small")
        .when(size < 0.50, "medium")
        .otherwise("large")
    )


def effect_size(panel: DataFrame, label: str = "slip_next", active_only: bool = False) -> DataFrame:
    """Cohen's d of each indicator between rows followed by a slip and rows that were not."""
    if active_only:
        panel = panel.filter(F.col("progress_delta") > 0.1)
    stats = []
    for name in INDICATORS:
        for y, tag in ((1, "slip"), (0, "hold")):
            value = F.when(F.col(label) == y, F.col(name).cast("double"))
            stats += [
                F.count(value).alias(f"{name}__n_{tag}"),
                F.avg(value).alias(f"{name}__mean_{tag}"),
                F.var_samp(value).alias(f"{name}__var_{tag}"),
            ]
    # Twelve conditional moments per indicator pair in one pass; no rows are multiplied.
    one = panel.agg(*stats)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("indicator"),
                F.lit(group).alias("grp"),
                F.lit(expected).cast("string").alias("expected"),
                *[
                    F.col(f"{name}__{s}_{t}").alias(f"{s}_{t}")
                    for s in ("n", "mean", "var")
                    for t in ("slip", "hold")
                ],
            )
            for name, (group, expected) in INDICATORS.items()
        ]
    )
    flat = one.select(F.explode(rows).alias("r")).select("r.*").filter("n_slip >= 2 and n_hold >= 2")
    a, b = F.col("n_slip") - 1, F.col("n_hold") - 1
    pooled = F.sqrt((a * F.col("var_slip") + b * F.col("var_hold")) / (a + b))
    d = F.when(pooled == 0, 0.0).otherwise((F.col("mean_slip") - F.col("mean_hold")) / pooled)
    direction = F.when(F.col("mean_slip") > F.col("mean_hold"), "higher").otherwise("lower")
    return flat.select("*", d.alias("cohens_d"), direction.alias("direction")).select(
        "indicator",
        "grp",
        "mean_slip",
        "mean_hold",
        "cohens_d",
        magnitude(F.col("cohens_d")).alias("effect"),
        "direction",
        F.when(
            F.col("expected").isNotNull(),
            ((F.col("direction") == F.col("expected")) & (F.abs("cohens_d") >= 0.10)).cast("int"),
        ).alias("corroborates"),
    )


def gap_bands(panel: DataFrame, label: str = "slip_next") -> DataFrame:
    """Slip rate by band of the spend-progress gap, with the inversion flag on every row."""
    gap = F.col("spend_progress_gap")
    band = F.when(gap >= 25, "ahead").when(gap <= -25, "behind").otherwise("aligned")
    rates = panel.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("slip_rate")
    )
    rate = {b: F.max(F.when(F.col("band") == b, F.col("slip_rate"))) for b in ("ahead", "behind")}
    flag = rates.agg(F.coalesce(rate["behind"] > rate["ahead"], F.lit(False)).cast("int").alias("inverted"))
    return rates.crossJoin(F.broadcast(flag))


def stage_bias(panel: DataFrame, label: str = "slip_next") -> DataFrame:
    """Projects that ever slip against those that never do.

    Each project is reduced to its sums before the cohorts are formed, so rows are read
    once and no project is ever joined back to its rows.
    """
    per_project = panel.groupBy("project_id").agg(
        F.max(label).alias("ever"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("physical_progress").alias("progress"),
        F.sum("progress_delta").alias("delta"),
        F.sum((F.col("progress_delta") <= 0.1).cast("long")).alias("stalled"),
    )
    rows = F.sum("rows")
    return per_project.groupBy(F.when(F.col("ever") == 1, "ever").otherwise("never").alias("cohort")).agg(
        F.count(F.lit(1)).alias("projects"),
        rows.alias("project_months"),
        (F.sum("progress") / rows).alias("mean_physical_progress"),
        (F.sum("delta") / rows).alias("mean_progress_delta"),
        (F.sum("stalled") / rows).alias("stalled_share"),
    )


def label_verdict(all_months: DataFrame, active_months: DataFrame) -> DataFrame:
    """Grounded, partly grounded or administrative, from the schedule indicators."""
    def passed(effects: DataFrame, name: str) -> DataFrame:
        schedule = effects.filter("grp = 'schedule_relative'")
        return schedule.agg(
            F.count(F.lit(1)).alias(f"{name}_n"), F.coalesce(F.sum("corroborates"), F.lit(0)).alias(f"{name}_ok")
        )

    both = passed(all_months, "all").crossJoin(F.broadcast(passed(active_months, "active")))
    full = (F.col("all_n") > 0) & (F.col("all_ok") == F.col("all_n")) & (F.col("active_ok") == F.col("all_n"))
    verdict = F.when(full, "grounded").when(F.col("all_ok") > 0, "partly grounded").otherwise("administrative")
    return both.select("*", verdict.alias("verdict"))


def ordering_stability(aucs: DataFrame, baseline: str = "expenditure_progress", control: str = "reversed") -> DataFrame:
    """Spread over plausible orderings and the drop of the reversed control."""
    value = F.col("auc")
    legit = F.when(F.col("ordering") != control, value)
    out = aucs.agg(
        (F.max(legit) - F.min(legit)).alias("spread"),
        (
            F.max(F.when(F.col("ordering") == baseline, value)) - F.max(F.when(F.col("ordering") == control, value))
        ).alias("control_drop"),
    )
    return out.select(
        "*",
        F.when(F.col("spread") <= 0.03, "stable").when(F.col("spread").isNotNull(), "sensitive").otherwise("not evaluable").alias("stability"),
        F.when(F.col("control_drop") > 0.03, "passed").when(F.col("control_drop").isNotNull(), "failed").otherwise("not evaluable").alias("control"),
    )
