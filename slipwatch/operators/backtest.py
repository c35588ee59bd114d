"""Lead time of warnings against the first slip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch.operators.metrics import f1

ALERT_LEVELS = [0.20, 0.30, 0.40, 0.50, 0.60, 0.70]


def first_events(scored: DataFrame, score: str, label: str = "slip_next", levels: Sequence[float] = ALERT_LEVELS) -> DataFrame:
    """Per level and project: position of first slip, first alert and first row.

    A project is first reduced to its first row per number of levels reached (a handful
    of rows), and only these meet the levels.
    """
    levels = sorted(levels)
    reached = sum(((F.col(score) >= t).cast("int") for t in levels), F.lit(0))
    reduced = scored.groupBy("project_id", reached.alias("reached")).agg(
        F.min("seq_index").alias("first_row"),
        F.min(F.when(F.col(label) == 1, F.col("seq_index"))).alias("slip"),
        F.max("n_snapshots").alias("n_snapshots"),
    )
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("level")) for i, t in enumerate(levels)]))
    return (
        reduced.select("*", grid.alias("g"))
        .groupBy(F.col("g.level").alias("level"), "project_id")
        .agg(
            F.min("slip").alias("first_slip"),
            F.min(F.when(F.col("reached") > F.col("g.i"), F.col("first_row"))).alias("first_alert"),
            F.min("first_row").alias("first_row"),
            F.max("n_snapshots").alias("n_snapshots"),
        )
    )


def lead_time(events: DataFrame) -> DataFrame:
    """Lead time and project-level confusion per alert level.

    A slip at position i shows in report i + 1; leads may be negative; slips never
    alerted are counted and left out of the distribution. Equal leads are counted first, so
    the one exact percentile is taken over distinct leads with their counts.
    """
    slip, alert = F.col("first_slip").isNotNull(), F.col("first_alert").isNotNull()
    lead = F.when(slip & alert, F.col("first_slip") + 1 - F.col("first_alert"))
    rows = events.select("*", slip.alias("s"), alert.alias("a"), lead.cast("double").alias("lead"))
    out = rows.groupBy("level").agg(
        F.count_if("s").alias("slip_projects"),
        F.count_if(F.col("lead") > 0).alias("alerted_before_slip"),
        F.count_if(F.col("s") & ~F.col("a")).alias("never_alerted"),
        F.count_if(F.col("s") & (F.col("first_slip") == F.col("first_row"))).alias("left_censored"),
        F.count_if(F.col("lead").isNotNull() & (F.col("n_snapshots") <= 3)).alias("window_truncated"),
        F.avg("lead").alias("mean_lead"),
        F.avg((F.col("lead") > 0).cast("double")).alias("share_positive"),
        F.avg((F.col("lead") == 0).cast("double")).alias("share_zero"),
        F.avg((F.col("lead") < 0).cast("double")).alias("share_negative"),
        F.count_if(F.col("s") & F.col("a")).alias("tp"),
        F.count_if(~F.col("s") & F.col("a")).alias("fp"),
        F.count_if(F.col("s") & ~F.col("a")).alias("fn"),
        F.count(F.lit(1)).alias("projects_total"),
    )
    leads = rows.filter("lead is not null").groupBy("level", "lead").agg(F.count(F.lit(1)).alias("n"))
    spread = leads.groupBy("level").agg(F.percentile("lead", [0.25, 0.5, 0.75], F.col("n")).alias("_q"))
    out = out.join(spread, "level", "left").select(
        *out.columns, *[F.get("_q", F.lit(i)).alias(f"{q}_lead") for i, q in enumerate(["p25", "median", "p75"])]
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    calm = F.col("projects_total") - F.col("tp") - F.col("fn")
    return out.select(
        "*",
        precision.alias("alert_precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(F.col("fp"), calm), zero).alias("false_alarm_rate"),
        f1(precision, recall).alias("f1"),
        (F.col("tp") + F.col("fp")).alias("projects_flagged"),
    ).drop("tp", "fp", "fn")


def lead_best(leads: DataFrame) -> DataFrame:
    """The level with the largest F1 among those with slips; the lowest level wins a tie."""
    best = F.max_by(F.struct(*leads.columns), F.struct(F.col("f1"), -F.col("level"))).alias("b")
    return leads.filter("slip_projects > 0").agg(best).filter("b is not null").select("b.*")


def observation_window(scored: DataFrame) -> DataFrame:
    """Longest lead that the data can show."""
    return scored.agg((F.max("n_snapshots") - 1).alias("max_observable_lead"))
