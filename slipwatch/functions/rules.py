"""Deterministic warning rules, the combined score and its tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions.features import STALL, at_least_one

CRITICAL_GAP = 40.0


def _parts() -> dict[str, Column]:
    c = F.col
    progress = c("physical_progress")
    gap = (c("expenditure") / at_least_one(c("original_cost")) - progress / 100.0) * 100.0
    density = c("overdue_milestones") / F.greatest(F.lit(1), c("total_scheduled_milestones"))
    left = c("original_duration_months") + c("current_delay_months") - c("months_elapsed")
    return {
        "gap": gap,
        "progress": progress,
        "moved": F.coalesce(c("progress_change_recent"), F.lit(0.0)),
        "ratio": c("months_elapsed") / at_least_one(c("original_duration_months")),
        "density": density,
        "clearance": c("clearance_pending_days"),
        "stale": c("days_since_last_update"),
        "left": left,
        "overdue": F.greatest(F.lit(0.0), -left),
    }


def rule_flags() -> dict[str, Column]:
    """Which of the six rules fire on a form row; all edges are inclusive as written."""
    p = _parts()
    return {
        "F1": (p["gap"] >= 25.0) & (p["progress"] < 50.0),
        "F2": (p["moved"] <= STALL) & (p["ratio"] >= 0.20) & (p["progress"] < 95.0),
        "F3": (p["density"] >= 0.50) | (p["clearance"] > 180),
        "F4": p["stale"] > 60,
        "F5": F.col("dispute_status").isin(S.DISPUTES_THAT_FIRE),
        "F6": (p["left"] <= 0.0) & (p["progress"] < 95.0),
    }


def critical_override() -> Column:
    """A rule fired in its critical range (a wide gap alone does not count)."""
    p, fires = _parts(), rule_flags()
    return (
        (fires["F1"] & (p["gap"] >= CRITICAL_GAP))
        | (fires["F3"] & (p["clearance"] > 365))
        | fires["F5"]
        | (fires["F6"] & (p["overdue"] >= 12.0))
    )


def rule_floor(weights: dict[str, float] | None = None) -> Column:
    """Sum of the weights of the rules that fire, at most 100."""
    weights = {**S.RULE_WEIGHTS, **(weights or {})}
    total = F.lit(0.0)
    for flag, fires in rule_flags().items():
        total = total + F.when(fires, float(weights[flag])).otherwise(0.0)
    return F.least(F.lit(100.0), total)


def active_rules() -> Column:
    return sum((f.cast("int") for f in rule_flags().values()), F.lit(0))


# Signal code and our own wording of what each rule says.
RULE_TEXT = {
    "F1": ("SPEND_PROGRESS_DECOUPLING", "Money is spent well ahead of the work done"),
    "F2": ("PROGRESS_STALL", "No measurable work in the last report"),
    "F3": ("MILESTONE_CLEARANCE_STALL", "Milestones missed or a clearance pending for long"),
    "F4": ("REPORTING_NON_COMPLIANCE", "No report filed for more than two months"),
    "F5": ("CONTRACTUAL_LITIGATION", "A contract dispute stops the work"),
    "F6": ("DECLARED_DATE_ELAPSED", "The declared end date has passed, the work has not"),
}


def rule_signals(weights: dict[str, float] | None = None) -> Column:
    """All six signals, fired or not, as an array of structs in rule order."""
    weights = {**S.RULE_WEIGHTS, **(weights or {})}
    p, fires = _parts(), rule_flags()
    long_clearance = p["clearance"] > 180
    fixed = F.lit
    shown = {
        "F1": (
            F.when(p["gap"] >= CRITICAL_GAP, "CRITICAL").otherwise("HIGH"),
            fixed("spend_progress_gap"), F.round(p["gap"], 2), fixed(25.0),
        ),
        "F2": (
            F.when(p["ratio"] >= 0.50, "HIGH").otherwise("MEDIUM"),
            fixed("progress_change_recent"), F.round(p["moved"], 2), fixed(STALL),
        ),
        "F3": (
            F.when(p["clearance"] > 365, "CRITICAL").otherwise("HIGH"),
            F.when(long_clearance, "clearance_pending_days").otherwise("milestone_density"),
            F.when(long_clearance, p["clearance"].cast("double")).otherwise(F.round(p["density"], 2)),
            F.when(long_clearance, 180.0).otherwise(0.50),
        ),
        "F4": (
            fixed("MEDIUM"), fixed("days_since_last_update"), p["stale"].cast("double"), fixed(60.0),
        ),
        "F5": (
            fixed("CRITICAL"), fixed("dispute_status_indicator"),
            fires["F5"].cast("double"), fixed(1.0),
        ),
        "F6": (
            F.when(p["overdue"] >= 12.0, "CRITICAL").otherwise("HIGH"),
            fixed("months_past_declared_completion_date"), F.round(p["overdue"], 2), fixed(0.0),
        ),
    }
    signals = []
    for flag, (severity, metric, value, threshold) in shown.items():
        code, text = RULE_TEXT[flag]
        signals.append(
            F.struct(
                fixed(flag).alias("flag_id"),
                fixed(code).alias("signal_code"),
                fixed(text).alias("rule_name"),
                severity.alias("severity"),
                F.when(fires[flag], float(weights[flag])).otherwise(0.0).alias("weight"),
                fires[flag].alias("is_active"),
                metric.alias("metric_name"),
                value.alias("metric_value"),
                threshold.alias("threshold_value"),
            )
        )
    return F.array(*signals)


def model_score(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) * 100.0


def combined_score(p: Column, floor: Column) -> Column:
    """The larger of model score and rule floor: neither can hide the other."""
    floor = F.least(F.lit(100.0), F.greatest(F.lit(0.0), floor))
    return F.greatest(model_score(p), floor)


def dominant_source(p: Column, floor: Column) -> Column:
    """Which side set the score; a tie (to nine places) goes to the rules."""
    floor = F.least(F.lit(100.0), F.greatest(F.lit(0.0), floor))
    return F.when(F.round(model_score(p), 9) > F.round(floor, 9), S.SOURCES[0]).otherwise(S.SOURCES[1])


def risk_tier(score: Column) -> Column:
    out = None
    for edge, tier in S.TIER_BANDS:
        out = F.when(score >= edge, tier) if out is None else out.when(score >= edge, tier)
    return out.otherwise("LOW")


# Our own wording of what to do, keyed by what triggers it.
ACTIONS = {
    "tier": "Put the project on the agenda of the next review.",
    "F1": "Audit advances paid and material on site.",
    "F2": "Inspect the site and ask for a ninety-day recovery plan.",
    "F3": "Take the pending clearances to the coordinating body.",
    "F4": "Ask for the missing monthly report within seven days.",
    "F5": "Start conciliation and check the contractor's funds first.",
    "F6": "Ask for a new date and cost estimate; hold milestone payments until then.",
    "fallback": "Budget with the sector's median overrun until an estimate is filed.",
    "low": "Within tolerance; keep reporting monthly.",
    "default": "Watch the score; nothing has fired in this report.",
}


def interventions(tier: Column, fallback: Column) -> Column:
    """Ordered actions that apply to a form row; never empty."""
    urgent = tier.isin("HIGH", "CRITICAL")
    chosen = [F.when(urgent, ACTIONS["tier"])]
    chosen += [F.when(fires, ACTIONS[flag]) for flag, fires in rule_flags().items()]
    chosen += [F.when(fallback & urgent, ACTIONS["fallback"]), F.when(tier == "LOW", ACTIONS["low"])]
    listed = F.array_compact(F.array(*chosen))
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(ACTIONS["default"])))


def deadline_passed() -> Column:
    """Binary deadline rule on panel columns."""
    return ((F.col("months_to_revised_date") <= 0) & (F.col("physical_progress") < 95.0)).cast("double")


def deadline_proximity(months_left: Column) -> Column:
    """Continuous deadline rule: the further past the date, the closer to 1."""
    scaled = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), months_left / 6.0))
    return F.lit(1.0) / (F.exp(scaled) + 1.0)


def rules_as_score() -> Column:
    """F1 and F2 on panel columns as a score in [0, 1]."""
    c = F.col
    f1 = (c("spend_progress_gap") >= 25.0) & (c("physical_progress") < 50.0)
    f2 = (c("progress_delta") <= STALL) & (c("elapsed_ratio") >= 0.20) & (c("physical_progress") < 95.0)
    points = F.when(f1, 30.0).otherwise(0.0) + F.when(f2, 25.0).otherwise(0.0)
    return points / 55.0


def monotone_horizons(probabilities: dict[int, Column]) -> dict[int, tuple[Column, Column]]:
    """Running maximum over rising horizons and a flag where it lifts the value."""
    out, running = {}, None
    for k in sorted(probabilities):
        own = probabilities[k]
        running = own if running is None else F.greatest(running, own)
        out[k] = (running, running > own + 1e-9)
    return out
