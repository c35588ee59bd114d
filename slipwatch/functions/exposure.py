"""Money at risk from cost, probability and sector overrun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions.coerce import lookup


def sector_median(sector: Column, table: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(median overrun, matched): alias first, then the name itself, else the national value."""
    medians = {k.lower(): float(v) for k, v in (table or S.SECTOR_MEDIAN_OVERRUN).items()}
    name = F.lower(F.trim(sector))
    alias = F.lower(F.coalesce(lookup(name, S.EXPOSURE_ALIASES), name))
    found = F.coalesce(lookup(alias, medians), lookup(name, medians))
    return F.coalesce(found, F.lit(S.NATIONAL_MEDIAN_OVERRUN)), found.isNotNull()


def exposure(cost: Column, p: Column, overrun: Column, median: Column) -> dict[str, Column]:
    """Expected overrun in money, capped at three times the cost."""
    none = (cost <= 0) | (p <= 0)
    reported = F.greatest(F.lit(0.0), overrun)
    effective = F.greatest(reported, median)
    raw = cost * p * (effective / 100.0)
    cap = cost * S.EXPOSURE_CAP
    return {
        "capital_at_risk": F.when(none, 0.0).otherwise(F.least(cap, raw)),
        "effective_overrun_pct": F.when(none, 0.0).otherwise(effective),
        "is_sector_fallback_used": ~none & (reported < median),
        "is_clamped_to_cap": ~none & (raw > cap),
    }


def score_as_probability(score: Column) -> Column:
    """The executive variant prices the combined score instead of the model."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 100.0))
