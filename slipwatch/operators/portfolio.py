"""Roll-ups, rankings and look-ups over assessed projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions.coerce import exact_cents, from_cents


def _rollup_columns() -> list[Column]:
    def total(name: str) -> Column:
        return from_cents(F.sum(exact_cents(F.col(name))).cast("double"))

    tiers = [F.count_if(F.col("risk_tier") == t).alias(f"tier_{t.lower()}") for t in S.TIERS]
    sources = [F.count_if(F.col("dominant_source") == s).alias(f"source_{s.lower()}") for s in S.SOURCES]
    return [
        F.count(F.lit(1)).alias("projects"),
        total("original_cost").alias("total_original_cost"),
        total("expenditure").alias("total_expenditure"),
        total("capital_at_risk").alias("total_capital_at_risk"),
        F.avg("gov_score").alias("avg_gov_score"),
        F.count_if(F.col("risk_tier").isin("HIGH", "CRITICAL")).alias("critical_high_projects"),
        *tiers,
        *sources,
    ]


def _at_risk_share() -> Column:
    share = F.try_divide(F.col("total_capital_at_risk"), F.col("total_original_cost")) * 100.0
    return F.coalesce(share, F.lit(0.0))


def portfolio_summary(assessed: DataFrame) -> DataFrame:
    """One row of totals, with zero-filled tier and source counts."""
    return assessed.agg(*_rollup_columns()).withColumn("capital_at_risk_pct", _at_risk_share())


def sector_rollup(assessed: DataFrame) -> DataFrame:
    """One row per sector, largest exposure first."""
    return assessed.groupBy("sector").agg(*_rollup_columns()).orderBy(F.desc("total_capital_at_risk"), "sector")


def summary_with_sectors(assessed: DataFrame) -> DataFrame:
    """Totals (`is_total` 1) and sectors in one pass over the data."""
    return (
        assessed.groupingSets([["sector"], []], "sector")
        .agg(F.grouping("sector").cast("int").alias("is_total"), *_rollup_columns())
        .withColumn("capital_at_risk_pct", _at_risk_share())
    )


def ranking(assessed: DataFrame, sector: str | None = None, tier: str | None = None, limit: int | None = None) -> DataFrame:
    """Leaderboard by exposure; ties in id order. The limit is 1 to 5,000, or none."""
    if limit is not None and not 1 <= limit <= 5000:
        raise ValueError("limit must lie between 1 and 5000")
    if sector:
        assessed = assessed.filter(F.lower("sector") == sector.lower())
    if tier:
        assessed = assessed.filter(F.upper("risk_tier") == tier.upper())
    ranked = assessed.orderBy(F.desc("capital_at_risk"), "project_id")
    return ranked if limit is None else ranked.limit(limit)


def search(assessed: DataFrame, text: str = "", tier: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a tier whose name, sector or agency contains the text."""
    if tier:
        assessed = assessed.filter(F.col("risk_tier") == tier)
    needle = text.strip().lower()
    if needle:
        fields = ["project_name", "sector", "implementing_agency"]
        hit = F.lit(False)
        for field in fields:
            hit = hit | F.coalesce(F.lower(field).contains(needle), F.lit(False))
        assessed = assessed.filter(hit)
    ranked = assessed.orderBy(F.desc("capital_at_risk"), "project_id")
    return ranked if limit is None else ranked.limit(limit)


def detail(assessed: DataFrame, project_id: str) -> DataFrame:
    """The row of one project; empty when unknown."""
    return assessed.filter(F.col("project_id") == project_id)


def best_model(metrics: DataFrame) -> DataFrame:
    """The best AUC in a metrics table and what is left to 1."""
    best = F.max_by(F.struct("model", "auc", "brier"), F.struct(F.col("auc"), F.col("model"))).alias("b")
    return metrics.filter(F.col("auc").isNotNull()).agg(best).select(
        F.col("b.model").alias("model"),
        F.col("b.auc").alias("auc"),
        F.col("b.brier").alias("brier"),
        (1.0 - F.col("b.auc")).alias("residual"),
    )
