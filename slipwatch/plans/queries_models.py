"""Queries that fit models: checked by row counts and invariants, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators import diagnostics as Dg
from slipwatch.operators import metrics as M
from slipwatch.operators import models as Mo
from slipwatch.operators import splits as Sp
from slipwatch.plans import inputs as I
from slipwatch.plans.registry import query
from slipwatch.session import cut_lineage


def _holdout(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Last-transition holdout scores of the named models and their report."""
    rows = Sp.split_last(I.panel(spark, sf_dir))
    scores = Mo.holdout(rows, Mo.select_candidates(names))
    return Mo.compare(scores, names)


@query()
def fit_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout(spark, sf_dir, ["prior", "logit"])


@query()
def fit_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout(spark, sf_dir, ["prior", "hazard"])


@query()
def fit_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout(spark, sf_dir, ["prior", "gbt"])


@query()
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability bins before and after cross-fitted calibration of the deadline score."""
    rows, _, report = Mo.cross_fit_calibration(I.panel(spark, sf_dir), "p_deadline")
    before = M.calibration_bins(rows, "slip_next", "p_deadline").withColumn("stage", F.lit("before"))
    after = M.calibration_bins(rows, "slip_next", "calibrated").withColumn("stage", F.lit("after"))
    return before.unionByName(after).withColumn("kept", F.lit(int(report["kept"])))


@query()
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated model with its threshold, fitted on the panel, scores and assesses all form rows in place."""
    from slipwatch.operators import serving as Sv

    panel = cut_lineage(I.panel(spark, sf_dir).select("project_id", *S.FEATURES, "slip_next"))
    served = Sv.fit_horizon(panel, 1, "slip_next", Mo.select_candidates(["logit"])[0])
    terms = Mo.linear_terms(served.scorer, S.FEATURES)
    means = panel.agg(*[F.avg(f).alias(f) for f in S.FEATURES]).first().asDict()
    rows = Sv.assess_forms(I.forms(spark, sf_dir).drop("p_model"), [served], terms, {k: v or 0.0 for k, v in means.items()})
    return rows.select(
        "project_id", "report_month", "p_model", "model_score", "decision_1m", "gov_score", "risk_tier", "capital_at_risk",
        F.get("drivers", 0)["feature_name"].alias("first_driver"),
    )


@query()
def ordering_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels rebuilt under each ordering of undated records, with the AUC of the logit in five folds.

    The operator's default is the proposed model; 25 fits of 400 trees are left to callers.
    """
    raw = cut_lineage(I.raw(spark, sf_dir).withColumn("report_month", F.lit(None).cast("string")))
    measured = cut_lineage(Mo.ordering_auc(raw, Mo.select_candidates(["logit"])[0]))
    return measured.crossJoin(F.broadcast(Dg.ordering_stability(measured)))
