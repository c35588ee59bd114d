"""Scoring as it is served: model, calibrator, rising horizons, decision, drivers, assessment."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import rules as R
from slipwatch.operators import drivers as D
from slipwatch.operators import forms as Fo
from slipwatch.operators import metrics as M
from slipwatch.operators import models as Mo
from slipwatch.operators import splits as Sp

THRESHOLD = 0.3


@dataclass
class Horizon:
    """What serves one horizon: a scorer that adds column `score`, its calibrator and its threshold."""

    months: int
    scorer: Callable[[DataFrame], DataFrame]
    score: str
    calibrator: Mo.Calibrator | None = None
    threshold: float = THRESHOLD
    report: dict = field(default_factory=dict)


def fit_horizon(
    panel: DataFrame, months: int, label: str, model: Mo.Candidate | None = None,
    features: Sequence[str] = S.FEATURES, folds: int = 5,
) -> Horizon:
    """Calibrator and threshold from cross-fitted scores, the model from all labelled rows."""
    model = model or Mo.select_candidates(["gbt"])[0]
    rows = Sp.labelled(panel, label)
    oof = Mo.grouped_cv(rows, [model], features, label, folds)
    calibrated, calibrator, report = Mo.cross_fit_calibration(oof, model.name, label, folds)
    sweep = M.threshold_sweep(calibrated, label, "calibrated" if report["kept"] else model.name)
    best = M.best_threshold(sweep).first()
    threshold = THRESHOLD if best is None or best["threshold"] is None else float(best["threshold"])
    return Horizon(months, model.fit(rows, features, label), model.name, calibrator, threshold, report)


def group_rates(flag: str, name: str = "rates") -> Mo.Candidate:
    """A saturated model of one 0/1 column: the training rate of each side."""

    def fit(train: DataFrame, features: Sequence[str], label: str) -> Callable[[DataFrame], DataFrame]:
        rows = train.groupBy((F.col(flag) > 0).alias("on")).agg(F.avg(F.col(label).cast("double")).alias("rate")).collect()
        rate = {r["on"]: r["rate"] for r in rows if r["rate"] is not None}
        on, off = (F.lit(rate.get(side, 0.0)) for side in (True, False))
        return lambda df: df.withColumn(name, F.when(F.col(flag) > 0, on).otherwise(off))

    return Mo.Candidate(name, fit)


def score_horizons(rows: DataFrame, horizons: Sequence[Horizon]) -> DataFrame:
    """Adds p_<k>m, lifted_<k>m and decision_<k>m for each horizon; rows are scored in place.

    A probability never falls with the horizon: a lower one is lifted to the one before.
    """
    columns = rows.columns
    for h in horizons:
        rows = h.scorer(rows)
        if h.calibrator is not None:
            rows = h.calibrator(rows, h.score, f"_own_{h.months}").drop(h.score)
        else:
            rows = rows.withColumnRenamed(h.score, f"_own_{h.months}")
    out = R.monotone_horizons({h.months: F.col(f"_own_{h.months}") for h in horizons})
    by_months = {h.months: h for h in horizons}
    added = []
    for k, (p, lifted) in out.items():
        added += [
            p.alias(f"p_{k}m"), lifted.cast("int").alias(f"lifted_{k}m"),
            (p >= by_months[k].threshold).cast("int").alias(f"decision_{k}m"),
        ]
    return rows.select(*columns, *added)


def assess_forms(
    forms: DataFrame, horizons: Sequence[Horizon], coefficients: dict[str, float] | None = None,
    means: dict[str, float] | None = None, price_on: int | None = None, base_rate: float = 0.5,
) -> DataFrame:
    """Assessment of form rows on calibrated probabilities, with all horizons and, given linear terms, drivers.

    Money is priced on the horizon `price_on` (default: the shortest).
    """
    k = price_on or min(h.months for h in horizons)
    scored = score_horizons(Fo.with_form_features(forms), horizons)
    if coefficients:
        scored = D.with_drivers(scored, coefficients, means or dict.fromkeys(coefficients, 0.0))
    plain = Fo.without_form_features(scored).withColumn("p_model", F.col(f"p_{k}m"))
    return Fo.assess(plain, "p_model", base_rate).withColumn("model_score", F.col("p_model") * 100.0)
