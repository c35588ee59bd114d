"""Fitted baselines on `pyspark.ml`, cross-fitting and calibration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.functions import rules as R
from slipwatch.operators import backtest as Bt
from slipwatch.operators import hazard as Hz
from slipwatch.operators import logit as Lo
from slipwatch.operators import metrics as M
from slipwatch.operators import pooling as Po
from slipwatch.operators import report as Rp
from slipwatch.operators import splits as Sp
from slipwatch.session import cut_lineage

SEED = 20260917
MIN_PANEL_ROWS = 200
MIN_ISOTONIC_POSITIVES = 500
TREES = 400
ROWS_A_TASK = 1 << 16  # of a pass of a fit, at least
FEW = 1 << 17  # rows of a logit that are left to pyspark.ml
AT_ONCE = 5  # fits that run side by side


@dataclass
class Candidate:
    """A model to compare: `fit(train, features, label)` returns `score(rows) -> rows + name`."""

    name: str
    fit: Callable[[DataFrame, Sequence[str], str], Callable[[DataFrame], DataFrame]]


@dataclass
class Scorer:
    """A fitted pipeline with the medians it fills gaps with."""

    name: str
    model: PipelineModel
    medians: dict[str, float] = field(default_factory=dict)
    output: str = "probability"

    def __call__(self, rows: DataFrame) -> DataFrame:
        before = rows.columns
        filled = rows.fillna(self.medians) if self.medians else rows
        scored = self.model.transform(filled)
        p = vector_to_array(F.col("probability"))[1] if self.output == "probability" else F.col(self.output)
        return scored.select(*before, p.alias(self.name))


def _class_counts(train: DataFrame, label: str) -> tuple[int, int]:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("pos")).first()
    return row["n"], row["pos"]


def _fit(name: str, stages: list, train: DataFrame, features: Sequence[str], label: str, weight: Column, n: int, output: str = "probability") -> Scorer:
    Sp.assert_no_leakage(features)
    fills = Sp.fit_medians(train, features)
    ready = (train.fillna(fills) if fills else train).select(
        *features, F.col(label).cast("double").alias("_label"), weight.alias("_weight")
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="_raw")
    return Scorer(name, Pipeline(stages=[assembler, *stages]).fit(ready.coalesce(fit_tasks(train, n))), fills, output)


def fit_tasks(train: DataFrame, n: int) -> int:
    """Tasks of one pass of a fit over `n` rows: no more than there are cores, because passes are many and short."""
    return max(1, min(-(-n // ROWS_A_TASK), train.sparkSession.sparkContext.defaultParallelism))


def fit_logit(train: DataFrame, features: Sequence[str] = S.FEATURES, label: str = "slip_next", name: str = "logit") -> Scorer:
    """Elastic-net logit, standardised, balanced classes.

    Beyond FEW rows the same objective is solved by Newton steps: about ten scans to its
    least value, where the quasi-Newton steps of `pyspark.ml` take hundreds.
    """
    n, pos = _class_counts(train, label)
    weights = n / (2.0 * max(1, n - pos)), n / (2.0 * max(1, pos))
    mix, penalty = 0.3, 1.0 / (0.5 * max(1, n))
    if n > FEW and 0 < pos < n:
        Sp.assert_no_leakage(features)
        fills = Sp.fit_medians(train, features)
        filled = train.fillna(fills) if fills else train
        found = Lo.fit(filled, [F.col(f) for f in features], F.col(label), weights, penalty, mix)
        assembler = VectorAssembler(inputCols=list(features), outputCol="_raw")
        return Scorer(name, PipelineModel([assembler, _logit_model(*found)]), fills)
    stage = LogisticRegression(
        featuresCol="_raw", labelCol="_label", weightCol="_weight",
        elasticNetParam=mix, regParam=penalty, standardization=True, maxIter=200,
    )
    return _fit(name, [stage], train, features, label, F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]), n)


def _logit_model(coefficients: Sequence[float], intercept: float) -> LogisticRegressionModel:
    """A model of `pyspark.ml` with given coefficients."""
    kind = "org.apache.spark.ml.classification.LogisticRegressionModel"
    made = JavaWrapper._new_java_obj(kind, f"logit_{uuid.uuid4().hex[:12]}", Vectors.dense(list(coefficients)), float(intercept))
    return LogisticRegressionModel(made).setFeaturesCol("_raw")


def fit_hazard(train: DataFrame, features: Sequence[str] = S.FEATURES, label: str = "slip_next", name: str = "hazard") -> Hz.Hazard:
    """Discrete-time proportional hazards: cloglog link, penalty on the slopes only."""
    Sp.assert_no_leakage(features)
    return Hz.fit(train, features, label, name, medians=Sp.fit_medians(train, features))


def fit_gbt(train: DataFrame, features: Sequence[str] = S.FEATURES, label: str = "slip_next", name: str = "gbt", trees: int = TREES) -> Scorer:
    """Boosted trees with the positive class weighted by neg/pos."""
    n, pos = _class_counts(train, label)
    weight = F.when(F.col(label) == 1, (n - pos) / max(1.0, float(pos))).otherwise(1.0)
    stage = GBTClassifier(
        featuresCol="_raw", labelCol="_label", weightCol="_weight", maxIter=trees, maxDepth=4,
        stepSize=0.05, subsamplingRate=0.85, featureSubsetStrategy="0.8", minInstancesPerNode=8, seed=SEED,
    )
    return _fit(name, [stage], train, features, label, weight, n)


def fit_prior(train: DataFrame, features: Sequence[str] = (), label: str = "slip_next", name: str = "prior"):
    n, pos = _class_counts(train, label)
    return lambda rows: rows.withColumn(name, F.lit(pos / max(1, n)))


def _rule(name: str, score: Callable[[], Column]) -> Candidate:
    return Candidate(name, lambda train, features, label: lambda rows: rows.withColumn(name, score()))


def candidates(trees: int = TREES) -> list[Candidate]:
    """All compared models, from the constant prior to boosted trees."""
    return [
        Candidate("prior", lambda t, f, y: fit_prior(t, f, y)),
        _rule("rulefloor", R.rules_as_score),
        _rule("deadline_binary", R.deadline_passed),
        _rule("deadline_continuous", lambda: R.deadline_proximity(F.col("months_to_revised_date"))),
        Candidate("logit", fit_logit),
        Candidate("hazard", fit_hazard),
        Candidate("gbt", lambda t, f, y: fit_gbt(t, f, y, trees=trees)),
    ]


def select_candidates(names: Sequence[str], trees: int = TREES) -> list[Candidate]:
    return [c for c in candidates(trees) if c.name in names]


def importances(scorer: Scorer, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, share of importance), largest first: one number per feature."""
    shares = scorer.model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, (float(x) for x in shares)), key=lambda t: (-t[1], t[0]))


def linear_terms(scorer: Scorer, features: Sequence[str]) -> dict[str, float]:
    """Coefficient per feature of a logit, for exact contributions."""
    return dict(zip(features, (float(x) for x in scorer.model.stages[-1].coefficients)))


def score_with(rows: DataFrame, scorers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for scorer in scorers:
        rows = scorer(rows)
    return rows


def side_by_side(spark: SparkSession, work: Callable, items: Sequence, most: int = AT_ONCE) -> list:
    """`work` of every item in order, up to `most` at a time in threads of one session."""
    # Each call gets local properties of its own.
    calls = [inheritable_thread_target(spark)(partial(work, x)) for x in items]
    with ThreadPool(max(1, min(len(calls), most))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)


def grouped_cv(panel: DataFrame, models: Sequence[Candidate], features: Sequence[str] = S.FEATURES, label: str = "slip_next", folds: int = 5) -> DataFrame:
    """Out-of-fold scores: no project is scored by a model that saw it.

    The labelled panel is cut from its lineage first, because every fold reads it. A fit is a
    long row of small jobs, so the folds are fitted side by side.
    """
    Sp.assert_no_leakage(features)
    rows = cut_lineage(Sp.with_folds(Sp.labelled(panel, label), folds))

    def fold_scores(k: int) -> DataFrame:
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        return score_with(test, [m.fit(train, features, label) for m in models])

    parts = side_by_side(rows.sparkSession, fold_scores, range(folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def holdout(split: DataFrame, models: Sequence[Candidate], features: Sequence[str] = S.FEATURES, label: str = "slip_next") -> DataFrame:
    """Scores of the rows with `is_test` 1 by models fitted on the others."""
    rows = cut_lineage(Sp.labelled(split, label))
    train, test = rows.filter("is_test = 0"), rows.filter("is_test = 1")
    return score_with(test, [m.fit(train, features, label) for m in models])


def ordering_auc(raw: DataFrame, model: Candidate | None = None, features: Sequence[str] = S.FEATURES, label: str = "slip_next", folds: int = 5) -> DataFrame:
    """Cross-fitted AUC of a model on the panel rebuilt under each ordering of undated records.

    The model is the proposed one unless given. Panels below MIN_PANEL_ROWS labelled rows
    are left out. The typed records are the same for all orderings and derived once; two
    orderings are worked on at a time.
    """
    from slipwatch.operators import clean as K
    from slipwatch.operators.panel import ordered_panel, typed_records

    model = model or select_candidates(["gbt"])[0]
    cleaned = typed_records(raw, cut_lineage)

    def measure(name: str) -> DataFrame | None:
        panel = cut_lineage(ordered_panel(cleaned, order=name).filter("order_reliable = 1"))
        if _class_counts(Sp.labelled(panel, label), label)[0] < MIN_PANEL_ROWS:
            return None
        scores = cut_lineage(grouped_cv(panel, [model], features, label, folds))
        return M.auc(scores, label, model.name).select(F.lit(name).alias("ordering"), "auc", "positives", "negatives")

    out = None
    for part in side_by_side(raw.sparkSession, measure, K.ORDERINGS, 2):
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no ordering yields {MIN_PANEL_ROWS} labelled rows")
    return out


def compare(scores: DataFrame, names: Sequence[str], label: str = "slip_next") -> DataFrame:
    """Score report of several score columns, one row per model."""
    stacked = scores.select(
        label,
        F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("score")) for n in names])).alias("x"),
    ).select(label, "x.model", "x.score")
    return M.score_report(stacked, label, "score", ["model"])


@dataclass
class Calibrator:
    """Maps a score column to a calibrated probability."""

    method: str
    model: object
    decimals: int | None = None

    def __call__(self, rows: DataFrame, score: str, name: str) -> DataFrame:
        before = rows.columns
        if self.method == "isotonic":
            out = self.model.transform(rows.withColumn("_x", _rounded(score, self.decimals)))
            return out.select(*before, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias(name))
        ready = VectorAssembler(inputCols=[score], outputCol="_x").transform(rows)
        out = self.model.transform(ready)
        return out.select(*before, vector_to_array(F.col("probability"))[1].alias(name))


def calibration_method(rows: DataFrame, label: str) -> str:
    return "isotonic" if _class_counts(rows, label)[1] >= MIN_ISOTONIC_POSITIVES else "sigmoid"


def _rounded(score: str, decimals: int | None) -> Column:
    return F.col(score) if decimals is None else F.round(F.col(score), decimals)


def step_calibrator(steps: DataFrame, decimals: int | None = None) -> Calibrator:
    """The steps of `pooling.isotonic_steps` as a calibrator; only the edges of steps reach the driver."""
    points = Po.step_edges(steps).select(F.col("x").alias("_x"), F.col("value").alias("_y"), F.col("rows").alias("_w"))
    return Calibrator("isotonic", IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(points), decimals)


def fit_calibrator(rows: DataFrame, score: str, label: str, method: str | None = None, decimals: int | None = None) -> Calibrator:
    """Isotonic with at least 500 positives, else a sigmoid.

    An isotonic fit of n rows is pooled on the cluster; its steps, of which whole-number
    counts allow no more than the order of n ** (2/3), are all that the driver sees. With
    `decimals` scores are rounded first, here and by the calibrator.
    """
    method = method or calibration_method(rows, label)
    if method == "isotonic":
        rounded = rows.select(label, _rounded(score, decimals).alias("_x"))
        return step_calibrator(Po.isotonic_steps(Po.score_counts(rounded, label, "_x")), decimals)
    ready = VectorAssembler(inputCols=[score], outputCol="_x").transform(
        rows.withColumn("_y", F.col(label).cast("double"))
    )
    return Calibrator(method, LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0).fit(ready))


def fold_calibrators(rows: DataFrame, score: str, label: str, folds: int, method: str) -> list[Calibrator | None]:
    """For every fold a calibrator of the others; None where the others hold no row.

    Isotonic fits of all folds are pooled together, from one count of the scores.
    """
    if method != "isotonic":
        return [fit_calibrator(rows.filter(F.col("fold") != k), score, label, method) for k in range(folds)]
    counts = Po.score_counts(rows, label, score, ["fold"])
    steps = Po.isotonic_steps(Po.other_folds(counts, folds), ["fold"])
    known = {r["fold"] for r in steps.select("fold").distinct().collect()}
    return [step_calibrator(steps.filter(F.col("fold") == k)) if k in known else None for k in range(folds)]


def cross_fit_calibration(
    scores: DataFrame, score: str, label: str = "slip_next", folds: int = 5, method: str | None = None
) -> tuple[DataFrame, Calibrator | None, dict]:
    """(rows + `calibrated`, shipped calibrator or None, report).

    Every row is calibrated by a fit on the other projects. A calibrator that makes the
    held-out error worse is discarded; otherwise the one shipped is refitted on all rows.
    """
    rows = cut_lineage(Sp.with_folds(Sp.labelled(scores, label), folds))
    method = method or calibration_method(rows, label)
    out = None
    for k, cal in enumerate(fold_calibrators(rows, score, label, folds, method)):
        own = rows.filter(F.col("fold") == k)
        part = cal(own, score, "calibrated") if cal else own.withColumn("calibrated", F.col(score).cast("double"))
        out = part if out is None else out.unionByName(part)
    out = cut_lineage(out)
    before = M.ece(rows, label, score).first()["ece"]
    after = M.ece(out, label, "calibrated").first()["ece"]
    kept = after <= before
    shipped = fit_calibrator(rows, score, label, method) if kept else None
    report = {"method": method, "ece_before": before, "ece_after": after, "kept": kept}
    return out, shipped, report


def evaluate_horizon(panel: DataFrame, label: str, features: Sequence[str] = S.FEATURES, models: Sequence[Candidate] | None = None, folds: int = 5, proposed: str = "gbt") -> dict:
    """All evaluations of one horizon as DataFrames; refused below 200 labelled rows.

    The threshold is picked on cross-fitted calibrated scores, because that is the scale
    it is applied on.
    """
    models = list(models or candidates())
    names = [m.name for m in models]
    rows = Sp.labelled(panel, label)
    counts = Sp.censor_counts(panel, [label]).first()
    if counts["labelled"] < MIN_PANEL_ROWS:
        return {"status": "insufficient_rows", "rows_available": counts["labelled"]}
    oof = cut_lineage(grouped_cv(rows, models, features, label, folds))
    last = cut_lineage(holdout(Sp.split_last(rows), models, features, label))
    baselines = [n for n in names if n != proposed]
    calibrated, calibrator, calibration = cross_fit_calibration(oof, proposed, label, folds)
    point = "calibrated" if calibration["kept"] else proposed
    sweep = M.threshold_sweep(calibrated, label, point)
    out = {
        "status": "ok",
        "label": label,
        "rows_labelled": counts["labelled"],
        "rows_censored": counts["censored"],
        "scores": oof,
        "grouped": compare(oof, names, label),
        "grouped_delong": M.delong_all(oof, label, proposed, baselines),
        "last": compare(last, names, label),
        "last_delong": M.delong_all(last, label, proposed, baselines),
        "strata": M.auc_strata(oof, label, proposed),
        "cohorts": M.auc_cohorts(oof, label, [n for n in names if n != "prior"]),
        "calibration": calibration,
        "calibrator": calibrator,
        "sweep": sweep,
        "threshold": M.best_threshold(sweep),
    }
    banded = lambda df: df.withColumn("stratum", M.history_band())
    splits = {"grouped": banded(oof), "last": banded(last)}
    split = Sp.out_of_time_report(panel, label)
    out["out_of_time_split"] = split
    if split.first()["status"] == "ok":
        late = cut_lineage(holdout(Sp.split_out_of_time(rows), models, features, label))
        splits["out_of_time"] = banded(late)
        out["out_of_time"] = compare(late, names, label)
        out["out_of_time_delong"] = M.delong_all(late, label, proposed, baselines)
    out["report"] = Rp.stacked_report(Rp.stack(splits, names, label, "stratum"))
    out["lead_time"] = Bt.lead_time(Bt.first_events(calibrated, point, label))
    final = [m for m in models if m.name == proposed]
    model = final[0].fit(rows, features, label) if final else None
    out["model"] = model
    out["importances"] = importances(model, features) if hasattr(getattr(model, "model", None), "stages") and hasattr(model.model.stages[-1], "featureImportances") else []
    # What is served: the final model on the calibrated scale that the threshold was picked on.
    out["served"] = (lambda df: calibrator(model(df), proposed, "calibrated")) if model and calibrator else model
    return out
