"""Exact evaluation statistics of scores against a 0/1 label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipwatch.functions.stats import two_sided_p
from slipwatch.operators.ranked import score_table

# Right edges of ten equal bins, as doubles (i * 0.1).
BIN_EDGES = [i * 0.1 for i in range(1, 10)]
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
STRATA = [(2, 5), (6, 8), (9, 11), (12, 20)]
COHORTS = {"already_overdue": None, "not_yet_overdue": 0.0, "runway_over_3_months": 3.0, "runway_over_6_months": 6.0}
MIN_COHORT = 50
SCORE_PARTS = 16


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _both() -> Column:
    return (F.col("m") > 0) & (F.col("n") > 0)


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), constant_null: bool = True) -> DataFrame:
    """AUC with ties counted half; null with one class and, unless told otherwise, a constant score."""
    table = score_table(df, label, score, keys)
    least = 1 if constant_null else 0
    wins = F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2.0))
    return (
        table.groupBy(*keys)
        .agg(
            F.coalesce(F.sum("pos"), F.lit(0)).alias("m"),
            F.coalesce(F.sum("neg"), F.lit(0)).alias("n"),
            wins.alias("_wins"),
            F.count(F.lit(1)).alias("distinct_scores"),
        )
        .select(
            *keys,
            F.col("m").alias("positives"),
            F.col("n").alias("negatives"),
            "distinct_scores",
            F.when(_both() & (F.col("distinct_scores") > least), F.col("_wins") / (_d("m") * _d("n"))).alias("auc"),
        )
    )


def placements(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Placement values per distinct score: v10 for positives there, v01 for negatives."""
    table = score_table(df, label, score, keys, weight)
    both = (F.col("pos_all") > 0) & (F.col("neg_all") > 0)
    return table.filter(both).select(
        *keys,
        score,
        "pos",
        "neg",
        ((_d("neg_below") + _d("neg") / 2.0) / _d("neg_all")).alias("v10"),
        ((_d("pos_all") - _d("pos_below") - _d("pos") / 2.0) / _d("pos_all")).alias("v01"),
    )


def delong(df: DataFrame, label: str, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Paired DeLong test of two scores on the same rows, one row per key.

    Rows are first grouped by (score pair, label): copies of a pair travel once, with their
    count, and both score tables are built from these groups, so the input is read once.
    """
    keys = list(keys)
    y = F.col(label)
    pairs = (
        df.filter(y.isNotNull())
        .select(*keys, y.cast("int").alias("_y"), (_d(first) + 0.0).alias("_s1"), (_d(second) + 0.0).alias("_s2"))
        .groupBy(*keys, "_y", "_s1", "_s2")
        .agg(F.count(F.lit(1)).alias("_w"))
    )

    # Both scores of a pair are ranked in one pass, as two sides of one stacked table.
    sides = pairs.select(
        "*",
        F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("_s1").alias("s")), F.struct(F.lit(2).alias("side"), F.col("_s2").alias("s")))).alias("x"),
    ).select(*keys, "_y", "_s1", "_s2", "_w", F.col("x.side").alias("_side"), F.col("x.s").alias("_s"))
    placed = placements(sides, "_y", "_s", [*keys, "_side"], "_w").select(*keys, "_side", "_s", "v10", "v01")
    value = F.when(F.col("_y") == 1, F.col("v10")).otherwise(F.col("v01"))
    # A score with few values meets very many partners: the partner's hash splits it, and
    # the placements, one row for each score, are repeated for every part.
    part = F.pmod(F.xxhash64("_s1", "_s2", "_y"), F.lit(SCORE_PARTS)).cast("int")
    placed = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SCORE_PARTS - 1))))
    values = (
        sides.withColumn("_part", part).join(placed, [*keys, "_side", "_s", "_part"])
        .groupBy(*keys, "_y", "_s1", "_s2")
        .agg(
            F.max(_d("_w")).alias("w"),
            F.max(F.when(F.col("_side") == 1, value)).alias("a"),
            F.max(F.when(F.col("_side") == 2, value)).alias("b"),
        )
    )
    # Deviations from one half keep the sums of squares small, so nothing cancels.
    a, b = F.col("a") - 0.5, F.col("b") - 0.5
    wt = F.col("w")
    moments = values.groupBy(*keys, "_y").agg(
        F.sum(wt).alias("k"),
        F.sum(wt * a).alias("sa"),
        F.sum(wt * b).alias("sb"),
        F.sum(wt * a * a).alias("saa"),
        F.sum(wt * b * b).alias("sbb"),
        F.sum(wt * a * b).alias("sab"),
    )

    def cov(x: str, y_: str, xy: str) -> Column:
        k = F.col("k")
        return F.when(k > 1, (F.col(xy) - F.col(x) * F.col(y_) / k) / (k - 1.0)).otherwise(0.0) / k

    parts = moments.select(
        *keys,
        "_y",
        "k",
        (F.col("sa") / F.col("k") + 0.5).alias("ma"),
        (F.col("sb") / F.col("k") + 0.5).alias("mb"),
        cov("sa", "sa", "saa").alias("va"),
        cov("sb", "sb", "sbb").alias("vb"),
        cov("sa", "sb", "sab").alias("vab"),
    )
    out = parts.groupBy(*keys).agg(
        F.max(F.when(F.col("_y") == 1, F.col("ma"))).alias("auc_1"),
        F.max(F.when(F.col("_y") == 1, F.col("mb"))).alias("auc_2"),
        F.sum("va").alias("var_1"),
        F.sum("vb").alias("var_2"),
        F.sum("vab").alias("cov_12"),
        F.max(F.when(F.col("_y") == 1, F.col("k"))).cast("long").alias("positives"),
        F.max(F.when(F.col("_y") == 0, F.col("k"))).cast("long").alias("negatives"),
    )
    delta = F.col("auc_1") - F.col("auc_2")
    spread = F.col("var_1") + F.col("var_2") - 2.0 * F.col("cov_12")
    # Sums differ from zero in the last bits only when the placements are the same.
    scale = F.col("var_1") + F.col("var_2")
    same = spread <= scale * 1e-12
    even = F.abs(delta) <= F.sqrt(scale) * 1e-9
    z = (
        F.when(~same, delta / F.sqrt(spread))
        .when(even, F.lit(0.0))
        .otherwise(F.signum(delta) * F.lit(float("inf")))
    )
    p = F.when(~same, two_sided_p(F.col("z"))).when(even, 1.0).otherwise(0.0)
    return out.select("*", delta.alias("auc_delta"), z.alias("z")).select("*", p.alias("p_value"))


def delong_all(df: DataFrame, label: str, reference: str, baselines: Sequence[str]) -> DataFrame:
    """The reference score against every baseline; a constant baseline is named, not tested."""
    stacked = df.filter(F.col(label).isNotNull()).select(
        label,
        F.col(reference).alias("_ref"),
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("baseline"), _d(b).alias("_score")) for b in baselines])
        ).alias("_x"),
    ).select(label, "_ref", "_x.baseline", "_x._score")
    tested = delong(stacked, label, "_ref", "_score", ["baseline"])
    spread = stacked.groupBy("baseline").agg(
        F.max("_score").alias("_max"), F.min("_score").alias("_min")
    )
    constant = F.col("_max") - F.col("_min") <= 1e-8 + 1e-5 * F.abs("_min")
    flagged = spread.join(tested, "baseline", "left").withColumn("status", F.when(constant, "constant").otherwise("tested"))
    numbers = [c for c in tested.columns if c != "baseline"]
    return flagged.select(
        "baseline", "status", *[F.when(F.col("status") == "tested", F.col(c)).alias(c) for c in numbers]
    )


def _bin(p: Column) -> Column:
    return sum(((p >= e).cast("int") for e in BIN_EDGES), F.lit(0))


def calibration_bins(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean score and positive rate in ten equal bins."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(*keys, _bin(F.col(score)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(_d(label)).alias("rate"))
    )


def ece(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error: gap per bin weighted by its share of rows."""
    bins = calibration_bins(df, label, score, keys)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate")))
    return bins.groupBy(*keys).agg((gap / F.sum("n")).alias("ece"))


def score_report(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision, Brier, log-loss, ECE, n and positive rate per key.

    Ranks and bins share nothing but the input; single-class cohorts get null metrics.
    """
    keys = list(keys)
    y, p = _d(label), F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), _d(score)))
    clipped = df.filter(F.col(label).isNotNull()).select(*keys, F.col(label), p.alias("_p"))
    point = clipped.groupBy(*keys).agg(
        F.avg((F.col("_p") - y) * (F.col("_p") - y)).alias("brier"),
        (-F.avg(F.when(F.col(label) == 1, F.log("_p")).otherwise(F.log(1.0 - F.col("_p"))))).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("positive_rate"),
        F.sum(F.col(label)).cast("long").alias("_m"),
    )
    # Each score knows its key's totals, so what lies above it needs no join.
    up_pos, up_neg = _d("pos_all") - _d("pos_below"), _d("neg_all") - _d("neg_below")
    ranks = score_table(clipped, label, "_p", keys).groupBy(*keys).agg(
        F.sum(F.try_divide(_d("pos"), _d("pos_all")) * (up_pos / (up_pos + up_neg))).alias("_ap"),
        F.sum(F.try_divide(F.try_divide(_d("pos"), _d("pos_all")) * (_d("neg_below") + _d("neg") / 2.0), _d("neg_all"))).alias("_auc"),
    )
    binned = ece(clipped, label, "_p", keys)
    both = (F.col("_m") > 0) & (F.col("_m") < F.col("n"))
    if keys:
        out = point.join(ranks, keys, "left").join(binned, keys, "left")
    else:
        out = point.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(binned))
    return out.select(
        *keys,
        F.when(both, F.col("_auc")).alias("auc"),
        F.when(both, F.col("_ap")).alias("pr_auc"),
        *[F.when(both, F.col(c)).alias(c) for c in ("brier", "log_loss", "ece")],
        "n",
        "positive_rate",
    )


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and flagged share at each threshold that flags anything.

    Rows are counted once by how many thresholds they reach (at most one more group than
    there are thresholds); only these few counts meet the threshold grid.
    """
    y = F.col(label)
    reached = sum(((F.col(score) >= t).cast("int") for t in thresholds), F.lit(0))
    counts = (
        df.filter(y.isNotNull())
        .groupBy(reached.alias("reached"))
        .agg(F.sum((y == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    )
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(thresholds))]))
    flagged = F.col("reached") > F.col("g.i")
    out = counts.select("*", grid.alias("g")).groupBy("g.threshold").agg(
        F.sum(F.when(flagged, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(flagged, F.col("all")).otherwise(0)).alias("flagged"),
        F.sum("pos").alias("positives"),
        F.sum("all").alias("n"),
    )
    precision, recall = F.col("tp") / F.col("flagged"), F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0))
    return out.filter("flagged > 0").select(
        "threshold",
        precision.alias("precision"),
        recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        (F.col("flagged") / F.col("n")).alias("flagged_share"),
    )


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the largest F1; the lowest threshold wins a tie."""
    best = F.max_by(F.struct(*sweep.columns), F.struct(F.col("f1"), -F.col("threshold"))).alias("b")
    return sweep.agg(best).select("b.*")


def decide(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.withColumn("decision", (F.col(score) >= threshold).cast("int"))


def history_band(history: str = "n_snapshots", strata: Sequence[tuple[int, int]] = STRATA) -> Column:
    """The name of the band that a history length lies in, or null."""
    band = None
    for low, high in strata:
        inside = F.col(history).between(low, high)
        band = F.when(inside, f"{low}-{high}") if band is None else band.when(inside, f"{low}-{high}")
    return band


def auc_strata(df: DataFrame, label: str, score: str, history: str = "n_snapshots", strata: Sequence[tuple[int, int]] = STRATA) -> DataFrame:
    """AUC within bands of history length."""
    banded = df.withColumn("stratum", history_band(history, strata)).filter("stratum is not null")
    measured = auc(banded, label, score, ["stratum"], constant_null=False)
    names = _named_rows(df, "stratum", [f"{low}-{high}" for low, high in strata])
    n = F.coalesce(F.col("positives") + F.col("negatives"), F.lit(0))
    return names.join(measured, "stratum", "left").select(
        "stratum", n.alias("n"), F.try_divide(F.col("positives"), n).alias("positive_rate"), "auc"
    )


def _named_rows(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row per fixed name, so that empty groups show up."""
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")


def auc_cohorts(df: DataFrame, label: str, scores: Sequence[str], months_left: str = "months_to_revised_date") -> DataFrame:
    """AUC of each score in overlapping cohorts of time left to the declared date.

    Few rows or a single class give null AUCs, as does a score that is constant there.
    """
    left = F.col(months_left)
    names = [
        F.when((left <= 0) if edge is None else (left > edge), name) for name, edge in COHORTS.items()
    ]
    cohorts = df.filter(F.col(label).isNotNull()).withColumn("cohort", F.explode(F.array_compact(F.array(*names))))
    stacked = cohorts.select(
        "cohort", label,
        F.explode(F.array(*[F.struct(F.lit(s).alias("model"), _d(s).alias("score")) for s in scores])).alias("x"),
    ).select("cohort", label, "x.model", "x.score")
    measured = auc(stacked, label, "score", ["cohort", "model"])
    size = F.max(F.col("positives") + F.col("negatives"))
    enough = F.coalesce((size >= MIN_COHORT) & (F.max("positives") > 0) & (F.max("negatives") > 0), F.lit(False))
    every = _named_rows(df, "cohort", list(COHORTS)).join(measured, "cohort", "left")
    return every.groupBy("cohort").agg(
        F.coalesce(size, F.lit(0)).alias("n"),
        (F.max("positives") / size).alias("positive_rate"),
        F.when(enough, "ok").otherwise("insufficient_or_single_class").alias("status"),
        *[F.when(enough, F.max(F.when(F.col("model") == s, F.col("auc")))).alias(f"auc_{s}") for s in scores],
    )


def cohort_verdict(cohorts: DataFrame, model: str, rule: str) -> DataFrame:
    """What the not-yet-overdue cohort says about model against deadline rule."""
    a, b = F.round(f"auc_{model}", 4), F.round(f"auc_{rule}", 4)
    margin = F.round(a - b, 4)
    verdict = (
        F.when(a.isNull(), "not evaluable")
        .when(b.isNull(), "rule constant")
        .when(margin >= 0.05, "model ahead")
        .when(margin > 0, "model slightly ahead")
        .otherwise("model not ahead")
    )
    return cohorts.filter("cohort = 'not_yet_overdue'").select(
        "cohort", "n", a.alias("auc_model"), b.alias("auc_rule"), margin.alias("margin"), verdict.alias("verdict")
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, taus: dict[float, str] | None = None) -> DataFrame:
    """RMSE, MAE, R² (0 without variance) and pinball loss for given quantile columns."""
    taus = taus or {}
    if any(not 0.0 < t < 1.0 for t in taus):
        raise ValueError("a quantile level must lie in (0, 1)")
    y, e = _d(actual), _d(actual) - _d(predicted)
    pinball = [
        F.avg(F.greatest((y - _d(q)) * t, (y - _d(q)) * (t - 1.0))).alias(f"pinball_{t:.2f}".replace(".", "_"))
        for t, q in taus.items()
    ]
    total = F.var_pop(y)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(total == 0, 0.0).otherwise(1.0 - F.avg(e * e) / total).alias("r_squared"),
        *pinball,
    )


def prediction_health(assessed: DataFrame, p: str = "p_model") -> DataFrame:
    """Spread of the probability and number of populated tiers; a collapsed model shows here."""
    return assessed.agg(
        F.min(p).alias("p_min"),
        F.max(p).alias("p_max"),
        (F.max(p) - F.min(p)).alias("p_spread"),
        F.countDistinct("risk_tier").alias("tiers_populated"),
    )
