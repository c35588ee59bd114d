"""Rank statistics against brute force over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from slipwatch.functions.stats import two_sided_p
from slipwatch.operators import backtest as B
from slipwatch.operators import diagnostics as Dg
from slipwatch.operators import metrics as M
from slipwatch.operators.ranked import quantiles, ranked


def sample(n=300, seed=3, tied=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.3)
        a = r.gauss(0.4 + 0.15 * y, 0.2)
        b = r.gauss(0.4 + 0.05 * y, 0.2)
        rows.append((i, y, round(min(1.0, max(0.0, a)), 2 if tied else 12), round(min(1.0, max(0.0, b)), 1)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "i int, y int, a double, b double")


def psi(x, z):
    return 1.0 if x > z else 0.5 if x == z else 0.0


def brute_auc(rows, k):
    pos, neg = [r[k] for r in rows if r[1] == 1], [r[k] for r in rows if r[1] == 0]
    return sum(psi(x, z) for x in pos for z in neg) / len(pos) / len(neg)


def brute_delong(rows):
    pos, neg = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0]
    v10 = [[sum(psi(x[k], z[k]) for z in neg) / len(neg) for x in pos] for k in (2, 3)]
    v01 = [[sum(psi(x[k], z[k]) for x in pos) / len(pos) for z in neg] for k in (2, 3)]

    def cov(u, v):
        mu, mv = sum(u) / len(u), sum(v) / len(v)
        return sum((x - mu) * (z - mv) for x, z in zip(u, v)) / (len(u) - 1)

    var = [cov(v10[k], v10[k]) / len(pos) + cov(v01[k], v01[k]) / len(neg) for k in (0, 1)]
    both = cov(v10[0], v10[1]) / len(pos) + cov(v01[0], v01[1]) / len(neg)
    z = (brute_auc(rows, 2) - brute_auc(rows, 3)) / math.sqrt(var[0] + var[1] - 2 * both)
    return z, math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize("tied", [True, False])
def test_auc(spark, tied):
    rows = sample(tied=tied)
    df = frame(spark, rows)
    assert M.auc(df, "y", "a").first()["auc"] == pytest.approx(brute_auc(rows, 2), abs=1e-12)
    flipped = M.auc(df.withColumn("a", 1 - F.col("a")), "y", "a").first()["auc"]
    assert flipped == pytest.approx(1 - brute_auc(rows, 2), abs=1e-12)


def test_auc_is_null_without_both_classes_or_without_spread(spark):
    one = spark.createDataFrame([(1, 0.1), (1, 0.2)], "y int, a double")
    flat = spark.createDataFrame([(1, 0.1), (0, 0.1)], "y int, a double")
    assert M.auc(one, "y", "a").first()["auc"] is None
    assert M.auc(flat, "y", "a").first()["auc"] is None
    assert M.auc(flat, "y", "a", constant_null=False).first()["auc"] == 0.5


def test_ranks_over_signs_and_scales(spark):
    values = [0.0, -0.0, 1e-300, 5e-324, -2.5, -2.4999999999999996, 7.999999999999999, 8.0, 8.000000000000002, 1e300, -1e-9, 0.1, 0.1, 1024.0, 1023.9999999999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: (r["n_below"], r["n_all"]) for r in ranked(df, "v", {"n": F.lit(1)}).collect()}
    assert got == {v + 0.0: (sum(1 for w in values if w < v), len(values)) for v in values}


def test_ranks_of_concentrated_scores(spark):
    base = 0.179
    df = spark.range(3000).select((F.lit(base) + (F.col("id") * 7919 % 3000) * 2.0**-52).alias("v"))
    rows = sorted(ranked(df, "v", {"n": F.lit(1)}).collect(), key=lambda r: r.v)
    below = 0
    for r in rows:
        assert r.n_below == below
        below += r.n
    assert below == 3000


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, 5.0)], "k int, v double")
    got = {r.k: (r.q1, r.q2, r.q3) for r in quantiles(df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["k"]).collect()}
    assert got == {1: (1.75, 2.5, 4.75), 2: (5.0, 5.0, 5.0)}


def test_delong_against_all_pairs(spark):
    rows = sample()
    got = M.delong(frame(spark, rows), "y", "a", "b").first()
    z, p = brute_delong(rows)
    assert got["z"] == pytest.approx(z, rel=1e-9)
    assert got["p_value"] == pytest.approx(p, rel=1e-9)


def test_delong_of_identical_scores(spark):
    df = frame(spark, sample()).withColumn("b", F.col("a"))
    got = M.delong(df, "y", "a", "b").first()
    assert (got["z"], got["p_value"]) == (0.0, 1.0)


def test_delong_all_names_constants(spark):
    df = frame(spark, sample()).withColumn("c", F.lit(0.3))
    got = {r.baseline: r for r in M.delong_all(df, "y", "a", ["b", "c"]).collect()}
    assert got["c"].status == "constant" and got["c"].z is None
    assert got["b"].z == pytest.approx(brute_delong(sample())[0], rel=1e-9)


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.96, 2.82, 2.83, 5.0, 12.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p in df.select("z", two_sided_p(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-11)


def test_report_matches_definitions(spark):
    rows = sample()
    got = M.score_report(frame(spark, rows), "y", "a").first()
    p = [(min(1 - 1e-6, max(1e-6, r[2])), r[1]) for r in rows]
    assert got.brier == pytest.approx(sum((a - y) ** 2 for a, y in p) / len(p))
    assert got.log_loss == pytest.approx(-sum(math.log(a if y else 1 - a) for a, y in p) / len(p))
    m, ap, seen = sum(y for _, y in p), 0.0, 0.0
    for t in sorted({a for a, _ in p}, reverse=True):
        tp, k = sum(y for a, y in p if a >= t), sum(1 for a, _ in p if a >= t)
        ap, seen = ap + (tp / m - seen) * tp / k, tp / m
    assert got.pr_auc == pytest.approx(ap)
    assert got.auc == pytest.approx(brute_auc(rows, 2))


def test_calibration_bins_are_right_open(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.0999), (1, 1.0), (1, 0.9), (0, 0.3)], "y int, a double")
    bins = {r.bin: r.n for r in M.calibration_bins(df, "y", "a").collect()}
    assert bins == {1: 1, 0: 1, 9: 2, 2: 1}


def test_threshold_sweep_and_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.6), (0, 0.2)], "y int, a double")
    sweep = {round(r.threshold, 2): r for r in M.threshold_sweep(df, "y", "a").collect()}
    assert sweep[0.6].precision == pytest.approx(2 / 3) and sweep[0.6].recall == 1.0
    assert 0.95 not in sweep and sweep[0.05].flagged_share == 1.0
    assert M.best_threshold(M.threshold_sweep(df, "y", "a")).first().threshold == pytest.approx(0.25)


def test_strata_and_cohorts(spark):
    rows = [(i, i % 2, (i % 7) / 7, float(i % 9 - 3), 2 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, y int, a double, months_to_revised_date double, n_snapshots int")
    strata = {r.stratum: r.n for r in M.auc_strata(df, "y", "a").collect()}
    assert strata == {"2-5": 160, "6-8": 40, "9-11": 0, "12-20": 0}
    got = {r.cohort: r for r in M.auc_cohorts(df.withColumn("flat", F.lit(0.1)), "y", ["a", "flat"]).collect()}
    assert got["already_overdue"].n == sum(1 for r in rows if r[3] <= 0)
    assert got["not_yet_overdue"].status == "ok" and got["not_yet_overdue"].auc_flat is None
    assert got["runway_over_6_months"].n == 0 and got["runway_over_6_months"].status.startswith("insufficient")


@pytest.mark.parametrize("a, b, want", [
    (0.80, 0.75, "model ahead"), (0.7601, 0.76, "model slightly ahead"), (0.76, 0.76, "model not ahead"),
    (None, 0.5, "not evaluable"), (0.7, None, "rule constant"),
])
def test_verdicts(spark, a, b, want):
    df = spark.createDataFrame([("not_yet_overdue", 90, a, b)], "cohort string, n int, auc_m double, auc_r double")
    assert M.cohort_verdict(df, "m", "r").first().verdict == want


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.5), (2.0, 1.0, 3.0), (4.0, 4.0, 4.0)], "y double, p double, q double")
    got = M.regression_metrics(df, "y", "p", {0.9: "q"}).first()
    assert got.rmse == pytest.approx(math.sqrt(1.25 / 3)) and got.mae == pytest.approx(0.5)
    assert got.pinball_0_90 == pytest.approx((0.45 + 0.1) / 3)
    assert M.regression_metrics(df.withColumn("y", F.lit(2.0)), "y", "p").first().r_squared == 0.0
    with pytest.raises(ValueError):
        M.regression_metrics(df, "y", "p", {1.0: "q"})


def scored(spark, projects):
    rows = [(pid, i, n, p, y) for pid, (n, steps) in projects.items() for i, (p, y) in enumerate(steps)]
    return spark.createDataFrame(rows, "project_id int, seq_index int, n_snapshots int, p double, slip_next int")


def test_lead_time_cases(spark):
    quiet, loud = (0.1, 0), (0.5, 0)
    df = scored(spark, {
        1: (8, [loud, quiet, quiet, quiet, quiet, (0.1, 1)]),         # lead 6
        2: (4, [quiet, quiet, (0.5, 1)]),                              # lead 1
        3: (8, [(0.1, 1), quiet, quiet, quiet, loud]),                 # lead -3, first row slips
        4: (4, [quiet, (0.1, 1)]),                                     # never alerted
        5: (3, [loud, (0.1, 1)]),                                      # lead 2, short window
        6: (4, [loud, quiet]),                                         # false alarm
        7: (4, [quiet, quiet]),
    })
    lead = B.lead_time(B.first_events(df, "p", levels=[0.5, 0.9]))
    half = lead.filter("level = 0.5").first()
    assert (half.slip_projects, half.never_alerted, half.left_censored, half.window_truncated) == (5, 1, 1, 1)
    assert half.median_lead == 1.5 and half.mean_lead == pytest.approx(1.5)
    assert (half.alert_precision, half.recall, half.false_alarm_rate) == (0.8, 0.8, 0.5)
    assert half.projects_flagged == 5 and half.projects_total == 7
    none = lead.filter("level = 0.9").first()
    assert none.median_lead is None and none.f1 == 0.0
    assert B.lead_best(lead).first().level == 0.5
    assert B.lead_best(B.lead_time(B.first_events(df.withColumn("slip_next", F.lit(0)), "p"))).count() == 0


def test_effect_size_bands_and_stage(spark):
    rows = [(i % 10, i % 3 == 0, float(i % 7), float(i % 5), 0.2 * (i % 4), float(i % 3), 1.0, 60.0 * (i % 3) - 60) for i in range(210)]
    df = spark.createDataFrame(rows, "project_id int, s boolean, schedule_pressure double, velocity_deficit double, progress_delta double, progress_velocity double, stall_streak double, spend_progress_gap double")
    df = df.withColumn("slip_next", F.col("s").cast("int")).withColumn("physical_progress", F.col("progress_delta") * 10)
    got = {r.indicator: r for r in Dg.effect_size(df).collect()}
    assert got["stall_streak"].cohens_d == 0.0 and got["stall_streak"].effect == "negligible"
    assert got["progress_velocity"].corroborates is None
    bands = {r.band: (r.n, r.slip_rate, r.inverted) for r in Dg.gap_bands(df).collect()}
    assert bands == {"behind": (70, 1.0, 1), "aligned": (70, 0.0, 1), "ahead": (70, 0.0, 1)}
    stage = {r.cohort: r.projects for r in Dg.stage_bias(df).collect()}
    assert stage == {"ever": 10}


def test_ordering_stability(spark):
    df = spark.createDataFrame([("expenditure_progress", 0.8), ("progress_first", 0.79), ("reversed", 0.6)], "ordering string, auc double")
    got = Dg.ordering_stability(df).first()
    assert (got.stability, got.control) == ("stable", "passed")


def test_delong_splits_a_score_of_few_values(spark):
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y"), F.pmod(F.col("id"), F.lit(2)).cast("double").alias("two"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4000)) / 4000.0).alias("many"),
    )
    plan = M.delong(rows, "y", "many", "two")
    assert plan.first()["positives"] + plan.first()["negatives"] == 4000
    assert "_part" in plan._jdf.queryExecution().toString()


def test_ranks_of_infinities_and_nan(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (1.0, inf, -inf, 1e308, -1e-300, 0.0, inf)], "s double")
    below = {r["s"]: r["n_below"] for r in ranked(df, "s", {"n": F.lit(1)}).collect()}
    assert below == {-inf: 0, -1e-300: 1, 0.0: 2, 1.0: 3, 1e308: 4, inf: 5}
    with pytest.raises(Exception, match="NaN has no rank"):
        ranked(spark.createDataFrame([(float("nan"),)], "s double"), "s", {"n": F.lit(1)}).collect()


@pytest.mark.parametrize("n", [1, 2, 7, 400, 401])
def test_medians_in_two_passes(spark, n):
    import statistics

    from slipwatch.operators.splits import medians

    r = random.Random(n)
    rows = [(r.choice([0.0, 1.0, r.gauss(0, 5)]), None if i % 3 else r.random(), 7.0) for i in range(n)]
    got = {x["feature"]: x["median"] for x in medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    for k, name in enumerate("abc"):
        values = [x[k] for x in rows if x[k] is not None]
        assert got.get(name) == pytest.approx(statistics.median(values))
