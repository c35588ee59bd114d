import pytest
from pyspark.sql import functions as F

from slipwatch.operators import metrics as M
from slipwatch.operators import models as Mo
from slipwatch.operators import splits as Sp

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda s: (F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(1000)) / 1000.0)
    df = spark.range(3000).select(
        (F.col("id") % 150).alias("project_id"),
        F.floor(F.col("id") / 150).cast("int").alias("seq_index"),
        noise(1).alias("a"),
        F.when(F.col("id") % 29 != 0, noise(2)).alias("b"),
        noise(3).alias("u"),
        F.lit(20).alias("n_snapshots"),
        F.concat(F.lit("2025-"), F.lpad((F.floor(F.col("id") / 150) % 12 + 1).cast("string"), 2, "0")).alias("as_of_month"),
        F.lit("observed").alias("time_axis"),
        (noise(4) * 20 - 5).alias("months_to_revised_date"),
    )
    p = F.lit(0.1) + F.col("a") * 0.6
    return df.withColumn("slip_next", (F.col("u") < p).cast("int")).drop("u").cache()


def auc_of(df, name):
    return M.auc(df, "slip_next", name).first()["auc"]


def test_folds_are_disjoint_and_stable(rows):
    folds = Sp.with_folds(rows)
    assert folds.groupBy("project_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.repartition(7).groupBy("fold").count().orderBy("fold").collect() == folds.groupBy("fold").count().orderBy("fold").collect()
    assert Sp.fold_sizes(rows).agg(F.sum("rows")).first()[0] == 3000


def test_medians_ignore_gaps_and_come_from_train(rows):
    got = {r["feature"]: r["median"] for r in Sp.medians(rows, FEATURES).collect()}
    exact = rows.agg(F.percentile("a", 0.5).alias("a"), F.percentile("b", 0.5).alias("b")).first().asDict()
    assert got == pytest.approx(exact)
    assert set(Sp.fit_medians(rows, FEATURES)) == {"b"}


@pytest.mark.parametrize("fit", [Mo.fit_logit, Mo.fit_hazard, lambda t, f, y: Mo.fit_gbt(t, f, y, trees=5)])
def test_models_beat_the_prior(rows, fit):
    train, test = rows.filter("project_id < 100"), rows.filter("project_id >= 100")
    scorer = fit(train, FEATURES, "slip_next")
    scored = scorer(test)
    assert auc_of(scored, scorer.name) > 0.65
    assert scored.filter(F.col(scorer.name).isNull() | ~F.col(scorer.name).between(0, 1)).count() == 0


def test_leaks_are_refused(rows):
    with pytest.raises(ValueError):
        Mo.grouped_cv(rows, Mo.select_candidates(["prior"]), ["a", "slip_next"])


def test_grouped_scores_cover_every_row_once(rows):
    scores = Mo.grouped_cv(rows, Mo.select_candidates(["prior", "logit"]), FEATURES, folds=3)
    assert scores.count() == 3000 == scores.select("project_id", "seq_index").distinct().count()
    table = {r.model: r.auc for r in Mo.compare(scores, ["prior", "logit"]).collect()}
    assert table["logit"] > table["prior"]


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_lowers_the_error(rows, method, monkeypatch):
    if method == "sigmoid":
        monkeypatch.setattr(Mo, "MIN_ISOTONIC_POSITIVES", 10**9)
    out, shipped, report = Mo.cross_fit_calibration(rows, "a", folds=3)
    assert report["method"] == method and report["kept"] and shipped is not None
    assert report["ece_after"] < report["ece_before"]
    assert out.count() == 3000


def test_bad_calibrator_is_discarded(rows):
    perfect = rows.withColumn("p", F.col("slip_next").cast("double"))
    _, shipped, report = Mo.cross_fit_calibration(perfect, "p", folds=3)
    assert report["ece_before"] == 0.0 and report["kept"] == (shipped is not None)
    # Held-out projects contradict the others, so what is learned makes their error worse.
    odd = F.pmod(F.col("fold"), F.lit(2))
    torn = Sp.with_folds(rows, 3).withColumn("p", F.lit(0.5) + F.col("a") * 0.0).withColumn("slip_next", odd.cast("int"))
    half = torn.groupBy("slip_next").count().collect()
    assert len(half) == 2
    _, shipped, report = Mo.cross_fit_calibration(torn.drop("fold"), "p", folds=3)
    assert report["ece_after"] > report["ece_before"] and not report["kept"] and shipped is None


def test_calibrator_sees_scores_as_they_are(rows):
    close = rows.withColumn("p", F.col("a") * 1e-8)
    cal = Mo.fit_calibrator(close, "p", "slip_next", "isotonic")
    assert cal(close, "p", "c").select("c").distinct().count() > 5
    assert Mo.fit_calibrator(close, "p", "slip_next", "isotonic", decimals=6)(close, "p", "c").select("c").distinct().count() == 1


def test_splits(rows):
    last = Sp.split_last(rows)
    assert last.filter("is_test = 1").count() == 150
    report = Sp.out_of_time_report(rows, "slip_next").first()
    assert report.status == "ok" and report.n_train + report.n_test == 3000 and report.cutoff == "2025-10"
    assert Sp.out_of_time_report(rows.withColumn("time_axis", F.lit("reconstructed")), "slip_next").first().status == "unavailable_reconstructed_axis"
    assert Sp.out_of_time_report(rows.filter("as_of_month < '2025-05'"), "slip_next").first().status == "unavailable_few_months"
    assert Sp.out_of_time_report(rows.withColumn("slip_next", F.lit(0)), "slip_next").first().status == "unavailable_single_class_train"


def test_horizon_evaluation(rows):
    names = ["prior", "logit", "hazard"]
    models = Mo.select_candidates(names)
    panel = rows.withColumn("deadline_continuous", F.lit(0.5))
    out = Mo.evaluate_horizon(panel, "slip_next", FEATURES, models, folds=2, proposed="logit")
    assert out["status"] == "ok" and out["rows_labelled"] == 3000
    assert {r.model for r in out["grouped"].collect()} == set(names)
    assert out["out_of_time"].count() == 3 and out["threshold"].count() == 1
    assert {r.baseline for r in out["grouped_delong"].collect()} == {"prior", "hazard"}
    assert Mo.linear_terms(out["model"], FEATURES)["a"] > 0
    report = {(r.split, r.model, r.stratum): r.n for r in out["report"].collect()}
    assert {k[0] for k in report} == {"grouped", "last", "out_of_time"} and report["grouped", "logit", "all"] == 3000
    assert out["lead_time"].count() == 6 and out["importances"] == []
    assert out["served"](rows).columns[-1] in ("calibrated", "logit")
    small = Mo.evaluate_horizon(panel.limit(150), "slip_next", FEATURES, models)
    assert small == {"status": "insufficient_rows", "rows_available": 150}
    gbt = Mo.fit_gbt(rows, FEATURES, "slip_next", trees=3)
    assert Mo.importances(gbt, FEATURES)[0][0] == "a"


def test_horizons_are_served_together(rows):
    from slipwatch.operators import serving as Sv

    logit = Mo.select_candidates(["logit"])[0]
    one = Sv.fit_horizon(rows, 1, "slip_next", logit, FEATURES, folds=2)
    assert 0.05 <= one.threshold <= 0.95 and one.report["method"] in ("isotonic", "sigmoid")
    flat = Sv.Horizon(3, lambda df: df.withColumn("low", F.lit(0.2)), "low", None, 0.5)
    out = Sv.score_horizons(rows.drop("b").withColumn("b", F.lit(None).cast("double")), [one, flat])
    assert out.filter("p_3m < p_1m or p_3m < 0.2").count() == 0
    assert out.filter("lifted_3m <> cast(p_1m > 0.2 + 1e-9 as int)").count() == 0
    assert out.filter("decision_3m <> cast(p_3m >= 0.5 as int)").count() == 0
    assert not [c for c in out.columns if c.startswith("_own") or c in ("logit", "low")]


def test_folds_are_fitted_side_by_side(rows):
    """Each fit waits for another one, so fits one after the other would break the barrier."""
    from threading import Barrier

    meet = Barrier(2, timeout=60)

    def fit(train, features, label):
        meet.wait()
        return Mo.fit_prior(train, features, label, "waiting")

    scores = Mo.grouped_cv(rows, [Mo.Candidate("waiting", fit)], FEATURES, folds=4)
    assert scores.count() == 3000 and scores.filter("waiting is null").count() == 0


def test_a_fit_runs_in_few_tasks(rows):
    many = rows.repartition(64)
    assert Mo.fit_tasks(many, 3000) == 1
    assert Mo.fit_tasks(many, 10**9) == rows.sparkSession.sparkContext.defaultParallelism


def test_orderings_share_the_typed_records(spark, monkeypatch):
    from slipwatch.operators import clean as K
    from slipwatch.operators import panel as P
    from slipwatch.plans import inputs as I

    made, old = [], K.dedupe
    monkeypatch.setattr(K, "dedupe", lambda *a, **k: made.append(1) or old(*a, **k))
    raw = I.raw(spark, "/root/testdata/sf0.001").withColumn("report_month", F.lit(None).cast("string"))
    prior = Mo.select_candidates(["prior"])[0]
    got = {r.ordering: (r.positives, r.negatives) for r in Mo.ordering_auc(raw, prior, folds=2).collect()}
    assert len(made) == 1 and got
    for name, counts in got.items():
        own = Sp.labelled(P.build_panel(raw, order=name).filter("order_reliable = 1"), "slip_next")
        n, pos = Mo._class_counts(own, "slip_next")
        assert counts == (pos, n - pos)
