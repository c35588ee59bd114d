"""Isotonic pooling, radix medians, the hazard fit and sorted order against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipwatch.operators import clean as K
from slipwatch.operators import hazard as Hz
from slipwatch.operators import models as Mo
from slipwatch.operators import pooling as Po
from slipwatch.operators import radix
from slipwatch.operators import splits as Sp
from slipwatch.session import cut_lineage


def plain_pav(x, s, n):
    steps = []
    for a, p, k in zip(x, s, n):
        steps.append([a, a, p, k])
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
            last = steps.pop()
            steps[-1] = [steps[-1][0], last[1], steps[-1][2] + last[2], steps[-1][3] + last[3]]
    return [tuple(t) for t in steps]


def collected(steps):
    return sorted((r.lo, r.hi, r.positives, r.rows) for r in steps.collect())


def test_a_million_scores_pool_like_one_pass(spark):
    n = 1_000_000
    x = (F.col("id") + 0.5) / n
    rows = cut_lineage(spark.range(n).select(x.alias("p"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < x * x * 1000).cast("int").alias("y")))
    data = rows.toPandas().sort_values("p")
    want = plain_pav(data["p"].tolist(), data["y"].tolist(), [1] * n)
    steps = cut_lineage(Po.isotonic_steps(Po.score_counts(rows, "y", "p")))
    assert collected(steps) == want
    # What reaches the driver: the edges of steps, not the scores.
    edges = Po.step_edges(steps).count()
    assert edges <= 2 * len(want) < n / 500
    cal = Mo.step_calibrator(steps)
    probe = spark.createDataFrame([(0.0,), (want[3][0],), ((want[3][1] + want[4][0]) / 2,), (2.0,)], "p double")
    got = [r.c for r in cal(probe, "p", "c").collect()]
    mean = lambda t: t[2] / t[3]
    assert got == pytest.approx([mean(want[0]), mean(want[3]), (mean(want[3]) + mean(want[4])) / 2, mean(want[-1])])


@pytest.mark.parametrize("shape", ["rising", "falling", "flat", "noise"])
def test_pooling_does_not_depend_on_ranges(spark, shape):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(-3, 3, 4000), 3)
    y = {"rising": x > 0.2, "falling": x < 0.2, "flat": np.ones(len(x), bool), "noise": rng.random(len(x)) < 0.4}[shape].astype(int)
    rows = spark.createDataFrame([(int(i % 2), float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))] + [(0, None, 1), (1, 0.5, None)], "k int, p double, y int")
    counts = cut_lineage(Po.score_counts(rows, "y", "p", ["k"]))
    for size in (10**6, 300, 20):
        steps = Po.isotonic_steps(counts, ["k"], size)
        for k in (0, 1):
            own = sorted((r.score, r.positives, r.rows) for r in counts.filter(F.col("k") == k).collect())
            assert collected(steps.filter(F.col("k") == k)) == plain_pav(*zip(*own))


def test_pooling_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1)], "p double, y int")
    assert Po.isotonic_steps(Po.score_counts(rows, "y", "p")).count() == 0


def test_radix_medians(spark):
    rng = np.random.default_rng(4)
    n = 3001
    data = {
        "a": rng.normal(0, 1e-9, n), "b": rng.integers(-3, 4, n).astype(float), "c": np.where(rng.random(n) < 0.9, 5.0, rng.normal(0, 1e12, n)),
        "d": -np.exp(rng.uniform(-300, 300, n)), "e": np.where(rng.random(n) < 0.4, np.inf, -0.0), "f": 1 + rng.random(n) * 1e-12,
    }
    rows = [tuple(float(v[i]) if (i * 7 + j) % 9 else None for j, v in enumerate(data.values())) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*data, "nothing"]))
    got = {r.feature: r.median for r in Sp.medians(df, [*data, "nothing"]).collect()}
    want = {c: float(np.median([r[j] for r in rows if r[j] is not None])) for j, c in enumerate(data)}
    assert got == want
    low, high = radix.middles(df, ["a"])["a"]
    own = sorted(r[0] for r in rows if r[0] is not None)
    assert (low, high) == (own[(len(own) - 1) // 2], own[len(own) // 2])
    assert Sp.medians(df.limit(0), ["a"]).count() == 0
    with pytest.raises(Exception, match="NaN"):
        Sp.medians(spark.createDataFrame([(float("nan"),)], "a double"), ["a"])


def plain_hazard(x, y, penalty=1.0):
    """Newton's method on numeric differences of the objective alone."""
    z = (x - x.mean(0)) / x.std(0)
    d = np.column_stack([np.ones(len(z)), z])

    def loss(b):
        h = np.clip(1 - np.exp(-np.exp(np.clip(d @ b, -30, 30))), 1e-9, 1 - 1e-9)
        return -(y * np.log(h) + (1 - y) * np.log(1 - h)).sum() + penalty * (b[1:] ** 2).sum()

    b = np.zeros(d.shape[1])
    b[0] = np.log(-np.log(1 - y.mean()))
    e, k = 1e-4, len(b)
    unit = np.eye(k) * e
    for _ in range(30):
        g = np.array([(loss(b + u) - loss(b - u)) / (2 * e) for u in unit])
        h = np.array([[(loss(b + u + v) - loss(b + u - v) - loss(b - u + v) + loss(b - u - v)) / (4 * e * e) for u in unit] for v in unit])
        b = b - np.linalg.solve(h, g)
    return b


def test_hazard_equals_a_plain_fit(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(3, 2, 1500), rng.exponential(5, 1500), rng.integers(0, 2, 1500)])
    y = (rng.random(1500) < 1 - np.exp(-np.exp(-1.5 + 0.4 * x[:, 0] - 0.2 * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int").repartition(5)
    model = Hz.fit(cut_lineage(df), ["a", "b", "c"], "y")
    assert np.abs(np.array(model.coefficients) - plain_hazard(x, y)).max() < 1e-6
    scored = model(df).agg(F.min("hazard"), F.max("hazard"), F.avg("hazard")).first()
    assert 0 <= scored[0] < scored[1] <= 1 and scored[2] == pytest.approx(y.mean(), abs=0.02)


def test_a_large_logit_equals_a_plain_fit(spark, monkeypatch):
    """Beyond FEW rows: the optimum of the same objective, in few scans, as a model that scores like the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(300, 2, 1500), rng.exponential(5, 1500), rng.integers(0, 2, 1500), np.full(1500, 4.0)])
    x = np.column_stack([x, x[:, 0] + rng.normal(0, 0.05, 1500)])
    y = (rng.random(1500) < 1 / (1 + np.exp(-(x[:, 0] - 302) + 0.2 * x[:, 1]))).astype(int)
    names = ["a", "b", "c", "flat", "twin"]
    df = cut_lineage(spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y int").repartition(5))
    monkeypatch.setattr(Mo, "FEW", 100)
    spark.sparkContext.setJobGroup("logit", "logit")
    scorer = Mo.fit_logit(df, names, "y")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("logit")) < 60
    n, pos = len(y), int(y.sum())
    weight = F.when(F.col("y") == 1, n / 2 / pos).otherwise(n / 2 / (n - pos))
    plain = LogisticRegression(
        featuresCol="_raw", labelCol="y", weightCol="w", elasticNetParam=0.3, regParam=2 / n, standardization=True, maxIter=1500, tol=1e-14
    ).fit(VectorAssembler(inputCols=names, outputCol="_raw").transform(df.withColumn("w", weight)))
    got = scorer.model.stages[-1]
    assert np.abs(got.coefficients.toArray() - plain.coefficients.toArray()).max() < 1e-3
    assert got.coefficients[3] == 0 == plain.coefficients[3]

    def objective(model):
        b, b0 = model.coefficients.toArray(), model.intercept
        eta, w = x @ b + b0, np.where(y == 1, n / 2 / pos, n / 2 / (n - pos))
        mean = w @ x / n
        s = np.sqrt(w @ (x - mean) ** 2 / (n - w @ w / n)) * b
        return w @ (np.logaddexp(0, eta) - y * eta) / n + 2 / n * (0.3 * np.abs(s).sum() + 0.35 * (s * s).sum())

    assert objective(got) <= objective(plain) + 1e-12
    scores = [r.logit for r in scorer(df.orderBy("a")).collect()]
    assert scores == pytest.approx([r.p[1] for r in plain.transform(VectorAssembler(inputCols=names, outputCol="_raw").transform(df.orderBy("a"))).select(F.col("probability").alias("p")).collect()], abs=1e-3)
    assert scorer(df).columns == [*df.columns, "logit"] and Mo.linear_terms(scorer, names)["b"] < 0
    # One class is left to the other way; a gap without a median is refused as there.
    assert Mo.fit_logit(df.withColumn("y", F.lit(0)), names, "y")(df).agg(F.max("logit")).first()[0] == 0
    with pytest.raises(Exception, match="null"):
        Mo.fit_logit(df.withColumn("c", F.lit(None).cast("double")), names, "y")


def test_hazard_of_odd_columns(spark):
    """A constant column gets no weight, gaps take the median, one class still has a finite fit."""
    df = spark.createDataFrame([(float(i % 7) if i % 5 else None, 1.0, int(i % 7 > 4), 0) for i in range(300)], "a double, flat double, y int, none int")
    model = Mo.fit_hazard(df, ["a", "flat"], "y")
    assert model.medians == {"a": 3.0} and model.coefficients[2] == pytest.approx(0, abs=1e-9)
    assert model(df).filter("hazard is null").count() == 0
    calm = Mo.fit_hazard(df, ["a"], "none")
    assert np.isfinite(calm.coefficients).all() and calm(df).agg(F.max("hazard")).first()[0] < 0.01


def test_one_value_in_a_million_rows_is_spread(spark):
    """No task and no window holds more than a range, though the leading column is always the same."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(
        F.lit(1).alias("project_id"), F.lit(5.0).alias("expenditure"), F.lit(0.0).alias("physical_progress"),
        F.lit(None).cast("date").alias("revised_date"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("harvest_seq"),
    )
    kept = []

    def store(rows):
        kept.append(cut_lineage(rows))
        return kept[-1]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = K.sequence_sorted(df, store=store)
        assert out.filter("seq_index <> harvest_seq or n_snapshots <> 1000000").count() == 0 and out.count() == n
        sizes = [r["count"] for r in kept[0].groupBy("project_id", "_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == n and max(sizes) < n / 8


@pytest.mark.parametrize("order", K.ORDERINGS)
def test_sorted_order_equals_the_plain_one(spark, order):
    from test_panel import many_snapshots

    df = many_snapshots(spark)
    keys = ["project_id", "harvest_seq", "seq_index", "n_snapshots"]
    plain, placed = K.sequence(df, K.ordering(order)).select(*keys), K.sequence_sorted(df, order).select(*keys)
    assert plain.dtypes == placed.dtypes and sorted(plain.collect()) == sorted(placed.collect())


def test_stored_and_lazy_panels_agree(spark):
    from test_panel import raw, record

    from slipwatch.operators import panel as P

    rows = [record(spend=str(i * 3 % 50), progress=str(i % 40)) for i in range(50)] + [record(pid=2, month=f"2025-0{i}") for i in range(1, 9)]
    lazy, stored = P.build_panel(raw(spark, rows)), P.build_panel(raw(spark, rows), store=cut_lineage)
    assert lazy.dtypes == stored.dtypes
    key = lambda r: (r.project_id, r.seq_index)
    assert sorted(lazy.collect(), key=key) == sorted(stored.collect(), key=key)
