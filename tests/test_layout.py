"""Layouts of stored tables, and the stacked report."""

import uuid

import pytest
from pyspark.sql import functions as F

from slipwatch.operators import metrics as M
from slipwatch.operators import report as Rp
from slipwatch.session import scratch
from slipwatch.sources import layout as L
from slipwatch.sources import writers as Wr


def scanned(df):
    """Rows that the file scan of a plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getName():
            return node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    raise AssertionError(plan.toString())


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rows = spark.range(60_000).select(F.concat(F.lit("SUP-"), F.pmod(F.col("id") * 7, F.lit(3000)).cast("string")).alias("project_id"), F.col("id").alias("seq_index"))
    spark.conf.set("parquet.block.size", str(32 * 1024))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(32 * 1024))
    try:
        L.write_clustered(rows, str(tmp_path / "t"), "project_id", ["seq_index"])
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    found = L.lookup(spark, str(tmp_path / "t"), "project_id", "SUP-77")
    assert found.count() == 20 and "EqualTo(project_id,SUP-77)" in found._jdf.queryExecution().toString()
    assert 20 <= scanned(found) < 60_000 / 4
    # A value inside the range of a row group but in none of them: the Bloom filter tells.
    assert scanned(L.lookup(spark, str(tmp_path / "t"), "project_id", "SUP-77x")) == 0


def test_scores_join_without_a_shuffle(spark):
    names = [f"scores_{uuid.uuid4().hex}" for _ in range(3)]
    base = spark.range(2000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("project_id"), F.col("id").alias("seq_index"))
    try:
        for i, name in enumerate(names):
            Wr.write_scores(base.withColumn(f"m{i}", F.col("seq_index") * (i + 1.0)), name, buckets=4)
        joined = L.side_by_side(spark, names)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2000 and joined.filter("m1 <> 2 * m0 or m2 <> 3 * m0").count() == 0
        sizes = [r["count"] for r in spark.table(names[0]).groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) < 800  # one project holds 1500 rows
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stacked_report_equals_one_report_a_group(spark):
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y"), (F.pmod(F.col("id") * 31, F.lit(97)) / 97).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) / 5).alias("b"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "z").alias("s"),
    )
    odd = spark.createDataFrame([(1, 0.2, 0.4, "one class"), (None, 0.1, 0.1, "x")], "y int, a double, b double, s string")
    rows = rows.unionByName(odd)
    got = {(r.split, r.model, r.stratum): r for r in Rp.stacked_report(Rp.stack({"p": rows, "q": rows.filter("a > 0.5")}, ["a", "b"], "y", "s")).collect()}
    assert set(got) == {(p, m, s) for p in "pq" for m in "ab" for s in ("all", "x", "z")} | {("p", "a", "one class"), ("p", "b", "one class")}
    for (split, model, stratum), r in got.items():
        own = rows if split == "p" else rows.filter("a > 0.5")
        own = own if stratum == "all" else own.filter(F.col("s") == stratum)
        want = M.score_report(own, "y", model).first()
        assert r.n == want.n and r.positive_rate == pytest.approx(want.positive_rate)
        if want.auc is None:
            assert r.auc is None and r.pr_auc is None
        else:
            assert [r.auc, r.pr_auc, r.brier, r.log_loss] == pytest.approx([want.auc, want.pr_auc, want.brier, want.log_loss])


def test_scratch_folders_go(spark, tmp_path):
    with scratch(spark) as folder:
        spark.range(3).write.parquet(f"{folder}/x")
        kept = spark.read.parquet(f"{folder}/x").count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{folder}/x").count()
    assert kept == 3
