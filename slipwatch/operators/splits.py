"""Train and test splits, class weights, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators.radix import middles
from slipwatch.operators.skew import join_attributes


def assert_no_leakage(features: Sequence[str]) -> None:
    """Columns that repeat the outcome are refused, not zeroed later."""
    bad = sorted(set(features) & set(S.LEAKING_COLUMNS))
    if bad:
        raise ValueError(f"columns that leak the outcome: {bad}")


def labelled(panel: DataFrame, label: str) -> DataFrame:
    """Rows whose outcome is known at this horizon."""
    return panel.filter(F.col(label).isNotNull())


def censor_counts(panel: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Known and censored rows per label."""
    counts = panel.agg(F.count(F.lit(1)).alias("all"), *[F.count(x).alias(x) for x in labels], *[F.sum(x).alias(f"{x}_pos") for x in labels])
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("labelled"), (F.col("all") - F.col(x)).alias("censored"), F.col(f"{x}_pos").alias("positives")) for x in labels])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def fold(k: int = 5, key: str = "project_id") -> Column:
    """Fold of a project by a digest that other engines know too: stable, one project in one fold."""
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint")
    return F.pmod(digits, F.lit(k)).cast("int")


def with_folds(df: DataFrame, k: int = 5) -> DataFrame:
    return df.withColumn("fold", fold(k))


def fold_sizes(df: DataFrame, k: int = 5) -> DataFrame:
    """Rows and projects per fold; hash folds are even only in the mean."""
    return with_folds(df, k).groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("project_id").alias("projects")
    )


def split_last(df: DataFrame) -> DataFrame:
    """`is_test` marks each project's last transition.

    The last position per project is found by a grouped maximum; only that one number per
    project goes back to the rows, and projects with very many rows are split on the way.
    """
    last = df.groupBy("project_id").agg(F.max("seq_index").alias("_last"))
    return join_attributes(df, last, "project_id", "seq_index").withColumn("is_test", (F.col("seq_index") == F.col("_last")).cast("int")).drop("_last")


def split_out_of_time(df: DataFrame, test_months: int = 3) -> DataFrame:
    """`is_test` marks the newest months. The cutoff is one row, found over distinct months."""
    months = df.select("as_of_month").distinct()
    newest = Window.orderBy(F.desc("as_of_month"))
    # Distinct months are bounded by the calendar, so one task can rank them.
    cutoff = months.withColumn("_r", F.row_number().over(newest)).agg(
        F.max(F.when(F.col("_r") == test_months, F.col("as_of_month"))).alias("_cutoff"),
        F.count(F.lit(1)).alias("_months"),
    )
    return df.crossJoin(F.broadcast(cutoff)).withColumn(
        "is_test", (F.col("as_of_month") >= F.col("_cutoff")).cast("int")
    )


def out_of_time_report(df: DataFrame, label: str, test_months: int = 3) -> DataFrame:
    """Sizes, rates and class weight of the calendar split, and whether it may be run."""
    split = split_out_of_time(labelled(df, label), test_months)
    test, y = F.col("is_test") == 1, F.col(label)
    out = split.agg(
        F.max("_cutoff").alias("cutoff"),
        F.max("_months").alias("months"),
        F.count_if(F.col("time_axis") != "observed").alias("_loose"),
        F.count_if(~test).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.countDistinct(F.when(~test, F.col("project_id"))).alias("train_projects"),
        F.countDistinct(F.when(test, F.col("project_id"))).alias("test_projects"),
        F.coalesce(F.sum(F.when(~test, y)), F.lit(0)).alias("_train_pos"),
        F.coalesce(F.sum(F.when(test, y)), F.lit(0)).alias("_test_pos"),
    )

    def single(pos: str, n: str) -> Column:
        return (F.col(pos) == 0) | (F.col(pos) == F.col(n))

    status = (
        F.when(F.col("_loose") > 0, "unavailable_reconstructed_axis")
        .when(F.col("months") < test_months + 3, "unavailable_few_months")
        .when(single("_train_pos", "n_train"), "unavailable_single_class_train")
        .when(single("_test_pos", "n_test"), "unavailable_single_class_test")
        .otherwise("ok")
    )
    return out.select(
        status.alias("status"),
        "cutoff",
        "n_train",
        "n_test",
        "train_projects",
        "test_projects",
        F.try_divide("_train_pos", "n_train").alias("train_positive_rate"),
        F.try_divide("_test_pos", "n_test").alias("test_positive_rate"),
        ((F.col("n_train") - F.col("_train_pos")) / F.greatest(F.lit(1), F.col("_train_pos"))).alias("positive_weight"),
    )


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column as (feature, median), by radix selection: four scans of `df`, which should be stored."""
    found = middles(df, columns)
    rows = [(c, low + (high - low) * 0.5) for c, (low, high) in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, median double")


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians of the columns that have gaps in the training rows (one number per column)."""
    gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    gappy = [c for c in columns if gaps[c]]
    if not gappy:
        return {}
    return {r["feature"]: r["median"] for r in medians(train, gappy).collect()}


def prior_scores(train: DataFrame, rows: DataFrame, label: str, name: str = "prior") -> DataFrame:
    """The training positive rate as a constant score."""
    rate = train.filter(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double")).alias(name))
    return rows.crossJoin(F.broadcast(rate))
