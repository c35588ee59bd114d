"""One evaluation of all models, splits and strata, from scores that are written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch.operators import metrics as M

ALL = "all"
KEYS = ["split", "model", "stratum"]


def stack(frames: dict[str, DataFrame], names: Sequence[str], label: str, stratum: str) -> DataFrame:
    """(split, model, stratum, label, score) of the scored frames, one a split; rows without a label are left out."""
    out = None
    for split, df in frames.items():
        pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("score")) for n in names])
        part = (
            df.filter(F.col(label).isNotNull())
            .select(F.lit(split).alias("split"), F.col(stratum).cast("string").alias("stratum"), F.col(label).alias("label"), F.explode(pairs).alias("_x"))
            .select("split", "_x.model", "stratum", "label", "_x.score")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _metrics() -> list:
    """Metrics of a group of distinct scores with their counts above and below."""
    both = (F.col("pos_all") > 0) & (F.col("neg_all") > 0)
    up = F.col("pos_all") - F.col("pos_below")
    above = up + F.col("neg_all") - F.col("neg_below")
    n = F.sum(F.col("pos") + F.col("neg"))
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("score")))
    return [
        F.sum(F.when(both, F.try_divide(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0), F.col("pos_all") * F.col("neg_all")))).alias("auc"),
        F.sum(F.when(both, F.try_divide("pos", "pos_all") * (up / above))).alias("pr_auc"),
        (F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / n).alias("brier"),
        (-F.sum(F.col("pos") * F.log(p) + F.col("neg") * F.log(1.0 - p)) / n).alias("log_loss"),
        n.alias("n"),
        (F.sum("pos") / n).alias("positive_rate"),
    ]


def stacked_report(stacked: DataFrame) -> DataFrame:
    """AUC, average precision, Brier, log-loss, rows and rate by split and model, for all rows and each stratum.

    Equal scores are counted once; the two grouping sets are made of these counts, and all
    groups are ranked and measured in one plan. A missing stratum counts under "all" only.
    """
    score = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("score")))
    counts = stacked.filter(F.col("score").isNotNull()).groupBy(*KEYS, "label", score.alias("score")).agg(F.count(F.lit(1)).alias("w"))
    sets = F.explode(F.array_compact(F.array(F.lit(ALL), F.col("stratum")))).alias("stratum")
    table = M.score_table(counts.select("split", "model", sets, "label", "score", "w"), "label", "score", KEYS, "w")
    return table.groupBy(*KEYS).agg(*_metrics())
