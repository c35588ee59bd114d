"""Isotonic steps for any number of scores: adjacent violators pooled in ranges, then across borders.

Rows are first counted by distinct score. The scores are cut into ranges of about `range_rows`
and every task pools its own range in one pass, holding the steps so far. Steps of a range are
what is left of its scores; they are dealt to fewer and larger ranges and pooled again, until
one range holds all. Pooling has one result in whatever order it is done, so neither the ranges
nor a lost executor change it. Sums are whole numbers and means are compared by products, so
equal means are pooled exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch.session import cut_lineage

RANGE_ROWS = 200_000
FEWER = 16
STEP = ["lo", "hi", "positives", "rows"]
EMIT = 50_000


def score_counts(rows: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and rows of each distinct score (per key); rows without a score or a label are left out."""
    known = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    # Adding zero makes -0.0 and 0.0 one score.
    x = F.col(score).cast("double") + F.lit(0.0)
    return known.groupBy(*keys, x.alias("score")).agg(F.sum(F.col(label).cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"))


def _pool(keys: Sequence[str]):
    """Over rows sorted by key and `lo`: steps whose means rise strictly."""
    columns = [*keys, *STEP]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        steps: list[list] = []
        current = None
        for frame in frames:
            lists = [frame[c].tolist() for c in columns]
            for *key, lo, hi, positives, rows in zip(*lists):
                if key != current:
                    done += ((*current, *s) for s in steps) if current is not None else ()
                    steps, current = [], key
                while steps and steps[-1][2] * rows >= positives * steps[-1][3]:
                    last = steps.pop()
                    lo, positives, rows = last[0], positives + last[2], rows + last[3]
                steps.append([lo, hi, positives, rows])
            if len(done) >= EMIT:
                yield pd.DataFrame(done, columns=columns)
                done = []
        done += ((*current, *s) for s in steps) if current is not None else ()
        if done:
            yield pd.DataFrame(done, columns=columns)

    return run


def isotonic_steps(counts: DataFrame, keys: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, lo, hi, positives, rows, value): the isotonic fit to `score_counts`, one row a step."""
    keys = list(keys)
    steps = cut_lineage(counts.select(*keys, F.col("score").alias("lo"), F.col("score").alias("hi"), "positives", "rows"))
    parts = max(1, -(-steps.count() // range_rows))
    while True:
        ranges = steps.repartitionByRange(parts, *keys, "lo").sortWithinPartitions(*keys, "lo")
        steps = cut_lineage(ranges.mapInPandas(_pool(keys), steps.schema))
        if parts == 1:
            break
        # Full ranges stay full where nothing is pooled; then larger ranges are the only way on.
        parts = min(-(-parts // FEWER), -(-steps.count() // range_rows)) or 1
    return steps.withColumn("value", F.col("positives") / F.col("rows"))


def step_edges(steps: DataFrame) -> DataFrame:
    """(x, value, rows): both ends of every step, the points between which a fit is interpolated."""
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
    return steps.select(ends, "value", F.col("rows").cast("double").alias("rows"))


def other_folds(counts: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Counts by the fold they are held out from: every fold gets the sums of all others."""
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_held")
    return (
        counts.select("*", every).filter(F.col("_held") != F.col(fold))
        .groupBy(F.col("_held").alias(fold), "score").agg(F.sum("positives").alias("positives"), F.sum("rows").alias("rows"))
    )
