"""Exact ranks of a score without a sort in one task and without pairs.

The score axis is cut by a fixed rule into cells of cells: a cell is the binary exponent
with the first ten bits of the mantissa, a subcell adds twenty-one bits, and what is left
inside a subcell is at most about four million distinct doubles. Running counts are taken
over cells, over the subcells of a cell and over the scores of a subcell. So every window
below is bounded for any distribution of scores, however concentrated, and needs no
sampling, no statistics and no driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


END_CELL = 1 << 40  # the cell of infinity, above all others


def _cells(score: Column) -> tuple[Column, Column]:
    size = F.abs(score)
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent)
    sign = F.signum(score)
    cell = (exponent + 1100) * 4096 + F.floor(mantissa * 1024.0)
    subcell = F.floor(mantissa * 2147483648.0)
    zero, endless = score == 0.0, size == float("inf")
    odd = F.raise_error(F.lit("NaN has no rank: filter such scores out first")).cast("double")
    return (
        F.when(F.isnan(score), odd).when(zero, 0).when(endless, sign * END_CELL).otherwise(sign * cell).cast("long"),
        F.when(zero | endless, 0).otherwise(sign * subcell).cast("long"),
    )


def axis_cell(number: Column) -> Column:
    """The cell of a number; never falls with the number."""
    return _cells(number)[0]


def ranked(
    df: DataFrame,
    value: str,
    counts: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct value (per key): its counts and the counts of all smaller values.

    `counts` maps a name to a 0/1 (or whole number) column; the result has `name`,
    `name_below` and the key's total `name_all`. Rows with a null value are left out.
    """
    keys, names = list(keys), list(counts)
    value_col = F.col(value).cast("double")
    flat = (
        df.filter(F.col(value).isNotNull())
        # Adding zero makes -0.0 and 0.0 one value.
        .select(*keys, (value_col + F.lit(0.0)).alias(value), *[c.cast("long").alias(n) for n, c in counts.items()])
        .groupBy(*keys, value)
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    cell, subcell = _cells(F.col(value))
    flat = flat.withColumn("_cell", cell).withColumn("_sub", subcell)

    def sums(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])

    def below(by: list[str], order: str, suffix: str) -> list[Column]:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n + suffix) for n in names]

    subcells = sums(flat, keys + ["_cell", "_sub"])
    cells = sums(subcells, keys + ["_cell"])
    whole = keys
    if not keys:
        # Cells are bounded in number, so one task may run over all of them.
        cells, whole = cells.withColumn("_one", F.lit(1)), ["_one"]
    cell_offsets = cells.select(
        *keys,
        "_cell",
        *below(whole, "_cell", "_in_cells"),
        *[F.sum(n).over(Window.partitionBy(*whole)).alias(n + "_all") for n in names],
    )
    sub_offsets = (
        subcells.select(*keys, "_cell", "_sub", *below(keys + ["_cell"], "_sub", "_in_subs"))
        .join(cell_offsets, keys + ["_cell"])
        .select(
            *keys,
            "_cell",
            "_sub",
            *[(F.col(n + "_in_cells") + F.col(n + "_in_subs")).alias(n + "_offset") for n in names],
            *[n + "_all" for n in names],
        )
    )
    inside = flat.select(*keys, value, *names, "_cell", "_sub", *below(keys + ["_cell", "_sub"], value, "_inside"))
    return inside.join(sub_offsets, keys + ["_cell", "_sub"]).select(
        *keys,
        value,
        *names,
        *[(F.col(n + "_offset") + F.col(n + "_inside")).alias(n + "_below") for n in names],
        *[n + "_all" for n in names],
    )


def score_table(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Positives and negatives at and below each distinct score.

    `weight` names a column of row counts where equal rows were already grouped.
    """
    y = F.col(label)
    w = F.col(weight) if weight else F.lit(1)
    labelled = df.filter(y.isNotNull())
    return ranked(
        labelled, score, {"pos": F.when(y == 1, w).otherwise(0), "neg": F.when(y == 0, w).otherwise(0)}, keys
    )


def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name, one row per key."""
    table = ranked(df, value, {"n": F.lit(1)}, keys)
    aggs = []
    for name, q in probabilities.items():
        at = (F.col("n_all") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)

        def holds(position: Column) -> Column:
            return (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))

        lower = F.max(F.when(holds(low), F.col(value)))
        upper = F.max(F.when(holds(high), F.col(value)))
        aggs.append((lower + (upper - lower) * F.max(at - low)).alias(name))
    return table.groupBy(*keys).agg(*aggs)
