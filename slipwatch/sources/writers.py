"""Sinks: panel, scores and form tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from slipwatch.sources.layout import with_key_filter, write_bucketed


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by month, inside a month sorted by project and with filters on it.

    Rows of a month are written by whatever task holds them; the optional rebalance keeps
    files few without forcing a month into one task (it splits large months).
    """
    rows = panel.hint("rebalance", "as_of_month").sortWithinPartitions("as_of_month", "project_id")
    with_key_filter(rows.write.mode(mode), "project_id").partitionBy("as_of_month").parquet(path)


def write_meta(meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row of counters as JSON."""
    meta.coalesce(1).write.mode(mode).json(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite", buckets: int | None = None) -> None:
    """Scores as Parquet files, or with `buckets` as a table of that name that joins others without a shuffle."""
    if buckets:
        write_bucketed(scores, path, buckets)
    else:
        scores.write.mode(mode).parquet(path)


def write_forms(forms: DataFrame, json_path: str, csv_path: str, mode: str = "overwrite") -> None:
    """The form table as JSON and as CSV."""
    forms.write.mode(mode).json(json_path)
    forms.write.mode(mode).option("header", True).csv(csv_path)
