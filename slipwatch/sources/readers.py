"""Snapshot, form and panel readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipwatch import schema as S
from slipwatch.operators.forms import match_headers, rename_headers, type_form
from slipwatch.operators.skew import HOT_ROWS, join_attributes


def _named(df: DataFrame) -> DataFrame:
    columns = [F.col(wire).alias(name) for wire, name in S.SNAPSHOT_FIELDS.items()]
    pid = F.col("ProjectId")
    return df.filter(pid.isNotNull() & (pid != 0)).select(*columns, "harvest_seq")


def in_input_order(df: DataFrame, seq: str = "harvest_seq") -> DataFrame:
    """Fills gaps of `seq` with the record's position in the input: files by path, then place in the file.

    A task numbers the rows of its pieces of files, and the pieces are counted and put in
    order of path and first byte. So the numbers depend neither on how files are cut or
    packed into tasks, nor on their sizes or a second attempt.
    """
    piece = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    read = df.select("*", *piece, F.monotonically_increasing_id().alias("_at"))
    own = Window.partitionBy("_file", "_start")
    placed = read.withColumn("_place", F.row_number().over(own.orderBy("_at")).cast("long") - 1)
    # One row a piece of a file, so one task can put them in order.
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = read.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    starts = pieces.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(starts, ["_file", "_start"])
        .withColumn(seq, F.coalesce(F.col(seq), F.col("_before") + F.col("_place")))
        .select(*df.columns)
    )


def read_snapshots(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Raw snapshot records from JSON arrays (or JSON lines, which split across tasks)."""
    return _named(in_input_order(spark.read.schema(S.SNAPSHOT_WIRE_SCHEMA).json(path, multiLine=not lines)))


def parse_snapshots(df: DataFrame, column: str = "value") -> DataFrame:
    """Raw snapshot records from a column of JSON objects."""
    parsed = F.from_json(column, S.SNAPSHOT_WIRE_SCHEMA).alias("r")
    return _named(df.select(parsed).select("r.*"))


def prefer_dated(dated: DataFrame, undated: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Both sources, where a project of the dated source is not taken from the other one.

    A project with very many undated records is split on its way to the list of known ones.
    """
    known = dated.select("project_id").distinct()
    place = "harvest_seq" if "harvest_seq" in undated.columns else undated.columns
    rest = join_attributes(undated, known, "project_id", place, min_rows=hot_rows, how="left_anti")
    return dated.unionByName(rest, allowMissingColumns=True)


def read_form_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(typed form rows, ignored columns) of a CSV with free header spelling.

    All files of one call must have the same header; one with other columns, or in another
    order, is an error and not read into the wrong columns.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    _, ignored = match_headers(text.columns)
    return type_form(rename_headers(text)), ignored


def read_form_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Typed form rows from JSON records whose names are the form's own (JSON lines split across tasks)."""
    text = spark.read.schema(", ".join(f"{f} string" for f in S.FORM_FIELDS)).json(path, multiLine=not lines)
    return type_form(text)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
