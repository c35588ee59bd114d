"""Incremental month load with Structured Streaming and a ledger.

A batch is collapsed within (month, sector, project). Records of pairs that are not in the
ledger go to the table; records of loaded pairs are late and go beside it, from where
`merge_late` brings in the projects that their slice lacks. The ledger holds one row for each
pair and load and is written last, so it commits a load: nothing reads the table to learn
what is in it. Every load owns one folder of the table, of the late records and of the
ledger, so a batch that is run again replaces its own rows and nothing else.

`refresh_panel` rebuilds only the projects that given loads touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slipwatch.operators.harvest import MOST_SLICES, SLICE, slice_collapse
from slipwatch.operators.skew import HOT_ROWS, join_attributes
from slipwatch.session import cut_lineage

LEDGER = "report_month string, harvest_sector_id string, records long, merged string, load string"
BUCKETS = 64


def month_stream(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(source)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The folder, or None where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _with_load(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("load", T.StringType())])


def loaded(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The table so far, with the `load` that brought each row; empty before the first."""
    full = _with_load(schema)
    found = _read(spark, target, full)
    return spark.createDataFrame([], full) if found is None else found


def _beside(target: str, what: str) -> str:
    return f"{target.rstrip('/')}_{what}"


def ledger(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """Loaded pairs: month, sector, records, the late load that a merge took in, load.

    A table without a ledger is counted once, here, from its rows.
    """
    empty = spark.createDataFrame([], LEDGER)
    found = _read(spark, _beside(target, "ledger"), empty.schema)
    if found is not None:
        return found.select(empty.columns)
    old = loaded(spark, target, schema).groupBy(*SLICE, "load").agg(F.count(F.lit(1)).alias("records"))
    return old.withColumn("merged", F.lit(None).cast("string")).select(empty.columns)


def _commit(rows: DataFrame, target: str, load: str, merged: Sequence[str] = ()) -> None:
    """The pairs of a load, and a row without a pair for each late load it took in."""
    spark = rows.sparkSession
    pairs = rows.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("records")).withColumn("merged", F.lit(None).cast("string"))
    taken = spark.createDataFrame([(None, None, 0, m) for m in merged], "report_month string, harvest_sector_id string, records long, merged string")
    pairs.unionByName(taken).coalesce(1).write.mode("overwrite").parquet(f"{_beside(target, 'ledger')}/load={load}")


def by_slice(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """`records` with `_known`: whether their pair is among `pairs`, which is counted before it is broadcast."""
    listed = pairs.select(*SLICE).distinct().withColumn("_known", F.lit(True))
    if listed.limit(MOST_SLICES + 1).count() <= MOST_SLICES:
        listed = F.broadcast(listed)
    return records.join(listed, SLICE, "left").withColumn("_known", F.col("_known").isNotNull())


def load_batch(batch: DataFrame, target: str, load: str, late: str | None = None) -> None:
    """One load: late records and fresh ones, then the ledger. Run again, it writes the same."""
    names = batch.columns
    done = ledger(batch.sparkSession, target, batch.schema).filter(F.col("load") != load)
    # Read once: the batch would otherwise be collapsed for each of the three writes.
    records = cut_lineage(by_slice(slice_collapse(batch), done))
    records.filter("_known").select(*names).write.mode("overwrite").parquet(f"{late or _beside(target, 'late')}/load={load}")
    fresh = records.filter("not _known").select(*names)
    fresh.write.mode("overwrite").parquet(f"{target}/load={load}")
    _commit(fresh, target, load)


def load_months(stream: DataFrame, target: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Runs over all files that are there and stops; start it again for the next month.

    `late` is the folder for records of pairs that were loaded before (default: beside the table).
    """
    origin = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: load_batch(batch, target, f"{origin}-{batch_id}", late))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_late(spark: SparkSession, target: str, schema: T.StructType, late: str | None = None) -> str | None:
    """Adds late records of projects that their slice lacks; returns the load they came in with.

    A record of a project that the slice already has changes nothing: the first one seen
    stays. Only the loads that hold a late pair are read. What was merged is in the ledger,
    so a second call, or one after a failure, takes in nothing twice.
    """
    behind = _read(spark, late or _beside(target, "late"), _with_load(schema))
    if behind is None:
        return None
    known = cut_lineage(ledger(spark, target, schema))
    taken = {r["merged"] for r in known.filter("merged is not null").select("merged").distinct().collect()}
    todo = sorted(r["load"] for r in behind.select("load").distinct().collect() if r["load"] not in taken)
    if not todo:
        return None
    load = "late-" + hashlib.sha256("/".join(todo).encode()).hexdigest()[:12]
    first = slice_collapse(behind.filter(F.col("load").isin(todo)).select(*schema.names))
    pairs = first.select(*SLICE).distinct()
    holding = [r["load"] for r in known.filter(F.col("load") != load).join(pairs, SLICE, "left_semi").select("load").distinct().collect()]
    there = loaded(spark, target, schema).filter(F.col("load").isin(holding)).select(*SLICE, "project_id")
    fresh = cut_lineage(first.join(there, [*SLICE, "project_id"], "left_anti").select(*schema.names))
    fresh.write.mode("overwrite").parquet(f"{target}/load={load}")
    _commit(fresh, target, load, todo)
    return load


def touched(spark: SparkSession, target: str, schema: T.StructType, loads: Sequence[str]) -> DataFrame:
    """Projects that have a record in one of the loads."""
    return loaded(spark, target, schema).filter(F.col("load").isin(list(loads))).select("project_id").distinct()


def refresh_panel(
    spark: SparkSession, target: str, schema: T.StructType, panel: str, loads: Sequence[str],
    build: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, hot_rows: int = HOT_ROWS,
) -> None:
    """Rebuilds the projects that `loads` touched, in a panel kept in buckets of projects.

    `build` makes panel rows of records. Only buckets with a touched project are written;
    their other projects are carried over as they are.
    """
    bucket = F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")
    projects = cut_lineage(touched(spark, target, schema, loads))
    records = join_attributes(loaded(spark, target, schema), projects, "project_id", "harvest_seq", min_rows=hot_rows, how="left_semi")
    rows = build(records.select(*schema.names)).withColumn("bucket", bucket)
    places = [r["bucket"] for r in projects.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
    old = _read(spark, panel, rows.schema)
    if old is not None:
        stay = join_attributes(old.filter(F.col("bucket").isin(places)), projects, "project_id", rows.columns, min_rows=hot_rows, how="left_anti")
        rows = rows.unionByName(stay)
    # The folder is read and written, so the rows are stored before any is replaced.
    cut_lineage(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(panel)
