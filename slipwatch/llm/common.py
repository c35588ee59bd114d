"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipwatch.session import checkpoint_dir

# The characters that separate words in every contract of this subpackage.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


_written: list[list[str]] = []  # tables written by the operators that are under way, innermost last
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write `df` as Parquet to the shared folder of `spark.checkpoint.dir` and read it back.

    Unlike checkpoint() the columns stay prunable, so a later use reads only what it needs.
    The shuffle files of the write go with its end: what is read back does not need them.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/slipwatch-{kind}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_SHUFFLES_GO) if before is None else conf.set(_SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, build: Callable[[], DataFrame], kind: str) -> DataFrame:
    """The result of `build`, written; the tables that `build` wrote on its way are removed."""
    _written.append([])
    try:
        result = build()
        steps = _written.pop()
    except BaseException:
        _written.pop()
        raise
    result = saved(result, kind)
    for step in steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(step)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result


def give_back() -> None:
    """At the end of a task: what its Python worker no longer needs goes back to the machine.

    Workers go on to other jobs, beside a JVM that needs the room.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def fresh(name: str, columns: Sequence[str]) -> str:
    """`name`, lengthened until none of `columns` has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def finite_vector(vector: Column) -> Column:
    """Whether a vector is not null, not empty, not zero and holds finite components only."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        vector.isNotNull()
        & (F.size(vector) > 0)
        & F.coalesce(F.forall(vector, ok), F.lit(False))
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    )


def running_total(
    rows: DataFrame, keys: Sequence[str], cell: str, order: Sequence[Column], weight: str, out: str
) -> DataFrame:
    """Sum of `weight` over all earlier rows of the same `keys`, earlier by (`cell`, `order`).

    `cell` is a coarse position, non-decreasing in the wanted order. The cells are summed
    first and only their sums meet in one window per key, so one key may hold any share of
    the rows: the second window sees a single cell. Keys are not null; the join then keeps
    the window's partitioning, so the rows are shuffled once.
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, cell).agg(F.sum(weight).alias("_cell_sum"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, cell, F.coalesce(F.sum("_cell_sum").over(before), F.lit(0)).alias("_cell_start"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(starts, [*keys, cell])
        .withColumn(out, F.col("_inside") + F.col("_cell_start"))
        .drop("_inside", "_cell_start")
    )


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, root): for every id that occurs in `links`, the smallest id it can reach.

    Alternates large-star and small-star steps; the edges stay on the cluster, each round
    is written to the shared folder and only a count and a checksum reach the driver.
    """
    return finished(links.sparkSession, lambda: _components(links, a, b, max_rounds), "components")


def _components(links: DataFrame, a: str, b: str, max_rounds: int) -> DataFrame:
    edges = saved(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct(),
        "links",
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (
            both.join(low, "v")
            .filter(F.col("u") > F.col("v"))
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .distinct()
        )
        roots = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(roots, "v").select(
            F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        )
        edges = saved(small.select("e.*").filter(F.col("v") != F.col("u")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct()
    )
