"""Whitening on the leading components of the covariance, found by contour integration (FEAST).

The covariance is summed on the cluster: every task turns its batches into one d x d product
and only these are shuffled. What reaches the driver is bounded by the dimension alone
(d x d, at most MAX_DIMS squared). There the spectrum is cut into intervals by inertia
counts, each interval's invariant subspace is projected out by quadrature of complex shifted
solves along a circle around it, Rayleigh-Ritz extracts the components, and the number found
in every interval must equal its inertia count, so none is missed.

Defined results. Rows whose vector is null or empty, or holds null or non-finite entries, take
no part; neither do vectors of another length than the most frequent one (ties: the longer).
Every other row is fitted and whitened on its own, also repeated rows and rows without an id.
Columns other than id and vector are not read. Components stop at the numerical rank, so an
empty table, a single row or equal rows give no component and hence no row. Entries are taken
as floor(1024 c) + 100000; sizes beyond LARGEST count as LARGEST. Components of equal
eigenvalues are some orthonormal basis of their space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch.llm.common import saved

MAX_DIMS = 4096
SCALE, SHIFT = 1024, 100_000  # fixed values: the grid of the contract
LARGEST = float(2**40)
SLICE = 4  # eigenvalues an interval is closed at
LOOK = 8  # how many places further a wider gap is looked for
WIDE, LEAST = 0.05, 1e-7  # gaps, relative to the eigenvalue above: wide enough, and too small to cut
NODES = 16  # quadrature nodes on a half circle
ROUNDS = 12


@dataclass
class Whitening:
    """n vectors with exact sums; eigenvalues (falling) and unit components (columns) of their covariance."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


# Batches of vectors


def grids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number matrix) of the usable vectors of a batch, one pair a length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    starts = np.cumsum(sizes) - sizes
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    usable = (sizes > 0) & (odd[starts + sizes] == odd[starts])
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        part = entries[starts[rows][:, None] + np.arange(size)]
        yield rows, np.clip(np.floor(part * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def centre(x: np.ndarray, n: int, sums: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(x - floor(S/n), x - S/n): whole numbers, and doubles that are rounded once."""
    whole = x - np.array([s // n for s in sums], np.int64)
    return whole, whole - np.array([s % n / n for s in sums])


def deviations(whole: np.ndarray, n: int, sums: Sequence[int]) -> list[Decimal | None]:
    """Sum of (n x - S)^2 of every row, exactly; null beyond 38 digits."""
    rest = [s % n for s in sums]
    top = int(np.abs(whole).max(initial=0))
    small = top * top * len(rest) < 2**62 and top * sum(rest) < 2**62
    kind = np.int64 if small else object
    y, r = whole.astype(kind), np.array(rest, kind)
    square, cross, own = (y * y).sum(1), (y * r).sum(1), sum(v * v for v in rest)
    exact = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(square, cross, strict=True)]
    return [Decimal(v) if v < 10**38 else None for v in exact]


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of usable vectors of the most frequent length and their sum in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in grids(batch.column("v")):
                size = x.shape[1]
                n, total = found.get(size, (0, 0))
                found[size] = (n + len(x), total + x.sum(0).astype(object))
        for size, (n, total) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"size": [size] * (size + 1), "i": list(range(-1, size)), "s": [Decimal(v) for v in (n, *total)]},
                pa.schema([("size", pa.int64()), ("i", pa.int64()), ("s", pa.decimal128(38, 0))]),
            )

    parts = rows.mapInArrow(add, "size long, i long, s decimal(38,0)")
    totals = parts.groupBy("size", "i").agg(F.sum("s").alias("s"))
    best = totals.filter("i = -1").orderBy(F.desc("s"), F.desc("size")).first()
    if best is None:
        return 0, []
    size = best["size"]
    if size > MAX_DIMS:
        raise ValueError(f"vectors of {size} dimensions; {MAX_DIMS} is the bound of what the driver holds")
    own = totals.filter((F.col("size") == size) & (F.col("i") >= 0)).collect()
    return int(best["s"]), [int(s) for _, s in sorted((r["i"], r["s"]) for r in own)]


def _products(parts: DataFrame, dims: int) -> np.ndarray:
    """Sum of the d x d matrices that tasks emit as (part, i, row); added up on the cluster, row by row."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(frame.sort_values("part")["row"].to_list()).sum(0)
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "row": [total]})

    out = np.zeros((dims, dims))
    for r in parts.groupBy("i").applyInPandas(add, "i int, row array<double>").collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def _emit(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))}
        )


def _numbered(parts: DataFrame) -> DataFrame:
    return parts.withColumn("part", F.spark_partition_id())


# The eigenproblem: everything here is bounded by the dimension


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a similar tridiagonal matrix."""
    a = matrix.copy()
    n = len(a)
    off = np.zeros(max(0, n - 1))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = float(np.sqrt(x @ x))
        off[k] = size
        if size == 0.0:
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.sqrt(x @ x)
        p = a[k + 1 :, k + 1 :] @ x
        w = p - (x @ p) * x
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
    if n > 1:
        off[-1] = a[n - 1, n - 2]
    return np.diag(a).copy(), off**2


def count_above(diagonal: np.ndarray, off2: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues lie above each shift, from the signs of the pivots."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    above = (pivot > 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[k] - shifts - off2[k - 1] / pivot
        above += pivot > 0
    return above


def intervals(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, inertia count) of disjoint intervals that hold the k largest eigenvalues, cut at wide gaps."""
    diagonal, off2 = tridiagonal(matrix)
    reach = np.sqrt(off2)
    edge = np.abs(diagonal) + np.append(reach, 0) + np.append(0, reach)
    top, noise = float(edge.max()), 4 * len(matrix) * np.finfo(float).eps * float(np.trace(matrix))
    if top <= 0:
        return []
    rank = int(count_above(diagonal, off2, np.array([noise]))[0])
    order = np.arange(1, rank + 1)
    low, high = np.full(rank, noise), np.full(rank, top * 1.01)
    while rank and (high - low).max() > 1e-10 * top:
        middle = (low + high) / 2
        inside = count_above(diagonal, off2, middle) >= order
        low, high = np.where(inside, middle, low), np.where(inside, high, middle)
    at = np.append((low + high) / 2, noise)
    gap = (at[:-1] - at[1:]) / at[:-1]  # after each eigenvalue, relative to it
    out, start, ceiling = [], 0, top * 1.01
    while start < min(k, rank):
        first = min(start + SLICE, k, rank)
        near = gap[first - 1 : first + LOOK]
        end = first + int(np.minimum(near, WIDE).argmax())  # the nearest wide gap, else the widest
        while end < rank and gap[end - 1] < LEAST:  # equal eigenvalues stay together
            end += 1
        floor = (at[end - 1] + at[end]) / 2
        above = count_above(diagonal, off2, np.array([ceiling, floor]))
        out.append((float(floor), float(ceiling), int(above[1] - above[0])))
        start, ceiling = end, floor
    return out


def project(matrix: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, seed: int = 11) -> np.ndarray:
    """Orthonormal basis of the `count` eigenvectors with eigenvalues in (low, high], by contour integration."""
    dims = len(matrix)
    size = min(dims, 2 * count + SLICE)
    block = np.random.default_rng(seed).standard_normal((dims, size))
    middle, radius = (low + high) / 2, (high - low) / 2
    place, weight = np.polynomial.legendre.leggauss(nodes)
    turn = radius * np.exp(1j * np.pi * (place + 1) / 2)
    solvers = [(w * t / 2, np.linalg.inv((middle + t) * np.eye(dims) - matrix)) for w, t in zip(weight, turn, strict=True)]
    scale = float(np.abs(matrix).sum(1).max())
    best, vectors = math.inf, None
    for _ in range(ROUNDS):
        image = sum((factor * (inverse @ block)).real for factor, inverse in solvers)
        basis = np.linalg.qr(image)[0]
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ small
        inside = (values > low) & (values <= high)
        if inside.sum() == count:
            rest = matrix @ block[:, inside] - block[:, inside] * values[inside]
            error = float(np.sqrt((rest**2).sum(0)).max(initial=0)) / scale
            if error >= best / 2:  # nothing more to gain
                break
            best, vectors = error, block[:, inside]
    if vectors is None or best > 1e-11:
        if nodes >= 8 * NODES:
            raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}], which the quadrature does not resolve")
        return project(matrix, low, high, count, 2 * nodes, seed + 1)
    return vectors


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above rounding (falling) and their unit eigenvectors as columns."""
    cuts = intervals(matrix, k)
    if not cuts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    # One more Rayleigh-Ritz step makes the vectors of different intervals orthogonal to each other.
    basis = np.linalg.qr(np.concatenate([project(matrix, *cut) for cut in cuts], axis=1))[0]
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    vectors = (basis @ small)[:, ::-1][:, :k]
    lead = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return values[::-1][:k], vectors * np.where(lead < 0, -1.0, 1.0)


# The operator


def fit_whitening(rows: DataFrame, k: int = 8, vector: str = "embedding") -> Whitening:
    """Sums, covariance and leading components of all usable vectors."""
    only = rows.select(F.col(vector).cast("array<double>").alias("v"))
    n, sums = _sums(only)
    if n == 0:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    dims = len(sums)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in grids(batch.column("v")):
                if x.shape[1] == dims:
                    y = centre(x, n, sums)[1]
                    total = y.T @ y + (0 if total is None else total)
        yield from _emit(total)

    matrix = _products(_numbered(only.mapInArrow(multiply, "i int, row array<double>")), dims) / n
    values, vectors = components(matrix, k)
    return Whitening(n, sums, float(np.trace(matrix)), values, vectors)


def whiten(rows: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation decimal, whitened array): one row for every usable vector of the model's length."""
    n, sums = model.n, model.sums
    turn = model.vectors / np.sqrt(model.values)
    wide = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kind = wide.schema["vec_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in grids(batch.column("v")):
                if n and x.shape[1] == len(sums):
                    whole, y = centre(x, n, sums)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("vec_id").take(pa.array(at)),
                            pa.array(deviations(whole, n, sums), pa.decimal128(38, 0)),
                            pa.array(list(y @ turn), pa.list_(pa.float64())),
                        ],
                        ["vec_id", "deviation", "whitened"],
                    )

    return wide.mapInArrow(place, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not n or not k:
        return 0.0
    means = np.array(whitened.agg(*[F.avg(F.get("whitened", F.lit(i))) for i in range(k)]).first(), float)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - means
            total = y.T @ y + (0 if total is None else total)
        yield from _emit(total)

    parts = _numbered(whitened.select("whitened").mapInArrow(multiply, "i int, row array<double>"))
    return float(np.abs(_products(parts, k) / n - np.eye(k)).max())


def whitened_components(rows: DataFrame, k: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    model = fit_whitening(rows, k, vector)
    found = len(model.values)
    placed = saved(whiten(rows, model, vec_id, vector), "whitened")
    error = identity_error(placed, model.n, found)
    share = lambda i: F.get(F.array(*[F.lit(x) for x in model.explained]).cast("array<double>"), i)
    return placed.select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened")).select(
        "vec_id",
        (F.col("_i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share(F.col("_i")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
