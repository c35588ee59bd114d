"""Nearest neighbours by inner product through randomly rotated one-bit codes.

A vector is stored as the signs of its randomly rotated direction, packed to bits, with two
correction scalars: its length and the inner product of its direction with its own code.
For a query the packed bits estimate every inner product, and the scalars bound the error
of the estimate. The exact k-th score among the best estimates is a floor; every vector
whose upper bound reaches the floor is reranked with the original vectors, in double
precision.

Queries and rows meet in blocks dealt by a hash of the id: the work is queries times rows,
as the search asks for, no task holds more than one block of each, and each block of rows
returns at most k rows a query. Defined results: vectors that are null, empty, zero or hold
null or non-finite components take no part; vectors of different lengths never meet;
rows of one id count once, with their smallest vector; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import finite_vector, saved

ROW_BLOCK, QUERY_BLOCK = 8192, 4096
CHUNK = 256  # queries whose estimates are held at once
BOUND = 3.0  # standard errors of the estimate; see recall in the tests
FIRST = 3  # times k: the best estimates whose exact scores set the floor
SEED = 20


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, inner product of direction and code) of each row."""
    length = np.sqrt((vectors * vectors).sum(1))
    turned = (vectors / length[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    codes: np.ndarray, length: np.ndarray, fit: np.ndarray, k: int, bound: float = BOUND,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query: (query ids, ids, scores)."""
    size = vectors.shape[1]
    turn = rotation(size)
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    # Estimate: <code, q> / <code, direction>; its error shrinks with the square root of the size.
    gain = (length / fit / np.sqrt(size)).astype(np.float32)
    error = length * np.sqrt(np.maximum(0.0, 1.0 - fit * fit)) / fit * bound / np.sqrt(max(1, size - 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), CHUNK):
        part = queries[at : at + CHUNK]
        estimates = (part @ turn).astype(np.float32) @ (signs * gain[:, None]).T
        for q, own, estimate in zip(part, query_ids[at : at + CHUNK], estimates, strict=True):
            other = ids != own
            reach = error * np.sqrt(q @ q)
            best = np.where(other, estimate, -np.inf)
            n = min(len(ids), FIRST * k)
            first = np.argpartition(best, len(ids) - n)[len(ids) - n :]
            first = first[other[first]]
            exact = (vectors[first] * q).sum(1)
            floor = -np.inf if len(exact) < k else np.partition(exact, len(exact) - k)[len(exact) - k]
            rows = np.flatnonzero(other & (estimate + reach >= floor))
            score = (vectors[rows] * q).sum(1)
            if len(rows) > k:
                keep = score >= np.partition(score, len(rows) - k)[len(rows) - k]
                rows, score = rows[keep], score[keep]
            order = np.lexsort((ids[rows], -score))[:k]
            found.append((np.full(len(order), own), ids[rows[order]], score[order]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def build_index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, size, code, length, fit): every usable vector with its code; written once."""
    usable = (
        rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & finite_vector(F.col("v")))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )

    @F.pandas_udf("code binary, length double, fit double")
    def coded(v: pd.Series) -> pd.DataFrame:
        out = [None] * len(v)
        sizes = v.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            code, length, fit = encode(np.stack(v.iloc[at].to_list()).astype(np.float64), rotation(int(size)))
            for i, c, n, f in zip(at, code, length, fit, strict=True):
                out[i] = (c.tobytes(), n, f)
        return pd.DataFrame(out, columns=["code", "length", "fit"])

    made = usable.withColumn("_c", coded("v"))
    return saved(made.select("vec_id", "v", F.size("v").alias("size"), "_c.*"), "index")


def nearest(index: DataFrame, is_query: Column, k: int = 20, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row of the index that `is_query` holds for."""
    n = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(is_query, 1).otherwise(0)).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-n["n"] // ROW_BLOCK)), max(1, -(-(n["q"] or 0) // QUERY_BLOCK))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = index.withColumn("rb", deal(row_blocks)).withColumn("qb", every(query_blocks))
    asked = index.filter(is_query).select("vec_id", "v", "size", deal(query_blocks).alias("qb")).withColumn("rb", every(row_blocks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        q, i, s = search_block(
            left["vec_id"].to_numpy(), np.stack(left["v"].to_list()), right["vec_id"].to_numpy(), np.stack(right["v"].to_list()),
            codes, right["length"].to_numpy(), right["fit"].to_numpy(), k, bound,
        )
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    keys = ["size", "qb", "rb"]
    local = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
