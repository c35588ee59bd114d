"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation that makes binary codes balanced and close to the vectors is learned on a bounded
sample. The code is cut into substrings, one table each. Two unit vectors with cosine c are
sqrt(2 - 2c) apart, rotation changes no distance, so in at least one of m substrings they
are at most sqrt((2 - 2c) / m) apart. A bit differs only where both coordinates lie across
zero, hence one of the two vectors reaches the other's substring by flipping bits whose
squared coordinates sum to no more than half of that: these are the probes. Nothing is lost,
and what is found is verified with the original vectors in double precision.

Vectors are dealt out by label. A label of more than CROWD vectors is cut into blocks by a
hash of the id, and every two of its blocks meet in a task of their own, so both vectors of a
pair are in one task, which holds all tables of its rows. Blocks are dealt in as many rounds
as keep the copies under way to ROUND for each vector, whatever the size of a label: the
shuffle files of a round go before the next begins. Each link is counted in one place, and a
task returns sums and spanning edges, never pairs. Squared coordinates are whole numbers of
2**-40, so that sums over them are exact, and both directions of a pair agree on which of them
counts the link. Vectors of single precision travel as such; all sums are in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows without label or id, link with nothing; vectors of different lengths never link;
equal vectors of one label are one class whose members all link; of rows with one id the
smallest (label, vector) counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from slipwatch.llm.common import components, finished, finite_vector, saved

SAMPLE = 8192  # vectors that the rotation is learned on, the first by a hash of the id
ROUNDS = 40
CELL = 8192  # vectors of a block, about
CROWD = 2 * CELL  # vectors of a label that one task takes; more are dealt in blocks
MOST_CROWDED = 100_000  # crowded labels that are broadcast; more are joined
ROUND = 2  # copies of each vector that are under way together, about
CHUNK = 512
PAIRS = 200_000  # pairs that are looked at together
DENSE = 16  # a chunk with a probe or a find for one in so many of all its pairs looks at all of them at once
UNIT = float(1 << 40)
SLACK = 1e-7  # room for rounding in the bounds; links are verified exactly


@dataclass(frozen=True)
class Rotation:
    """Centre and rotation for vectors of each length."""

    centre: dict[int, np.ndarray]
    turn: dict[int, np.ndarray]

    def apply(self, unit: np.ndarray) -> np.ndarray:
        size = unit.shape[1]
        if size not in self.turn:
            return unit
        return (unit - self.centre[size]) @ self.turn[size]


def learn_rotation(unit: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes, then alternating between codes and the rotation that brings vectors closest to them."""
    centre = unit.mean(0)
    x = unit - centre
    _, axes = np.linalg.eigh(x.T @ x)
    x = x @ axes
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
        turn = (u @ v).T
    return centre, axes @ turn


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Directions; scaling by the largest component first keeps very large and small vectors finite."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def costs(z: np.ndarray) -> np.ndarray:
    """Squared coordinates in whole numbers of 2**-40."""
    return np.floor(z * z * UNIT)


def flips(cost: np.ndarray, left: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All sets of bits whose costs sum to at most `left`: (row, set as a number, cost); None if more than `most`."""
    row, mask, total = np.arange(len(cost)), np.zeros(len(cost), np.int64), np.zeros(len(cost))
    for bit in range(cost.shape[1]):
        more = total + cost[row, bit]
        ok = more <= left[row]
        row, mask, total = (
            np.concatenate([row, row[ok]]), np.concatenate([mask, mask[ok] | 1 << bit]), np.concatenate([total, more[ok]])
        )
        if len(row) > most:
            return None
    return row, mask, total


class Tables:
    """Substrings of the code: which coordinates each table holds."""

    def __init__(self, size: int, count: int, least: float) -> None:
        self.parts = np.array_split(np.arange(size), max(1, min(count, size)))
        self.budget = np.floor(((2.0 - 2.0 * least) / len(self.parts) / 2.0 + SLACK) * UNIT)
        self.least = least

    def values(self, z: np.ndarray, table: int) -> np.ndarray:
        """Each row's substring as a number."""
        bits = (z[:, self.parts[table]] > 0).astype(np.int64)
        return bits @ (1 << np.arange(bits.shape[1]))

    def counted(self, z: np.ndarray, other: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """Whether the pair of each row of z and each row of `other` is counted from z.

        The row of smaller id counts where a probe of its finds the other one, else the larger.
        """
        paid, back = costs(z), costs(other)
        here, there = (z > 0).astype(np.float64), (other > 0).astype(np.float64)
        out, home = np.zeros((2, len(z), len(other)), bool)
        for p in self.parts:
            # Where exactly one sign is positive, a + b - 2ab is 1.
            out |= (paid[:, p] * here[:, p]).sum(1)[:, None] + (paid[:, p] * (1 - 2 * here[:, p])) @ there[:, p].T <= self.budget
            home |= (back[:, p] * there[:, p]).sum(1)[None] + here[:, p] @ (back[:, p] * (1 - 2 * there[:, p])).T <= self.budget
        return out & (smaller | ~home)

    def counted_pairs(self, z: np.ndarray, other: np.ndarray, smaller: np.ndarray, table: int) -> np.ndarray:
        """The same for pairs of rows in the same place that a probe of z found in `table`: its first find counts."""
        differ = (z > 0) != (other > 0)
        paid, back = np.where(differ, costs(z), 0.0), np.where(differ, costs(other), 0.0)
        done = np.zeros(len(z), bool)
        for k, p in enumerate(self.parts):
            if k < table:
                done |= paid[:, p].sum(1) <= self.budget
            done |= ~smaller & (back[:, p].sum(1) <= self.budget)
        return ~done

    def links(
        self, ids: np.ndarray, unit: np.ndarray, z: np.ndarray, side: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (a, b) of linked rows, each link once.

        With `side` only rows of different sides meet, a in one and b in the other.
        """
        rest = [self.values(z, k) for k in range(len(self.parts))]
        everyone = np.arange(len(ids))
        for own, home in [(everyone, everyone)] if side is None else [(np.flatnonzero(side), np.flatnonzero(~side)), (np.flatnonzero(~side), np.flatnonzero(side))]:
            yield from self._probe(ids, unit, z, own, [home[np.argsort(r[home], kind="stable")] for r in rest], rest)

    def _probe(
        self, ids: np.ndarray, unit: np.ndarray, z: np.ndarray, probing: np.ndarray, homes: list[np.ndarray], rest: list[np.ndarray]
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = [r[home] for r, home in zip(rest, homes, strict=True)]
        for at in range(0, len(probing), CHUNK):
            own = probing[at : at + CHUNK]
            finds = self._finds(z, own, keys, rest)
            if finds is None:  # more probes or finds than it takes to look at all pairs
                yield from self._all_pairs(ids, unit, z, own, homes[0])
                continue
            for table, (row, lo, n) in enumerate(finds):
                if not len(n):
                    continue
                # Blocks of bounded size, so that one crowded bucket cannot fill the memory.
                ends = np.cumsum(n)
                cuts = np.searchsorted(ends, np.arange(0, ends[-1], PAIRS))
                for s, e in zip(cuts, [*cuts[1:], len(n)], strict=True):
                    if s == e:
                        continue
                    size = n[s:e]
                    a = np.repeat(row[s:e], size)
                    b = homes[table][np.repeat(lo[s:e] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    close = (a != b) & ((unit[a] * unit[b]).sum(1) >= self.least)
                    a, b = a[close], b[close]
                    mine = self.counted_pairs(z[a], z[b], ids[a] < ids[b], table)
                    yield a[mine], b[mine]

    def _finds(self, z: np.ndarray, own: np.ndarray, keys: list[np.ndarray], rest: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """For each table (row, first place, number) of what the probes of `own` find; None if that is much of all pairs."""
        out, found = [], 0
        for table, part in enumerate(self.parts):
            probes = flips(costs(z[np.ix_(own, part)]), np.full(len(own), self.budget), len(own) * max(1, len(keys[table]) / DENSE))
            if probes is None:
                return None
            row = own[probes[0]]
            want = rest[table][row] ^ probes[1]
            lo, hi = np.searchsorted(keys[table], want, "left"), np.searchsorted(keys[table], want, "right")
            n = hi - lo
            found += int(n.sum())
            if found > len(own) * len(keys[table]) / DENSE:
                return None
            out.append((row[n > 0], lo[n > 0], n[n > 0]))
        return out

    def _all_pairs(self, ids: np.ndarray, unit: np.ndarray, z: np.ndarray, own: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of a chunk whose rows find much of the rows: products of matrices in place of single pairs."""
        for at in range(0, len(home), CHUNK):
            other = home[at : at + CHUNK]
            score = unit[own] @ unit[other].T
            close = (score >= self.least) & (own[:, None] != other)
            # Products of matrices round otherwise than the sums that decide for single pairs.
            a, b = np.nonzero(np.abs(score - self.least) < SLACK)
            close[a, b] = ((unit[own[a]] * unit[other[b]]).sum(1) >= self.least) & (own[a] != other[b])
            if close.any():
                close &= self.counted(z[own], z[other], ids[own][:, None] < ids[other])
                a, b = np.nonzero(close)
                yield own[a], other[b]


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position can reach over the links (a, b)."""
    low = np.arange(n)
    while len(a):
        now = low.copy()
        np.minimum.at(now, a, low[b])
        np.minimum.at(now, b, low[a])
        now = now[now]
        if (now == low).all():
            break
        low = now
    return low


def link_vectors(rows: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", crowd: int = CROWD) -> DataFrame:
    """(vec_id, n_links, component_id) for every row with an id of `rows`."""
    return finished(rows.sparkSession, lambda: _link(rows, least, vec_id, vector, label, crowd), "vector-links")


def _link(rows: DataFrame, least: float, vec_id: str, vector: str, label: str, crowd: int) -> DataFrame:
    spark = rows.sparkSession
    given_type = rows.select(vector).schema[0].dataType
    single = isinstance(given_type, ArrayType) and isinstance(given_type.elementType, FloatType)
    kept = "array<float>" if single else "array<double>"
    given = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast(kept).alias("v"))
    able = F.col("label").isNotNull() & finite_vector(F.col("v"))
    usable = (
        given.filter(F.col("vec_id").isNotNull() & able)
        .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    )
    usable = saved(usable, "vectors")
    classes = saved(
        usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors"
    )
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toPandas()["v"]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(np.asarray(v, np.float64))
    learned = {k: learn_rotation(unit_rows(np.array(v))) for k, v in by_size.items() if len(v) > k}
    shared = spark.sparkContext.broadcast(Rotation({k: x[0] for k, x in learned.items()}, {k: x[1] for k, x in learned.items()}))

    key = ["label", "size"]
    block = max(1, min(CELL, crowd // 2))
    sizes = classes.groupBy("label", F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("members"))
    crowded = saved(sizes.filter(F.col("members") > crowd).withColumn("blocks", F.ceil(F.col("members") / block).cast("int")), "crowded")
    more = crowded.agg(F.count(F.lit(1)), F.sum(F.col("members") * (F.col("blocks") - 1))).first()
    whole = max(1, classes.count())
    rounds = -(-(whole + (more[1] or 0)) // (ROUND * whole))
    blocks = crowded.drop("members")
    dealt = (
        classes.withColumn("size", F.size("v")).join(F.broadcast(blocks) if more[0] <= MOST_CROWDED else blocks, key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        # A row meets every block of its label, its own included, as the low or the high side of a pair of blocks.
        .withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    )

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, n = part["rep"].to_numpy(), part["n"].to_numpy()
        unit = unit_rows(np.stack(part.pop("v").to_list()).astype(np.float64))
        side = None if key[2] == key[3] else part["block"].to_numpy() == key[2]
        # Substrings about as long as the logarithm of the rows: few probes, few strangers per bucket.
        tables = Tables(unit.shape[1], round(unit.shape[1] / max(8.0, float(np.log2(max(2, len(ids)))))), least)
        count, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b in tables.links(ids, unit, shared.value.apply(unit), side):
            np.add.at(count, a, n[b])
            np.add.at(count, b, n[a])
            new = low[a] != low[b]
            if new.any():
                low = _lowest(len(ids), low[a[new]], low[b[new]])[low]
        at = np.flatnonzero(count)
        return pd.DataFrame({"rep": ids[at], "links": count[at], "near": ids[low[at]]})

    parts = []
    for at in range(rounds):
        own = dealt.filter(F.pmod(F.xxhash64(*key) % rounds + F.col("block") + F.col("with"), F.lit(rounds)) == at).select(
            *key, F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "rep", "n", "v"
        )
        parts.append(saved(own.groupBy(*key, "low", "high").applyInPandas(join, "rep long, links long, near long"), "links"))
    found = reduce(DataFrame.unionByName, parts)
    roots = components(found, "rep", "near")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = (
        classes.select("label", "v", "rep", "n")
        .join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    members = usable.join(reps, ["label", "v"]).select("vec_id", "n_links", "component_id")
    ids = given.select("vec_id").filter("vec_id is not null").distinct()
    return ids.join(members, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
