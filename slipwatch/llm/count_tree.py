"""Jaccard join of shingle sets through an R-tree over count vectors.

Shingles are hashed into groups; a document's point is how many of its shingles fall into
each group. The overlap of two sets is at most the sum of the smaller of their counts, and
for two boxes of points the sum of the smaller upper corners: the tree is joined with
itself and only pairs of boxes, then of points, whose bound allows the threshold go on.
Surviving pairs are verified on the shingles themselves.

Points of unrelated texts of one length lie so close that a tree over all documents prunes
next to nothing until it compares single points. So documents are first dealt into trees:
in an order of all shingles with the frequent ones last, two sets that link share one of
their first n - ceil(0.8 n) + 1 shingles, and there is one tree for every such shingle.
Nothing is lost by that, whichever shingles count as frequent. The documents of a frequent
shingle fall into blocks, one tree each, so a tree holds a bounded number of points.

Equal sets are one class. A first round links each tree's members to its leaders and
verifies; the second takes every pair left between different components. Only components
are wanted, so pairs inside one component need no check. Rows of different blocks of a
shingle meet in the second round, and only those outside the shingle's largest component
go into the other blocks: a group of copies is one component by then and costs nothing.
A pair that several trees hold comes from the first of them alone, as far as each row's
first OWN_TREES trees tell.

Defined results: null and empty texts and texts without words have no shingles and link
with nothing; fewer than five words are one shingle; rows with equal sets link; rows without
an id link like all others, and a component of such rows alone has a null name. Two
different sets share a class number, or two rows a key, with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import components, finished, give_back, saved
from slipwatch.llm.shingles import mix, read_points, set_id, shingle_set, stored_point

PERCENT = 80
LEAF = 32
BLOCK = 2048  # points of one frequent shingle's block
OWN_TREES = 32  # a row's first trees, which travel with it so that a pair need not come from every tree it shares
EVERY = 32  # one document in so many tells which shingles are frequent
FREQUENT = 4  # of the documents looked at, so many at least hold a frequent shingle
FILTER_BITS = 1 << 23  # 1 MB; a power of two
REMEMBER = 1 << 16  # lists of members that a task knows again; those it forgot are put together in the shuffle
MOST_FREQUENT = 1 << 20  # frequent shingles at most, 16 MB on each worker; more keep their place in the order


def needed(sizes: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set with any set it links to."""
    return (percent * sizes + 99) // 100


def dealt_keys(
    shingles: np.ndarray, owner: int, frequent: np.ndarray, blocks: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """(keys, wide): the trees that a set belongs to, and its shingles whose documents fall into several blocks."""
    n = len(shingles)
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    common = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    first = n - needed(n, percent) + 1
    rare = shingles[~common][:first]
    rest = max(0, first - len(rare))
    s, b = shingles[common][:rest], blocks[at[common][:rest]].astype(np.uint64)
    # Two ways to cut blocks, by the shingle's last bit: rows that share shingles of both kinds tie the blocks together.
    place = mix(np.uint64(owner) ^ (s & np.uint64(1))) % np.maximum(b, np.uint64(1))
    return np.concatenate([rare, np.where(b > 1, mix(s ^ mix(place + np.uint64(1))), s)]), s[b > 1]


class CountTree:
    """A packed R-tree: points sorted by size and by their largest spread, boxes of LEAF points or boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> None:
        self.points, self.sizes, self.percent = points, sizes, percent
        order = np.lexsort((points[:, int(np.ptp(points, axis=0).argmax())], sizes)) if len(sizes) > LEAF else np.arange(len(sizes))
        groups = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []
        corners = np.stack([points[g].max(0) for g in groups])
        low, high = np.array([sizes[g].min() for g in groups]), np.array([sizes[g].max() for g in groups])
        self.boxes.append((corners, low, high, groups))
        while len(corners) > LEAF:
            parts = [np.arange(i, min(i + LEAF, len(corners))) for i in range(0, len(corners), LEAF)]
            corners = np.stack([corners[p].max(0) for p in parts])
            low, high = np.array([low[p].min() for p in parts]), np.array([high[p].max() for p in parts])
            self.boxes.append((corners, low, high, parts))

    def _may(self, ca, la, ha, cb, lb, hb) -> np.ndarray:
        """Whether a pair of boxes (or points) can hold a link, for one box against many."""
        p = self.percent
        sized = (100 * hb >= p * la) & (100 * ha >= p * lb)
        out = np.zeros(len(cb), bool)
        at = np.flatnonzero(sized)
        if len(at):
            # overlap >= p / 100 * union, union = |x| + |y| - overlap
            bound = np.minimum(ca, cb[at]).sum(1)
            out[at] = (100 + p) * bound >= p * (la + lb[at])
        return out

    def partners(self, i: int, among: np.ndarray) -> np.ndarray:
        """Of the rows `among`, those whose point may link with point i."""
        s = self.sizes
        return among[self._may(self.points[i], s[i], s[i], self.points[among], s[among], s[among])]

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows of the same or a later leaf) for all pairs that may link, once each."""
        top = len(self.boxes) - 1

        def visit(level: int, a: int, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            corners, low, high, parts = self.boxes[level]
            others = others[self._may(corners[a], low[a], high[a], corners[others], low[others], high[others])]
            if not len(others):
                return
            below = [parts[k] for k in others]
            if level:
                for x in parts[a]:
                    later = np.concatenate(below)
                    yield from visit(level - 1, int(x), later[later >= x])
                return
            rows = np.concatenate(below)
            for k, i in enumerate(parts[a]):
                own = rows if others[0] != a else np.concatenate([parts[a][k + 1 :], *below[1:]])
                near = self.partners(int(i), own)
                if len(near):
                    yield int(i), near

        for a in range(len(self.boxes[top][0])):
            yield from visit(top, a, np.arange(a, len(self.boxes[top][0])))


def leader_pairs(tree: CountTree, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the first leader that it may link to; rows without one become leaders."""
    a, b = [], []
    left = np.argsort(ids, kind="stable")
    while len(left):
        leader, left = left[0], left[1:]
        near = tree.partners(int(leader), left)
        a.append(np.full(len(near), ids[leader]))
        b.append(ids[near])
        left = left[~np.isin(left, near)]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def open_pairs(tree: CountTree, ids: np.ndarray, roots: np.ndarray, own: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that may link and lie in different components, but for those known to share a smaller tree than `number`."""
    a, b = [], []
    for i, near in tree.pairs():
        near = near[roots[near] != roots[i]]
        smaller = own[i][own[i] < number]
        if len(near) and len(smaller):
            near = near[~np.isin(own[near], smaller).any(1)]
        a.append(np.full(len(near), ids[i]))
        b.append(ids[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def visit_trees(rows: pd.DataFrame, rooted: bool, percent: int) -> pd.DataFrame:
    """Pairs of all trees in `rows`, which come in order of tree."""
    tree, ids, sizes = (rows[c].to_numpy(np.int64) for c in ("tree", "cid", "n"))
    points = read_points(rows["counts"].tolist())
    roots = rows["root"].to_numpy(np.int64) if rooted else None
    first = np.full((len(rows) if rooted else 0, OWN_TREES), np.iinfo(np.int64).max)
    for k in range(len(first)):
        found = rows["own"].iloc[k]
        first[k, : len(found)] = found
    starts = np.concatenate(([0], np.flatnonzero(tree[1:] != tree[:-1]) + 1, [len(tree)]))
    count = np.diff(starts)
    # Trees of two points are one comparison each, and are done together.
    two = starts[:-1][count == 2]
    bound = np.minimum(points[two], points[two + 1]).sum(1)
    ok = (100 + percent) * bound >= percent * (sizes[two] + sizes[two + 1])
    if rooted:
        ok &= roots[two] != roots[two + 1]
    two = two[ok]
    out = [(ids[two], ids[two + 1], tree[two], np.zeros(len(two), bool))]
    for k in np.flatnonzero(count > 2):
        own = slice(starts[k], starts[k + 1])
        made = CountTree(points[own], sizes[own], percent)
        a, b = open_pairs(made, ids[own], roots[own], first[own], tree[starts[k]]) if rooted else leader_pairs(made, ids[own])
        out.append((a, b, np.full(len(a), tree[starts[k]]), np.ones(len(a), bool)))
    a, b, t, again = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "tree": t, "again": again})[a != b]


def frequent_shingles(docs: DataFrame, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, blocks): sorted shingles that many documents hold, with the number of blocks each needs.

    They only steer the order of shingles, in which any choice is right; one document in
    `every` is looked at, by a hash of its text. At most MOST_FREQUENT numbers reach the driver.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0).select("text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [shingle_set(t) for t in part["text"]]
            s, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"s": s.view(np.int64), "n": n})

    found = (
        some.mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).toPandas()
    )
    s = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], -(-found["n"].to_numpy(np.int64)[order] * every // BLOCK)


def row_key() -> Column:
    """One number for rows of equal id and text; the id may be null."""
    return F.xxhash64("doc_id", "text")


def maybe_in(key: Column, ids: DataFrame) -> Column:
    """Whether a key may be among `ids`: false only where it is not.

    A bitmap of FILTER_BITS bits, whatever the number of ids: it is put together on the
    cluster and reaches the driver as at most FILTER_BITS / 32 words.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at = bit(ids.columns[0])
    words = (
        ids.select(F.shiftright(at, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({ids.columns[0]}), 32) as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(place: pd.Series) -> pd.Series:
        x = place.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 5] >> (x & 31).astype(np.uint32) & 1).astype(bool))

    return test(bit(key))


def across(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, cid, root): the trees in which rows of one shingle's different blocks meet, if their components differ.

    `sets` has cid and wide, `roots` the components so far. Rows outside a shingle's largest component
    go into each of its blocks, all others into their own. The list of shingles that
    still hold several components has at most MOST_FREQUENT rows, so it is broadcast.
    """
    rows = (
        sets.select("cid", F.explode("wide").alias("s")).join(roots.withColumnRenamed("id", "cid"), "cid", "left")
        .select("s", "cid", F.coalesce("root", "cid").alias("root"))
    )
    mixed = (
        rows.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("s")
        .agg(F.sum("n").alias("total"), F.max(F.struct("n", "root")).alias("top")).filter(F.col("total") > F.col("top.n"))
        .select("s", F.col("top.root").alias("major"), F.ceil(F.col("total") / BLOCK).alias("all"), F.ceil((F.col("total") - F.col("top.n")) / BLOCK).alias("few"))
    )
    place = lambda salt, count: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    dealt = rows.join(F.broadcast(mixed), "s")
    target = dealt.select("s", "cid", "root", each("few").alias("i"), place(1, "all").alias("j"))
    source = dealt.filter("root <> major").withColumn("i", place(2, "few")).select("s", "cid", "root", "i", each("all").alias("j"))
    both = target.unionByName(source)
    return both.select(F.xxhash64("s", "i", "j", F.lit(3)).alias("tree"), "cid", "root")


def link_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of `docs` (needs doc_id, text)."""
    docs = docs.select("doc_id", "text")

    def build() -> DataFrame:
        described, named = _link(docs, percent)
        return (
            described.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
            .join(named.select("cid", "component_id"), "cid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        )

    return finished(docs.sparkSession, build, "jaccard")


def first_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, once): the `row_key` of the first row of each component, by id with null ids last, and of rows without words.

    `once` tells that several rows have the key and are one document; rows without id and
    words link with nothing, so they stay apart.
    """
    docs = docs.select("doc_id", "text")

    def build() -> DataFrame:
        described, named = _link(docs, percent)
        keys = described.groupBy("key").agg(F.max("n").alias("n"), F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
        firsts = named.filter("key = first").select("key", F.lit(True).alias("named"))
        return (
            keys.join(firsts, "key", "left").filter("named or n = 0")
            .select("key", F.expr("rows > 1 and (n > 0 or doc_id is not null)").alias("once"))
        )

    return finished(docs.sparkSession, build, "firsts")


def _link(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each row of `docs` with its class and point; each class with its own first row, its component's name and first row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(docs))
    first = lambda doc_id: F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "key")).alias("x")

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, blocks = shared.value
        for part in parts:
            rows = []
            for t in part["text"]:
                s = shingle_set(t)
                own = set_id(s) if len(s) else 0
                keys, wide = dealt_keys(s, own & 0x7FFFFFFFFFFFFFFF, frequent, blocks, percent) if len(s) else (s, s)
                rows.append((own, len(s), stored_point(s), keys.view(np.int64), wide.view(np.int64)))
            out = pd.DataFrame(rows, columns=["cid", "n", "counts", "keys", "wide"])
            yield pd.concat([part[["id", "named", "key"]], out], axis=1)
        give_back()

    # Among nulls pandas would turn ids into floating-point numbers.
    given = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("named"), row_key().alias("key"), "text")
    described = saved(
        given.mapInPandas(describe, "id long, named boolean, key long, cid long, n long, counts binary, keys array<long>, wide array<long>")
        .select(F.when(F.col("named"), F.col("id")).alias("doc_id"), "key", "cid", "n", "counts", "keys", "wide"),
        "shingles",
    )
    classes = saved(described.filter("n > 0").groupBy("cid").agg(first("doc_id")).select("cid", F.col("x.id").alias("rep"), "x.key"), "classes")

    # Trees with at least two classes, as lists of class numbers.
    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("members", pa.list_(pa.int64()))])
        seen: set[bytes] = set()
        last_key, last = None, np.zeros(0, np.int64)

        def lists(key: np.ndarray, cid: np.ndarray) -> list[np.ndarray]:
            new = np.flatnonzero((key[1:] != key[:-1]) | (cid[1:] != cid[:-1])) + 1
            at = np.concatenate(([0], new))
            key, cid = key[at], cid[at]
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            many = np.flatnonzero(np.diff(starts) > 1)
            found = []
            for k in many:
                own = cid[starts[k] : starts[k + 1]]
                mark = blake2b(own.tobytes(), digest_size=16).digest()
                if mark not in seen:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(mark)
                    found.append(own)
            return found

        def batch(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], schema=kind)

        for part in parts:
            key, cid = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(key):
                continue
            if last_key is not None:
                key, cid = np.concatenate((np.full(len(last), last_key), key)), np.concatenate((last, cid))
            # The last key may go on in the next batch.
            cut = np.searchsorted(key, key[-1])
            last_key, last = key[-1], np.unique(cid[cut:])
            if cut:
                yield batch(lists(key[:cut], cid[:cut]))
        if last_key is not None and len(last) > 1:
            yield batch(lists(np.full(len(last), last_key), last))
        seen.clear()
        give_back()

    dealt = described.select("cid", F.explode("keys").alias("key")).select("key", "cid")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = (
        dealt.repartition(width, "key").sortWithinPartitions("key", "cid")
        .mapInArrow(gather, "members array<long>")
        .distinct()
    )
    # Should two lists share a number, they are one larger tree, which loses no pair.
    members = saved(lists.select(F.xxhash64("members").alias("tree"), F.explode("members").alias("cid")), "trees")

    # The point of each class in a tree or in blocks, from the row that names the class.
    blocked = described.filter(F.size("wide") > 0).select("cid")
    wanted = members.select("cid").unionByName(blocked).distinct().join(classes.select("cid", "key"), "cid")
    points = saved(
        described.filter("n > 0").select("cid", "key", "n", "counts", "wide").join(wanted, ["cid", "key"]).dropDuplicates(["cid", "key"]),
        "points",
    )

    def pairs_of(rows: DataFrame, rooted: bool) -> DataFrame:
        """(a, b, tree, again): pairs that may link; `again` where the tree holds more that were not looked at."""

        def visit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for part in batches:
                tree = part["tree"].to_numpy()
                cut = int(np.searchsorted(tree, tree[-1])) if len(tree) else 0
                # The last tree may go on in the next batch.
                if cut or (held and held[0]["tree"].iloc[0] != tree[-1]):
                    yield visit_trees(pd.concat([*held, part.iloc[:cut]]), rooted, percent)
                    held = []
                held.append(part.iloc[cut:])
            if held:
                yield visit_trees(pd.concat(held), rooted, percent)
            held.clear()
            give_back()

        return rows.repartition(width, "tree").sortWithinPartitions("tree").mapInPandas(visit_all, "a long, b long, tree long, again boolean")

    def verified(pairs: DataFrame) -> DataFrame:
        bodies = sets_of(pairs)
        left = bodies.select(F.col("cid").alias("a"), F.col("shingles").alias("_x"))
        right = bodies.select(F.col("cid").alias("b"), F.col("shingles").alias("_y"))
        both = F.size(F.array_intersect("_x", "_y"))
        linked = F.lit(100) * both >= F.lit(percent) * (F.size("_x") + F.size("_y") - both)
        return pairs.join(left, "a").join(right, "b").select("a", "b", linked.alias("linked"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The shingles of every class in `pairs`; only texts that may be among them are shuffled."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(points.select("cid", "key"), "cid")

        def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"cid": part["cid"], "shingles": [shingle_set(t).view(np.int64) for t in part["text"]]})
            give_back()

        few = docs.select(row_key().alias("key"), "text").filter(maybe_in(F.col("key"), ids.select("key")))
        # Rows of one id and text are equal; they are put together before the shuffle.
        rows = few.groupBy("key").agg(F.min("text").alias("text")).join(ids, "key")
        return saved(rows.select("cid", "text").mapInPandas(make, "cid long, shingles array<long>"), "sets")

    rows = members.join(points, "cid").select("tree", "cid", "n", "counts")
    near = saved(pairs_of(rows, False), "pairs")
    checked = saved(verified(near.select("a", "b").distinct()), "pairs")
    roots = components(checked.filter("linked"))
    rooted = members.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("tree", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = rooted.groupBy("tree").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("tree")
    open_trees = near.filter("again").select("tree").distinct().join(mixed, "tree")
    left = saved(rooted.join(open_trees, "tree").unionByName(across(points.select("cid", "wide"), roots)).distinct(), "open")
    by_tree = F.row_number().over(Window.partitionBy("cid").orderBy("tree"))
    own = left.select("cid", "tree", by_tree.alias("r")).filter(F.col("r") <= OWN_TREES).groupBy("cid").agg(F.collect_list("tree").alias("own"))
    placed = points.select("cid", "n", "counts").join(own, "cid")
    second = pairs_of(left.join(placed, "cid"), True).select("a", "b").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    second = saved(verified(saved(second, "pairs")), "pairs")
    # The components of the first round go on as stars.
    stars = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
    roots = components(stars.unionByName(second.filter("linked").select("a", "b")))
    placed = saved(classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "classes")
    names = placed.groupBy("root").agg(first("rep")).select("root", F.col("x.id").alias("component_id"), F.col("x.key").alias("first"))
    return described, placed.join(names, "root").select("cid", "key", "component_id", "first")
