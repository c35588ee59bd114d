"""Ranked lexical search over hierarchies of items and documents (dual-tree branch and bound).

Documents are read once into counts of the items' terms. Tasks then take blocks of documents
and build a tree over each: leaves of LEAF documents, nodes of FAN leaves, and the block, each
with the largest impact of every term below it. Items are in a tree too: all, clusters, single
items, each with the largest weight of every term below it. A pair of nodes is bounded by the
sum of the products of these maxima. Pairs whose bound stays under the weakest k-th score of
the items in the node are dropped with all that is below them; what is left is scored exactly.
Every task keeps the k best of each item, and these are merged in two steps.

All counts, sizes and document frequencies come from all documents. Items are taken in blocks
of bounded size (BLOCK_ITEMS items, BLOCK_TERMS terms, always one item at least), the only data
that is broadcast; each block reads the texts again.

Defined results. A null or empty text, of a document or an item, has no terms; it counts in no
statistic and is in no result. Every row is a document or an item of its own, also with a
repeated or null id; equal scores go by ascending id, null ids last, rows of one id in any
order with equal content. Empty tables give no rows. Columns other than id and text are not
read. A term may be as long as its text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import saved

K = 50
LEAF, FAN, CLUSTER = 32, 16, 16
CELLS = 1 << 23  # terms times documents of a block
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 16
MERGE = 64
# The score of the contract.
WEIGHT, IMPACT, TF, NORM, HALF = 1000, 1_000_000_000, 1000, 20, 50

_TERM = bytearray(b" " * 256)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _TERM[_c] = _c
for _c in range(65, 91):
    _TERM[_c] = _c + 32
TABLE = bytes(_TERM)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and all beyond ASCII; A-Z lower-cased."""
    return text.translate(TABLE).split()


@dataclass
class Items:
    """A block of items: ids, term numbers of each in the order of the tree, and where clusters start."""

    ids: list
    terms: list[np.ndarray]
    words: dict[bytes, int]
    starts: list[int]


def _byte_texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def item_terms(items: DataFrame) -> DataFrame:
    """(id, terms): the distinct terms of every item that has any."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.binary()))], ["id", "terms"])

    rows = _byte_texts(items, "item_id")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(split, f"id {kind}, terms array<binary>").filter(F.size("terms") > 0)


def arrange(ids: list, terms: list[list[bytes]]) -> Items:
    """The item tree: items are halved by their overlap with a pivot until a cluster is small."""
    words: dict[bytes, int] = {}
    numbers = [np.array([words.setdefault(w, len(words)) for w in t], np.int64) for t in terms]
    sets = [set(n.tolist()) for n in numbers]
    order, starts, todo = [], [], [list(range(len(ids)))]
    while todo:
        part = todo.pop()
        if len(part) <= CLUSTER:
            starts.append(len(order))
            order += part
            continue
        pivot = sets[max(part, key=lambda i: (len(sets[i]), -i))]
        part.sort(key=lambda i: (-len(sets[i] & pivot) / len(sets[i]), i))
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return Items([ids[i] for i in order], [numbers[i] for i in order], words, [*starts, len(order)])


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """Blocks of items, each small enough to be broadcast."""
    found = saved(item_terms(items), "items")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-size["terms"] // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    for b in range(blocks):
        rows = sorted(found.filter(block == b).collect(), key=lambda r: (r["id"] is None, r["id"], r["terms"]))
        for at in range(0, len(rows), BLOCK_ITEMS):  # equal items share a hash
            part = rows[at : at + BLOCK_ITEMS]
            yield arrange([r["id"] for r in part], [[bytes(t) for t in r["terms"]] for r in part])


def postings(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): all terms of each document, and how often each of `words` occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            total, sizes, terms, counts = [], [], [], []
            for text in batch.column("text"):
                own = terms_of(text.as_py())
                hits = Counter(map(number, own))
                hits.pop(None, None)
                total.append(len(own))
                sizes.append(len(hits))
                terms += hits.keys()
                counts += hits.values()
            edge = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(total, pa.int64()),
                    pa.ListArray.from_arrays(edge, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(edge, pa.array(counts, pa.int64())),
                ],
                ["id", "n", "terms", "counts"],
            )

    rows = _byte_texts(docs, "doc_id")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n long, terms array<int>, counts array<long>")


def statistics(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents holding each term)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, all_terms, df = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            own = batch.column("n").to_numpy()
            n, all_terms = n + int((own > 0).sum()), all_terms + int(own.sum())
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        term = np.concatenate(([-2, -1], np.flatnonzero(df)))
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.concatenate(([n, all_terms], df[term[2:]])))], ["term", "x"])

    sums = counted.select("n", "terms").mapInArrow(add, "term long, x long").groupBy("term").agg(F.sum("x").alias("x"))
    found = {r["term"]: r["x"] for r in sums.collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(size)], np.int64)


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.float64)


class Search:
    """The k best documents of every item of a block, fed with blocks of documents."""

    def __init__(self, items: Items, weights: np.ndarray, k: int):
        self.items, self.k = items, k
        self.weights = [weights[t] for t in items.terms]
        self.maxima = np.zeros((len(items.starts) - 1, len(weights)))  # of the clusters
        for c, (a, b) in enumerate(zip(items.starts, items.starts[1:])):
            for i in range(a, b):
                self.maxima[c, items.terms[i]] = self.weights[i]
        self.root = self.maxima.max(0, initial=0)
        self.term_weight = weights
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.ids)
        self.floor = np.ones(len(items.ids))  # a document below it cannot be among the k best
        self.scored = self.pairs = 0

    def add(self, late: np.ndarray, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        """A block: order keys of its documents, and (term, document, impact), documents ascending."""
        n, width = len(ids), LEAF * FAN
        # Documents that share their strongest term are neighbours, so a node's maxima stay near its members.
        value = self.term_weight[term] * impact
        lead = np.full(n, -1, np.int64)
        strong = np.zeros(n)
        order = np.lexsort((-value, doc))
        first = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))] if len(order) else order
        lead[doc[first]], strong[doc[first]] = term[first], value[first]
        order = np.lexsort((-strong, lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        late, ids = late[order], ids[order]
        nodes = -(-n // width)
        grid = np.zeros((len(self.term_weight), nodes * width), np.float32)  # impacts are below 2**20
        grid[term, place[doc]] = impact
        leaves = grid.reshape(len(grid), nodes * FAN, LEAF).max(2)
        tops = leaves.reshape(len(grid), nodes, FAN).max(2).astype(np.float64)
        self.pairs += n * len(self.items.ids)
        if (self.root @ tops.max(1)) < self.floor.min():
            return
        bounds = self.maxima @ tops
        for flat in np.argsort(-bounds, axis=None):
            c, node = divmod(int(flat), nodes)
            a, b = self.items.starts[c], self.items.starts[c + 1]
            if bounds[c, node] < self.floor[a:b].min():
                continue
            for i in range(a, b):
                terms, weights = self.items.terms[i], self.weights[i]
                near = weights @ leaves[terms, node * FAN : (node + 1) * FAN]
                hold = np.flatnonzero(near >= self.floor[i])
                if not len(hold):
                    continue
                at = (node * width + hold[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < n]
                score = weights @ grid[np.ix_(terms, at)]
                self.scored += len(at)
                keep = score >= self.floor[i]
                if keep.any():
                    self._merge(i, score[keep].astype(np.int64), late[at[keep]], ids[at[keep]])

    def _merge(self, i: int, score: np.ndarray, late: np.ndarray, ids: np.ndarray) -> None:
        score, late, ids = (np.concatenate(x) for x in zip(self.best[i], (score, late, ids)))
        order = np.lexsort((ids, late, -score))[: self.k]
        self.best[i] = score[order], late[order], ids[order]
        if len(order) == self.k:
            self.floor[i] = score[order[-1]]


def search_block(counted: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item that each task finds."""
    n, all_terms, df = statistics(counted, len(items.words))
    shared = counted.sparkSession.sparkContext.broadcast((items, term_weights(n, df)))
    rows_of_block = max(LEAF * FAN, min(4096, CELLS // max(1, len(items.words))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_of_block):
                part = batch.slice(at, rows_of_block)
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), sizes)
                tf = part.column("counts").flatten().to_numpy()
                own = part.column("n").to_numpy()
                if 100 * n * int(own.max(initial=0)) >= 2**62:
                    raise ArithmeticError("document lengths times documents leave 64 bits")
                m = 100 - HALF + (HALF * own * n) // max(1, all_terms)
                impact = (IMPACT * tf) // (TF * tf + NORM * m[doc])
                ids = part.column("id")
                search.add(
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy().astype(np.int64),
                    part.column("terms").flatten().to_numpy().astype(np.int64), doc, impact,
                )
        for i, (score, late, ids) in enumerate(search.best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(score), pa.int32()), pa.array(ids, pa.int64(), mask=late > 0), pa.array(score)], ["item", "doc_id", "score"]
                )

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        counted = saved(postings(docs, block.words), "postings")
        found = search_block(counted, block, k).withColumn("_m", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "_m"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
