"""Operators over whole tables against plain versions: shards, search, mix, links, joins, pipeline."""

import glob
import math
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipwatch.llm import balanced_shards, bit_search, count_tree, itq_links, queries, shingles, source_mix
from slipwatch.llm.common import components

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 80)]
    sets = Sets({x for p in pairs for x in p})
    for a, b in pairs:
        sets.join(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Shards


def shard(spark, rows, shards=6):
    df = spark.createDataFrame(rows, "doc_id long, link string, shard string, _n int")
    order = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [r.asDict() for r in balanced_shards.shard_documents(df, F.col("link"), order, shards).collect()]


def assert_law(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n and set(by) <= set(range(shards))
    counts = [len(by[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("kind", ["mixed", "all pairs", "one group", "alone"])
def test_shards_are_even_and_keep_links(spark, kind):
    n = 600
    link = {
        "mixed": lambda i: "hot" if i % 3 == 0 else f"g{i // 5}" if i % 2 else None,
        "all pairs": lambda i: f"g{i // 2}", "one group": lambda i: "all", "alone": lambda i: None,
    }[kind]
    rows = shard(spark, [(i, link(i), "x", 1) for i in range(n)])
    assert_law(rows, n, 6)
    spread = defaultdict(set)
    for r in rows:
        if r["link"]:
            spread[r["link"]].add(r["shard"])
    small = [v for k, v in spread.items() if k not in ("hot", "all")]
    if small:
        assert sum(len(v) == 1 for v in small) / len(small) > 0.8
    if kind == "mixed":
        assert len(spread["hot"]) <= 4  # a third of all rows needs two of six shards


def test_shards_odd_tables(spark):
    assert shard(spark, []) == []
    assert_law(shard(spark, [(1, "a", "x", 1)] * 7 + [(None, None, None, None)] * 4, 5), 11, 5)
    assert_law(shard(spark, [(1, "a", "x", 1), (2, "a", "x", 1)], 24), 2, 24)


def test_shard_query(spark):
    rows = [r.asDict() for r in queries.QUERIES["op2_shards"](spark, SMALL).collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert_law(rows, len(docs), 24)
    assert {(r["doc_id"], r["size"]) for r in rows} == {(d["doc_id"], len((d["text"] or "").encode()) + 8) for d in docs}
    assert {r["law"] for r in rows} == {"rows"}


# Search


def test_search_finds_the_nearest(spark):
    index = bit_search.build_index(spark.read.parquet(f"{MEDIUM}/embeddings.parquet"))
    rows = bit_search.nearest(index, F.col("vec_id") % 20 == 0).collect()
    data = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data])
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        score = (x * x[ids == q]).sum(1)
        score[ids == q] = -np.inf
        want = np.lexsort((ids, -score))[:20]
        hits += len(set(ids[want]) & {v for v, _ in got})
        assert len(got) == 20
        assert all(abs(score[ids == v][0] - s) < 1e-12 for v, s in got)
    assert hits / (20 * len(found)) >= 0.99


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.5, 0.5]), (6, [0.0, 0.0]), (7, None), (8, [nan, 1.0]),
        (9, [inf, 1.0]), (10, []), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [None, 1.0]), (5, [0.5, 0.5]), (11, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, code string")
    got = sorted(map(tuple, bit_search.nearest(bit_search.build_index(df), F.col("vec_id") % 20 == 0, 3).collect()))
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0)]
    assert bit_search.nearest(bit_search.build_index(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


# Mix


def plain_targets(sizes):
    """Shares dealt again and again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def mixed(spark, rows):
    return [r.asDict() for r in source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size string")).collect()]


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "a", "b", "c", "hot", "hot", "hot", "ü"][i % 8], "x") for i in range(900)]
    rows += [(5000, None, "empty", "x"), (5001, "", "empty", "x"), (5002, "one two", "b", "x"), (5002, "one two", "b", "x"), (None, "n n n", "a", "x")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(WORD.findall(r["text"] or ""))
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, mixed(spark, rows[::-1])))


@pytest.mark.parametrize("marks", [0, 1, 3])
def test_mix_cells_stay_small(spark, marks):
    """Whatever the weight, no cell of the key range holds much of a source."""
    n, cells = 200_000, source_mix.CELLS
    key = -F.log(source_mix.uniform(F.col("id"))) * F.lit(1.0 + 4.0 * marks)
    cell = F.floor(F.log2(key) * cells)
    most = spark.range(n).groupBy(cell.alias("cell")).count().agg(F.max("count")).first()[0]
    assert most < 2.5 * n * math.log(2) / math.e / cells


def test_own_columns_do_not_clash(spark):
    """Columns with the names that the operators use inside come back as they were."""
    names = ["_key", "_src", "_cell", "_given", "_id", "_part", "_link", "_piece", "_order", "_r", "_s", "_c", "_n", "_start", "_spans"]
    rows = [(i, f"w{i} x y z", "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in [("doc_id", "long"), ("text", "string"), ("source", "string"), *[(c, "string") for c in names]]))
    made = source_mix.mix_sources(docs)
    sent = source_mix.emit_mix(made, columns=docs.columns)
    dealt = balanced_shards.shard_documents(docs, F.col("source"), F.col("doc_id").cast("string"), 4)
    for out in (made, sent, dealt):
        found = out.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in names)


def test_mix_rows_and_nothing(spark):
    docs = spark.createDataFrame([(i, f"w{i} x\ty  z{i}", "ab"[i % 2], 9) for i in range(30)], "doc_id long, text string, source string, n_chars long")
    made = source_mix.mix_sources(docs)
    rows = source_mix.emit_mix(made, columns=docs.columns).collect()
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({r["doc_id"]: r["taken"] for r in made.collect() if r["taken"]})
    assert source_mix.mix_sources(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixed(spark, [(1, None, None, "x")])] == [0]


# Vector links


def plain_links(rows, least=0.93):
    by = {i: (lab, np.array(v, float)) for i, v, lab in rows}
    sets, links = Sets(by), Counter()
    ids = sorted(by)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            (p, x), (q, y) = by[i], by[j]
            if p == q and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    return {(i, links[i], sets.find(i)) for i in ids}


@pytest.mark.parametrize("cell,crowd,dense", [(4096, 1 << 14, 16), (16, 1 << 14, 1e-6), (16, 24, 1e9)])
def test_links_equal_brute_force(spark, monkeypatch, cell, crowd, dense):
    monkeypatch.setattr(itq_links, "CELL", cell)
    monkeypatch.setattr(itq_links, "DENSE", dense)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(500):
        if i % 2 and i > 20:
            # Neighbours around the threshold, chains among them.
            base = np.array(rows[int(rng.integers(0, i))][1])
            v = base + rng.normal(size=32) * np.linalg.norm(base) * rng.choice([0.0, 0.01, 0.05, 0.066, 0.07]) * 1.0
        else:
            v = rng.normal(size=32) * rng.choice([1e-3, 1.0, 50.0])
        rows.append((i, [float(np.float32(a)) for a in v], int(rng.integers(0, 2)) if i % 3 else 0))
    want = plain_links(rows)
    got = itq_links.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), crowd=crowd)
    found = {tuple(r) for r in got.collect()}
    assert {w[0] for w in want} == {g[0] for g in found}
    assert sum(n for _, n, _ in want) > 400
    assert found == want


def test_links_of_a_crowd(spark):
    """Copies of one vector with a little noise share every cell; they are dealt in blocks, and no link is lost."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=64) + rng.normal(size=(5000, 64)) * 0.2
    x = np.concatenate([x, rng.normal(size=(300, 64))]).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq_links.link_vectors(rows, crowd=1000).collect()}
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert want[:5000].max() > 4000 and [got[i][0] for i in range(len(x))] == want.tolist()
    least = np.arange(len(x))
    while True:
        now = np.minimum(least, np.where(near, least, len(x)).min(1))
        if (now == least).all():
            break
        least = now
    assert [got[i][1] for i in range(len(x))] == least.tolist()


def test_links_leave_and_hold_few_shuffle_files(spark, monkeypatch):
    """Blocks are dealt in rounds of about two copies of each vector, and the files of a round go with its end."""
    rng = np.random.default_rng(13)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(2000, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    kinds, saved = [], itq_links.saved

    def shuffled():
        return {f: os.path.getsize(f) for d in folder for f in glob.glob(f"{d}/*/shuffle_*.data")}

    monkeypatch.setattr(itq_links, "saved", lambda df, kind="step": kinds.append(kind) or saved(df, kind))
    before = shuffled()
    assert itq_links.link_vectors(df, crowd=400).count() == 2000
    # Ten blocks are ten copies.
    assert kinds.count("links") == 5
    until = time.time() + 20
    while (left := sum(n for f, n in shuffled().items() if f not in before)) > 100_000 and time.time() < until:
        time.sleep(0.2)
    assert left <= 100_000 < 2000 * 64 * 4


def test_links_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [None, 1.0], 1), (11, [], 1), (None, [1.0, 0.0], 1)]
    got = itq_links.link_vectors(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, rep int"))
    want = {(1, 2, 1), (2, 2, 1), (9, 2, 1)} | {(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 10, 11)}
    assert {tuple(r) for r in got.collect()} == want
    assert itq_links.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# Jaccard join


def plain_join(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    joined, holders = Sets(sets), defaultdict(list)
    for i in sorted(sets):
        common = Counter()
        for s in sets[i]:
            common.update(holders[s])
            holders[s].append(i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                joined.join(i, j)
    return {(i, len(sets[i]), joined.find(i)) for i in sets}


@pytest.fixture(scope="module")
def near_texts():
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = []
    for i in range(300):
        n = int(rng.integers(1, 120))
        if i % 3 == 0 and i > 30:
            words = texts[int(rng.integers(0, i))][1].split()
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 9)}"
        else:
            words = [f"w{rng.integers(0, 40 if i % 5 else 3)}" for _ in range(n)]
            if i % 4 == 0:
                words = passage.split() + words
        texts.append((i, ("\t" if i % 2 else "  ").join(words)))
    base = [f"h{k}" for k in range(100)]
    for i in range(300, 420):  # a large group of near copies
        words = list(base)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 100))] = f"x{rng.integers(0, 1000)}"
        texts.append((i, " ".join(words).upper() if i % 2 else " ".join(words)))
    return texts + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "É a b c"), (906, "é a b c"), (907, "x " * 30_000)]


@pytest.mark.parametrize("block", [2048, 8])
def test_join_equals_brute_force(spark, monkeypatch, near_texts, block):
    monkeypatch.setattr(count_tree, "BLOCK", block)
    monkeypatch.setattr(count_tree, "EVERY", 2)
    df = spark.createDataFrame([(i, t, 0) for i, t in near_texts], "doc_id long, text string, n int")
    got = {tuple(r) for r in count_tree.link_documents(df).collect()}
    want = plain_join(near_texts)
    assert got == want
    assert len({w[2] for w in want}) < len(want) - 100


def test_tree_pairs_hold_every_link():
    rng = np.random.default_rng(5)
    base = rng.poisson(1.0, (30, 64))
    points = np.maximum(0, base[rng.integers(0, 30, 400)] + rng.integers(-1, 2, (400, 64)) * (rng.random((400, 64)) < 0.1)).astype(np.int32)
    sizes = points.sum(1).astype(np.int64)
    tree = count_tree.CountTree(points, sizes)
    got = [(min(i, int(j)), max(i, int(j))) for i, near in tree.pairs() for j in near]
    assert len(got) == len(set(got))
    want = {
        (i, j) for i in range(400) for j in range(i + 1, 400)
        if 180 * np.minimum(points[i], points[j]).sum() >= 80 * (sizes[i] + sizes[j]) and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])
    }
    assert set(got) == want


def test_dealing_is_linear_in_a_group(spark, monkeypatch):
    """Near copies of one text over many blocks: each goes into one tree a shingle, and all are one component."""
    monkeypatch.setattr(count_tree, "BLOCK", 16)
    monkeypatch.setattr(count_tree, "EVERY", 1)
    made, old = [], count_tree.saved
    monkeypatch.setattr(count_tree, "saved", lambda df, kind="step": made.append((kind, old(df, kind))) or made[-1][1])
    monkeypatch.setattr(count_tree, "finished", lambda spark, build, kind: build())
    rng, base, dealt = np.random.default_rng(3), [f"g{k}" for k in range(200)], {}
    for size in (100, 400):
        rows = []
        for i in range(size):
            words = list(base)
            words[int(rng.integers(0, 200))] = f"y{i}"
            rows.append((i, " ".join(words)))
        made.clear()
        assert {r["component_id"] for r in count_tree.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
        steps = {kind: df for kind, df in made}
        dealt[size] = sum(len(r["keys"]) for r in next(df for kind, df in made if kind == "shingles").collect())
        assert steps["open"].count() == 0
    assert dealt[400] <= 4.5 * dealt[100]


def test_points_of_very_long_texts():
    many = np.arange(20_000_000, dtype=np.uint64)
    long, short = shingles.point(many), shingles.point(many[:1000])
    assert long.dtype == np.uint32 and short.dtype == np.uint16
    read = shingles.read_points([long.tobytes(), short.tobytes()])
    assert (read.sum(1) == [20_000_000, 1000]).all() and (read[0] == long).all()


def test_join_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert count_tree.link_documents(df([])).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, "A B C D E F")]
    got = sorted(map(tuple, count_tree.link_documents(df(rows)).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (7, 2, 3), (None, 2, 3)], key=str)


def test_join_links_rows_without_id(spark):
    base = [f"n{k}" for k in range(60)]
    tail = lambda k: " ".join(base[k:])
    # Neither end links with the other, both with the row between them.
    rows = [
        (7, "a b c d e f g h i j k l m n o p q r s t"), (None, "a b c d e f g h i j k l m n o p q r s t u"),
        (20, tail(0)), (None, tail(8)), (21, tail(16)), (None, "quite alone in here"), (2**60 + 1, "a number that is large"), (None, None),
    ]
    alone = [(i, t) for i, t in rows if i in (20, 21)]
    assert {c for _, _, c in plain_join(alone)} == {20, 21}
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, count_tree.link_documents(df).collect()), key=str)
    assert got == sorted([(7, 16, 7), (None, 17, 7), (20, 56, 20), (None, 48, 20), (21, 40, 20), (None, 1, None), (2**60 + 1, 1, 2**60 + 1), (None, 0, None)], key=str)


def test_join_with_one_id_on_two_texts(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "uv")
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " x"), (4, "something else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, count_tree.link_documents(df).collect()))
    assert got == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 1, 4)]


def test_join_on_the_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.QUERIES["op10_jaccard"](spark, MEDIUM).collect()} == plain_join(texts)


def test_steps_of_an_operator_are_removed(spark, tmp_path):
    import os

    from slipwatch.llm.common import checkpoint_dir, finished, saved

    root = checkpoint_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root))

    def build():
        return saved(saved(spark.range(5), "step").withColumn("x", F.col("id") + 1), "step")

    out = finished(spark, build, "result")
    assert sorted(r["x"] for r in out.collect()) == [1, 2, 3, 4, 5]
    assert [x.split("-")[1] for x in set(os.listdir(root)) - before] == ["result"]
    with pytest.raises(ValueError):
        finished(spark, lambda: (_ for _ in ()).throw(ValueError()), "result")


def test_narrow_mix_is_the_same(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 13), [None, "a", "b"][i % 3], "z") for i in range(200)], "doc_id long, text string, source string, more string"
    )
    columns = ["doc_id", "source", "more", "size", "source_size", "target", "taken"]
    wide = source_mix.mix_sources(docs).select(*columns).collect()
    narrow = source_mix.mix_sources(docs, keep_text=False).select(*columns).collect()
    assert sorted(map(tuple, wide), key=repr) == sorted(map(tuple, narrow), key=repr)


def test_points_are_stored_in_as_few_bits_as_will_do():
    sets = [np.arange(n, dtype=np.uint64) for n in (0, 1000, 255 * 256, 256 * 256)]
    stored = [shingles.stored_point(s) for s in sets]
    assert [len(x) for x in stored] == [256, 256, 256, 512]
    read = shingles.read_points(stored)
    assert (read == np.stack([shingles.point(s) for s in sets])).all() and read.dtype == np.int32
