"""Whitening, repeated strings and lexical search against plain versions, with odd inputs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipwatch.llm import bucket_refine, contour_whitening, dual_tree, queries

SMALL = "/root/testdata/sf0.001"

# Whitening


def plain_whitening(vectors, k=8):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, y @ vecs / np.sqrt(values), values / np.trace(cov)


def check_whitening(rows, ids, vectors, k=8):
    n, deviation, white, share = plain_whitening(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == n * white.shape[1]
    for c in range(white.shape[1]):
        got = np.array([by[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got * sign - white[:, c]).max() < 1e-8
        first = by[ids[0], c + 1]
        assert first["n"] == n and first["explained"] == pytest.approx(share[c], rel=1e-10) and first["identity_error"] < 1e-9
    assert [by[i, 1]["deviation"] for i in ids] == deviation


def test_whitening_query(spark):
    data = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = queries.QUERIES["op11_whitening"](spark, SMALL).collect()
    check_whitening(rows, [r["vec_id"] for r in data], [r["embedding"] for r in data])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(0, 0.3, (40, 5)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(100 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string")
    got = contour_whitening.whitened_components(df, 3).collect()
    check_whitening(got, list(range(40)), good, 3)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    empty = contour_whitening.whitened_components(make([]))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert contour_whitening.whitened_components(make([(1, [0.5, 0.25])])).count() == 0
    assert contour_whitening.whitened_components(make([(1, [0.5, 0.25]), (None, [0.5, 0.25])])).count() == 0
    # Two different rows span one direction; repeated rows and rows without an id stay.
    line = contour_whitening.whitened_components(make([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.0, 1.0])])).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in line) == [(False, 1), (False, 1), (True, 1)]
    assert all(r["explained"] == pytest.approx(1) and r["identity_error"] < 1e-12 for r in line)


@pytest.mark.parametrize("kind", ["plain", "equal", "pairs", "flat", "steep", "one"])
def test_components_equal_a_dense_solver(kind):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    a = rng.standard_normal((48, 400))
    matrix = {
        "plain": a @ a.T / 400,
        "equal": np.eye(48) * 3,
        "pairs": (turn * np.repeat(np.arange(1.0, 25), 2)) @ turn.T,
        "flat": a[:, :2] @ a[:, :2].T,
        "steep": (turn * 10.0 ** -np.linspace(0, 12, 48)) @ turn.T,
        "one": np.array([[2.5]]),
    }[kind]
    matrix = (matrix + matrix.T) / 2
    values, vectors = contour_whitening.components(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][: {"flat": 2, "one": 1}.get(kind, 8)]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_intervals_count_every_eigenvalue():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 90))
    matrix = a @ a.T
    values = np.linalg.eigvalsh(matrix)
    cuts = contour_whitening.intervals(matrix, 8)
    assert sum(c for _, _, c in cuts) >= 8
    for low, high, count in cuts:
        assert ((values > low) & (values <= high)).sum() == count


# Repeated strings


def plain_repeats(docs, length=100):
    """docs in order; returns (bytes, removed, spans, kept) of each."""
    seen, out = set(), []
    for text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        n_spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if raw else 0
        out.append((len(raw), int(gone.sum()), n_spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def removed(df, **options):
    return {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in bucket_refine.remove_repeats(df, **options).collect()}


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéfgh"), rng.integers(1, 8))) for _ in range(n))


def awkward_texts(seed):
    rng = np.random.default_rng(seed)
    passage, other = prose(rng, 60), prose(rng, 40)
    texts = [prose(rng, int(rng.integers(0, 80))) for _ in range(25)]
    for k in range(30):
        cut = int(rng.integers(0, 120))
        texts.append(prose(rng, int(rng.integers(0, 20))) + passage[cut : cut + int(rng.integers(60, 260))] + prose(rng, int(rng.integers(0, 9))))
    texts += [passage, passage, passage[:99], passage[:100], None, "", "z" * 700, "z" * 150, "ab" * 300, "ba" * 120, other + passage + other]
    texts += [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in texts[:6]]
    return texts


@pytest.mark.parametrize("seed, limit", [(1, 2000), (2, 3), (3, 1)])
def test_repeats_equal_plain(spark, seed, limit):
    texts = awkward_texts(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    assert removed(df, limit=limit) == dict(enumerate(plain_repeats(texts)))


def test_repeats_of_other_lengths(spark):
    texts = awkward_texts(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(df, length=30, gram=9, limit=5) == dict(enumerate(plain_repeats(texts, 30)))


def test_repeats_across_blocks(spark, monkeypatch):
    """Long texts are read in blocks; a border changes nothing."""
    rng = np.random.default_rng(9)
    piece = prose(rng, 400)
    texts = [piece + prose(rng, 300) + piece[37:], prose(rng, 50) + piece[500:900]]
    want = dict(enumerate(plain_repeats(texts)))
    for block in (256, 512):
        monkeypatch.setattr(bucket_refine, "BLOCK", block)
        monkeypatch.setattr(bucket_refine, "_PLACE", np.uint64(2 * block - 1))
        raw = [t.encode() for t in texts]
        found = []
        for d, b in enumerate(raw):
            b = np.frombuffer(b, np.uint8)
            for at in range(0, len(b) - 99, block):
                part = b[at : at + block + 99]
                start, n, *_ = bucket_refine.runs(part, np.zeros(len(part), bool), 100, 32)
                found += [(d, at + s, k) for s, k in zip(start, n)]
        assert sorted((d, s + j) for d, s, k in found for j in range(k)) == [(d, p) for d, b in enumerate(raw) for p in range(len(b) - 99)]
    assert removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == want


@pytest.mark.parametrize("parts", [1, 6])
def test_repeats_order_of_odd_ids(spark, parts):
    """Rows without an id come last; a repeated row is a copy; one id on two texts is two documents."""
    rng = np.random.default_rng(8)
    a, b = prose(rng, 60), prose(rng, 60)
    df = spark.createDataFrame([(None, a), (5, a), (5, a), (5, b), (7, b), (None, "short")], "doc_id long, text string").repartition(parts)
    rows = sorted(((r["doc_id"] is None, r["doc_id"], r["n_bytes"], len(r["kept"])) for r in bucket_refine.remove_repeats(df).collect()))
    n, m = len(a.encode()), len(b.encode())
    assert rows == sorted([(False, 5, n, n), (False, 5, n, 0), (False, 5, m, m), (False, 7, m, 0), (True, None, n, 0), (True, None, 5, 5)])
    empty = bucket_refine.remove_repeats(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "kept", "spans"]


def test_a_span_that_is_everywhere_is_dealt_once_a_batch(spark):
    df = spark.createDataFrame([(i, "z" * 900 + "ab" * 200) for i in range(300)], "doc_id long, text string").coalesce(2)
    rows = bucket_refine.suffixes(bucket_refine._keyed(df), 100, 32)
    dealt = rows.filter("not gone").groupBy("h", "g").count().agg(F.max("count")).first()[0]
    assert rows.count() > 100_000 and dealt <= 2
    kept = removed(df)
    assert kept[0][1] > 1000 and all(v[1] == 1300 for k, v in kept.items() if k)


def test_large_buckets_are_refined(spark):
    """One passage in many different surroundings: no task compares more than `limit` spans."""
    rng = np.random.default_rng(10)
    passage = prose(rng, 14)[:80]
    texts = [prose(rng, 12) + passage + prose(rng, 12) for _ in range(400)] + [prose(rng, 3) + passage[:75] + "tail" * 20 for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = []
    real = bucket_refine.compared

    def spy(rows, length):
        sizes.append(max([0, *(r["count"] for r in rows.groupBy("key").count().collect())]))
        return real(rows, length)

    bucket_refine.compared = spy
    try:
        got = removed(df, limit=50)
    finally:
        bucket_refine.compared = real
    assert got == dict(enumerate(plain_repeats(texts))) and len(sizes) > 1 and max(sizes) <= 50


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_ranking(docs, items, k=50):
    """docs and items are (id, text); rows (item_id, rank, doc_id, score)."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_all = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = set(terms(text)), []
        for d, b in bags:
            if not b:
                continue
            m = 50 + (50 * sum(b.values()) * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in asked if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def ranking(spark, docs, items, k=50, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d, i = d.withColumn("id", F.lit(1)).withColumn("score", F.lit("x")), i.withColumn("terms", F.lit(0))
    return sorted(map(tuple, dual_tree.rank_documents(d, i, k).collect()), key=repr)


def test_search_equals_plain(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words = [f"w{n}" for n in range(120)] + ["Éa", "éA", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(words, n)) if n else ""
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[5][1]) for i in range(80)] + [(None, docs[7][1]), (None, None), (3, "W1,w1;W2"), (9000, "~!"), (9001, "w1 " * 5000)]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(70)] + [(5, docs[5][1]), (5, docs[7][1]), (900, None), (901, "..."), (902, "unheard")]
    want = sorted(plain_ranking(docs, items, 20), key=repr)
    # Two equal items are two rows each.
    assert ranking(spark, docs, items, 20, extra=True) == want
    monkeypatch.setattr(dual_tree, "BLOCK_ITEMS", 9)
    assert ranking(spark, docs, items, 20) == want


def test_search_of_little(spark):
    assert ranking(spark, [], [(1, "a")]) == []
    assert ranking(spark, [(1, "a")], []) == []
    assert ranking(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert ranking(spark, [(1, "a b"), (2, "b")], [(1, "A")]) == sorted(plain_ranking([(1, "a b"), (2, "b")], [(1, "A")]), key=repr)


def test_search_prunes():
    """Bounds leave out most pairs where an item's terms sit in few documents."""
    rng = np.random.default_rng(13)
    n_docs = 4096
    items = dual_tree.arrange(list(range(32)), [[f"t{12 * i + j}".encode() for j in range(10)] for i in range(32)])
    term = np.sort(rng.integers(0, len(items.words), (n_docs, 4)) // 12 * 12 % len(items.words), axis=1)
    search = dual_tree.Search(items, np.full(len(items.words), 1000.0), 5)
    doc, flat = np.repeat(np.arange(n_docs), 4), term.ravel()
    search.add(np.zeros(n_docs, np.int64), np.arange(n_docs), flat, doc, rng.integers(1000, 900_000, len(flat)))
    assert search.scored < search.pairs / 3


def test_a_passage_of_many_texts_goes_on_as_few_rows(spark, monkeypatch):
    """Halving a bucket that thousands of texts share gives no row for each text and string."""
    made, old = [], bucket_refine.saved
    monkeypatch.setattr(bucket_refine, "saved", lambda df, kind="step": made.append((kind, old(df, kind))) or made[-1][1])
    rng = np.random.default_rng(12)
    passage = prose(rng, 60)[:160]
    texts = [prose(rng, 12) + "#" + passage + "#" + prose(rng, 12) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(df, limit=20) == dict(enumerate(plain_repeats(texts)))
    rows = [df.count() for kind, df in made if kind == "buckets"]
    assert len(rows) > 1 and sum(rows[1:]) <= 12 * rows[0], rows
