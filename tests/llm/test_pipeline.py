"""The pipeline, stage by stage, against plain versions on the smallest tables plus awkward rows."""

import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_table_operators import WORD, plain_join, plain_targets

import __spark_entry__
import corpus_pipeline as P
from slipwatch.llm import language_mix, piece_codec, secret_scan
from slipwatch.llm.common import saved

SMALL = "/root/testdata/sf0.001"
ODD = [
    (9000, None, "en", "src1", None), (9001, "", None, None, 0), (9002, "12 34 !?", "en", "src2", 8), (9003, "of the and in for", None, None, 17),
    (9004, "the of and. password=abcdef99 rest", "en", None, 33), (9005, "the of and. password=abcdef99 rest", "en", "src3", 33),
]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.schema(P.SCHEMA).parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame(ODD, P.SCHEMA))
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = saved(stage(spark, docs, SMALL), name)
        out.append(docs.collect())
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages_are_as_asked():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "secrets", "mix", "pieces"]
    assert __spark_entry__.queries()["pipeline"] is P.run and P.ORACLE_SQL is None


def test_language_stage(spark, steps):
    docs = spark.createDataFrame(steps[0], P.SCHEMA)
    model = language_mix.learn_languages(docs)
    want = []
    for r in steps[0]:
        lang, _, _ = model.infer(r["text"])
        if lang != "und":
            want.append((r["doc_id"], r["text"], r["lang"] or lang, r["source"], r["n_chars"]))
    assert key(steps[1]) == sorted(want, key=repr)
    assert {9000, 9001, 9002}.isdisjoint(r["doc_id"] for r in steps[1])
    assert len(steps[1]) == len(steps[0]) - 3


def test_duplicate_stage(steps):
    best = {i: c for i, _, c in plain_join([(r["doc_id"], r["text"]) for r in steps[1]])}
    assert key(steps[2]) == key(r for r in steps[1] if best[r["doc_id"]] == r["doc_id"])
    assert len(steps[2]) < len(steps[1])


def test_duplicate_stage_keeps_rows_without_id(spark):
    base = " ".join(f"b{k}" for k in range(40))
    other = " ".join(f"c{k}" for k in range(40))
    rows = [
        (None, base + " x"), (5, base), (6, base + " y"),  # a component with ids
        (None, other), (None, other), (None, other + " x"),  # one without: a single row stays
        (None, "clean and unique"), (None, "another one"), (None, None), (None, ""), (None, ""), (8, ""), (8, ""), (9, "of its own"), (9, "of its own"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], P.SCHEMA).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, SMALL).collect())
    left = got.pop((None, other), 0) + got.pop((None, other + " x"), 0)
    assert left == 1
    assert got == Counter([(5, base), (None, "clean and unique"), (None, "another one"), (None, None), (None, ""), (None, ""), (8, ""), (9, "of its own")])


def test_secret_stage(steps):
    want = []
    for r in steps[2]:
        text, at = "", 0
        for _, s, e in secret_scan.in_order(secret_scan.base_spans(r["text"]) + secret_scan.structured_spans(r["text"])):
            if s >= at:
                text += r["text"][at:s] + "<secret>"
            at = max(at, e)
        text += r["text"][at:]
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert key(steps[3]) == sorted(want, key=repr)
    assert any("<secret>" in r["text"] for r in steps[3])


def plain_mix(rows):
    """Keys, epochs and budgets as the contract says, one source at a time."""
    by = defaultdict(list)
    for r in rows:
        size = len(WORD.findall(r["text"]))
        marks = sum(c in "#$%&*|" for c in r["text"])
        u = (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[r["source"]].append((-math.log(u) * (1 + 4 * marks / max(size, 1)), r["doc_id"], size))
    targets = plain_targets({s: sum(x[2] for x in v) for s, v in by.items()})
    taken = {}
    for s, v in by.items():
        whole = sum(x[2] for x in v)
        epochs = math.floor(targets[s] / max(whole, 1) + 1e-12)
        left = round(targets[s] - epochs * whole)
        for _, i, size in sorted(v):
            part = max(0, min(size, left))
            left -= part
            taken[i] = epochs * size + part
    return taken


def test_mix_stage(steps):
    words = Counter()
    for r in steps[4]:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({k: v for k, v in plain_mix(steps[3]).items() if v})


def test_piece_stage(steps):
    library = piece_codec.table(public_tokenizers.path("piece_bpe_32k.model")).library
    want = []
    for r in steps[4]:
        ids = library.encode(r["text"], add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = library.decode(ids)
        want.append((r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), raw))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["piece_ids"])) for r in steps[5]]
    assert sorted(got) == sorted(want)


def test_nothing_goes_through(spark, tmp_path):
    spark.createDataFrame([], P.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_a_worker_remembers_little_while_it_encodes():
    """A worker's chunks and token pairs stay below 10 MB, beside a JVM with little room."""
    import sys

    codec = piece_codec.PieceTable(public_tokenizers.path("piece_bpe_32k.model"), P.REMEMBER)
    for k in range(150_000):
        codec.encode(f"w{k} x{k * 7919 % 99991}")
    own = sum(sys.getsizeof(a) + sys.getsizeof(b) for a, b in codec.chunks.items()) + sys.getsizeof(codec.chunks)
    pairs = sys.getsizeof(codec.pairs) + 36 * len(codec.pairs)
    assert own + pairs < 12e6, (own, pairs)
