"""The registered query of each operator: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch.llm import (
    balanced_shards,
    bit_search,
    bucket_refine,
    chat_format,
    contour_whitening,
    count_tree,
    dual_tree,
    itq_links,
    language_mix,
    piece_codec,
    secret_scan,
    source_mix,
    toxic_grammar,
)
from slipwatch.llm.common import finished, id_remainder

# Columns of the tables that the queries use; a scan reads no others.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
}
MODEL_FILE = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    tricky = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], SCHEMAS["conversations"])
    chats = chat_format.format_chats(table(spark, sf_dir, "conversations").unionByName(own))
    back = chat_format.read_loss(chat_format.read_chats(chats))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op1_chats"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), coded AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS last_role,
         length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '<part/>', '\p'), '</turn>', '\t')) AS body,
         length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '<part/>', '\p'), '</turn>', '\t'), ': ', '\c')) AS head
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE WHEN last_role IS DISTINCT FROM role THEN 4 + head + 2 + 8 ELSE 7 END)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""


@query
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of equal counts, copies kept together as far as the counts allow."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )
    order = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))
    return balanced_shards.shard_documents(narrow, F.col("digest"), order).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    index = bit_search.build_index(table(spark, sf_dir, "embeddings"))
    return bit_search.nearest(index, F.col("vec_id") % 20 == 0)


@query
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#$%&*|', '')), 0)::DOUBLE AS marks
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), limits AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w,
         2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, i) AS pos
  FROM limits
), final AS (
  SELECT coalesce((SELECT level FROM levels WHERE level <= cap / w ORDER BY pos LIMIT 1), (SELECT level FROM levels ORDER BY pos DESC LIMIT 1)) AS level
), targets AS (
  SELECT source, source_size, least(cap, final.level * w) AS target FROM levels, final
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * marks / greatest(size, 1)::DOUBLE)) AS key
  FROM docs
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed
), spent AS (
  SELECT p.*, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1))::BIGINT AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM spent
"""


@query
def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return itq_links.link_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )


_REACH = """both_ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a AS id, min(least(a, b)) AS root FROM reach GROUP BY a)"""

ORACLE["op5_vector_links"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT p.vec_id AS x, q.vec_id AS y FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.93
), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(d.vec_id, coalesce(root, d.vec_id)) AS component_id,
       d.vec_id = least(d.vec_id, coalesce(root, d.vec_id)) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) d LEFT JOIN n ON n.id = d.vec_id LEFT JOIN roots ON roots.id = d.vec_id
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five folds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 5) != 0)
    model = toxic_grammar.learn_toxicity(docs, labels)
    return toxic_grammar.score_toxicity(docs, model).select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back, as counts and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.round_trip(docs, public_tokenizers.path(MODEL_FILE)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_mix.learn_languages(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    return language_mix.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    spell = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spell(base), 256).alias("base_sha256"),
        spell(F.col("secrets")).alias("spans"),
    )


@query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles overlap by 80 % or more."""
    return count_tree.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op10_jaccard"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END)) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS k FROM sh GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.k + q.k - c)
), {_REACH}
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots ON roots.id = d.doc_id
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every embedding."""
    rows = contour_whitening.whitened_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 100 that occur earlier."""

    def digests() -> DataFrame:
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
        return bucket_refine.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
            "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
        )

    return finished(spark, digests, "repeats")


ORACLE["op12_repeats"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, p, substr(x, 2 * p - 1, 200) AS s
  FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS p FROM d WHERE length(x) >= 200)
), gone AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY md5_number(s) ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), runs AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM gone
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 99 AS b, r
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM runs) GROUP BY doc_id, r
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER o, 0) AS last_b, lead(a) OVER o AS next_a FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)
), parts AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed,
         string_agg(substr(x, 2 * last_b + 1, 2 * (a - 1 - last_b)) || CASE WHEN next_a IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN parts ON parts.doc_id = d.doc_id
"""


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(spark, lambda: dual_tree.rank_documents(docs, table(spark, sf_dir, "benchmark")), "ranked")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE["op13_lexical"] = f"""
WITH docs AS (
  SELECT doc_id, {_TERMS} AS ts FROM documents
), sizes AS (
  SELECT count(*) AS n_all, sum(len(ts))::BIGINT AS l FROM docs WHERE len(ts) > 0
), asked AS (
  SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark
), tf AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM docs) GROUP BY ALL
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, sizes
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t), sizes GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
