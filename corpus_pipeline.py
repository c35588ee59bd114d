"""From raw documents to token ids: language, near duplicates, secrets, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`. Models are learned from the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwatch.llm import count_tree, language_mix, piece_codec, secret_scan, source_mix
from slipwatch.llm.common import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REMEMBER = 20_000
# Texts, their ids and copies of both stand in a Python worker at once: small batches keep it small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def small_batches(spark: SparkSession) -> dict[str, str]:
    """Sets BATCHES and returns what was set before; stages are evaluated after they return, so they leave it set."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return before


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null, or no letter); a missing label is filled with the prediction."""
    small_batches(spark)
    model = language_mix.learn_languages(docs)
    found = language_mix.identify(docs.select(*COLUMNS), model)
    kept = found.filter(F.col("lang_pred") != language_mix.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component; of repeated rows one stays.

    Rows without an id link like all others and come last: they go only if a document with
    an id, or an earlier row without one, is in their component.
    """
    small_batches(spark)
    firsts = count_tree.first_documents(docs)
    keyed = docs.select(*COLUMNS, count_tree.row_key().alias("_key"))
    own = lambda once: keyed.join(firsts.filter(F.col("once") == once).select(F.col("key").alias("_key")), "_key", "left_semi")
    again = own(True).groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return own(False).select(*COLUMNS).unionByName(again)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; no document goes."""
    small_batches(spark)
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix of sources takes."""
    return source_mix.emit_mix(source_mix.mix_sources(docs.select(*COLUMNS)), columns=COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their count and digests of ids and decoded text."""
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.round_trip(docs.select(*COLUMNS), model, keep_ids=True, remember=REMEMBER, keep_table=False).select(
        "doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "piece_ids"
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("pieces", pieces),
]

# Language inference and encoding have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet and read by the next."""
    docs = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/documents.parquet")
    before = small_batches(spark)
    try:
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs
