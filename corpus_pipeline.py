"""A training-data pipeline over documents: five stages, each written as Parquet and read again.

quality classifier: documents scored under 0.7 go. SimHash near-dedup: one document of each group
stays. Benchmark decontamination: documents that contain a test item go. PII: personal data is
replaced by its kind. BPE encoding and decoding: each text's token ids and their digest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.llm import bpe, decontaminate, pii, quality, queries, similar
from visitgrain.llm.common import pick, read_table, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Fingerprints that differ in so many bits of 64 are candidates, beside those of the bands; sets of
#: five-word shingles must then have a Jaccard similarity of 0.8 or more.
RADIUS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~queries.held_out())
    scored = quality.score_documents(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") >= queries.GOOD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs, spark, COLUMNS, least=0.8, width=5, radius=RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), spark, COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact_documents(docs, COLUMNS)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Compression, hashing and tokenizing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read_table(spark, sf_dir, "documents"), *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), spark, f"stage-{k}")
    return docs
