"""The corpus pipeline: documents through five operators, each stage written as Parquet and read by the next.

Stages up to the last keep the columns of ``documents``. The SQL of the whole is None: a factorisation machine,
XXH64 fingerprints and a tokenizer have no SQL form; ``tests/llm`` runs it against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scoreloom.llm import exact_dedup, packing, pii, quality, simhash
from scoreloom.llm.queries import held_out
from scoreloom.session import checkpoint_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject (score 0.3 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.fit(docs, "doc_id", "text", labels, "quality", ~held_out())
    return quality.accepted(docs, "text", machine)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id."""
    return exact_dedup.deduplicated(docs, "doc_id", "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at 2 bits or fewer of the SimHash of their 3-word shingles, the smallest id."""
    return simhash.near_deduplicated(docs, "doc_id", "text", width=3, distance=2)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text."""
    redacted = pii.redact(docs, "doc_id", "text")
    return redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, forget=True)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "length", 2048)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/scoreloom-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
