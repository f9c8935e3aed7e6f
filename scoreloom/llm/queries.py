"""Registered queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from . import alignment, bpe, byte_bpe, exact_dedup, fingerprint, importance, language, packing, pii, quality, shards, simhash, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


@query(
    "op1_url_filter",
    """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN suffix('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN suffix('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN suffix('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN suffix('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
)
def _url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), "page_id", "url", RULES)


@query(
    "op9_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
""",
)
def _exact_dedup(spark, sf_dir):
    carry = {"text_sha256": lambda t: F.sha2(t, 256)}
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text", carry)


@query("op5_simhash_dedup")
def _simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, distance=2)


@query("op6_best_fit_packing")
def _packing(spark, sf_dir):
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "length", 2048)


@query("op7_bpe")
def _bpe(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return bpe.decode(ids, "doc_id", path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_sharding")
def _sharding(spark, sf_dir):
    placed = shards.into_shards(table(spark, sf_dir, "documents"), 24, seed=7)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_document_fingerprint")
def _fingerprint(spark, sf_dir):
    found = fingerprint.compare_with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def held_out(doc_id: str = "doc_id"):
    """The fifth of the documents that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


@query("op4_language_id")
def _language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents, "doc_id", "text", "lang", ~held_out())
    return language.identify(documents, "doc_id", "text", model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_quality_classifier")
def _quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    machine = quality.fit(documents, "doc_id", "text", table(spark, sf_dir, "labels"), "quality", ~held_out())
    return quality.score(documents, "doc_id", "text", machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_pii")
def _pii(spark, sf_dir):
    found = pii.extract(table(spark, sf_dir, "documents"), "doc_id", "text")
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select(
        "doc_id", *[kind(k) for k in range(4)], F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"), pii.named(F.col("spans")).alias("spans")
    )


@query("op11_importance_resampling")
def _importance(spark, sf_dir):
    return importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")


@query("op12_byte_bpe")
def _byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return byte_bpe.decode(ids, "doc_id", path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_tokenizer_alignment")
def _alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    stored = cut_lineage(found.select("doc_id", *alignment.COUNTS, digest, "slice", "links", "pairs"))
    return alignment.link_counts(stored, ["doc_id", *alignment.COUNTS, "groups_sha256"])
