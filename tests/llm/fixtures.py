"""A small table with every awkward case, and the given documents."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = "The quick brown fox, jumps over 12 lazy dogs.\n" * 3000
ROWS = [
    (1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (5, "a b"), (6, "a \n\t b"), (7, LONG), (8, LONG), (9, "Ünïcödé … 😀 <|endoftext|> 'S"),
    (10, "a"), (11, "\x1c x\x00y  z\n\n\n"), (None, "no id here"), (12, "1 2 3"), (13, "x" * 70_000),
]
CLASHING = [
    "host", "rule", "shard", "slot", "ids", "decoded", "fp", "h", "name", "row", "kind", "score", "label", "g", "range", "own", "t", "value", "spans", "n_chars", "lang", "source",
    "sequence_id", "offset", "piece", "start", "length", "item", "key", "component_id", "keep_id", "pos", "n", "id", "base", "added",
    "shard_key", "shard_cell", "shard_row", "pii_row_id", "pii_row_hash", "pii_added", "near_row_id", "near_row_mark", "dedup_row_id", "dedup_row_mark", "part", "able", "slice",
]


def awkward(spark, rows=None):
    """``doc_id, text`` and further columns named like those that operators make."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    df = spark.createDataFrame(ROWS if rows is None else rows, schema).repartition(3, "doc_id")
    return df.select("*", *[F.lit("?").alias(c) for c in CLASHING])


def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
