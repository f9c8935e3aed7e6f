"""Exact dedup by deterministic block naming, in DataFrame functions only.

White space runs ``[\\x20\\x09-\\x0D]+`` become one space, then the text is cut into blocks of
``block_bytes`` bytes. Distinct blocks are sorted into integer names; afterwards adjacent names are paired
and distinct pairs sorted into names again, so a document of n blocks has one name after ceil(log2 n)
rounds. Texts are equal exactly when they end in the same round with the same name.

* Whole blocks are exchanged once: grouped by a 96-bit digest with a set of the real bytes per digest, which
  is combined before the exchange, so a block that a third of all rows hold travels once per task. Only if
  every digest has one block (compared byte by byte) is it used; else all is done again with a new salt. Names
  are therefore free of collisions by construction, and everything later moves integers only.
* Names are row numbers inside buckets, so no sort meets in one task.
* Tables that a skewed join reads are written first (``spark.checkpoint.dir``): both sides are then
  plain exchanges, which adaptive execution splits for a hot block or a hot group of copies.

Defined cases: null counts as empty; an empty text is one empty block, equal to other empty texts but not to
a single space; rows that repeat an id stay rows, and the first of equal ids and texts is the one kept; null
ids come last; an empty table gives an empty result; further columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .batches import unused

BLOCK_BYTES = 4096
BUCKETS = 1 << 14
#: Runs that one space has to replace; a single space is no match, so most of a text is left alone.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def block_digest(block: Column, salt: int) -> list[Column]:
    """64 + 32 bits; another salt gives another digest."""
    salted = F.concat(F.lit(f"{salt}:").cast("binary"), block) if salt else block
    return [F.xxhash64(salted).alias("h"), F.crc32(salted).alias("c")]


def _blocks(text: Column, size: int) -> Column:
    count = F.greatest(F.ceil(F.octet_length(text) / size), F.lit(1)).cast("int")
    raw = text.cast("binary")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _numbered(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys with a unique integer: the rank inside a bucket of keys, and the bucket."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(*columns)).cast("long")
    return keys.withColumn("bucket", bucket).select(*columns, (rank * BUCKETS + F.col("bucket")).alias("name"))


def block_names(texts: DataFrame, size: int, digest: Callable[[Column, int], list[Column]]) -> tuple[DataFrame, int]:
    """``h, c, name`` of all distinct blocks of column ``t``, and the salt of the digest."""
    salt = 0
    while True:
        blocks = texts.select(F.explode(_blocks(F.col("t"), size)).alias("block"))
        sets = blocks.select(*digest(F.col("block"), salt), "block").groupBy("h", "c").agg(F.collect_set("block").alias("same"))
        found = cut_lineage(sets.select("h", "c", F.size("same").alias("ways")))
        if found.filter("ways > 1").isEmpty():
            return cut_lineage(_numbered(found.select("h", "c"), ["h", "c"])), salt
        salt += 1


def exact_groups(
    df: DataFrame, id_col: str, text_col: str, carry: Mapping[str, Callable[[Column], Column]] | None = None,
    block_bytes: int = BLOCK_BYTES, digest: Callable[[Column, int], list[Column]] = block_digest,
) -> DataFrame:
    """``id_col, keep_id, group_size, kept`` and the ``carry`` expressions over the normalised text, a row for each row."""
    carry = dict(carry or {})
    texts = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    names, salt = block_names(texts.select("t"), block_bytes, digest)

    key = lambda b: F.struct(*digest(b, salt))
    documents = cut_lineage(
        texts.select(
            "id", F.monotonically_increasing_id().alias("row"), F.transform(_blocks(F.col("t"), block_bytes), key).alias("keys"),
            *[make(F.col("t")).alias(f"carry_{name}") for name, make in carry.items()],
        )
    )
    level = cut_lineage(
        documents.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
        .select("row", "n", "pos", "key.h", "key.c").join(names, ["h", "c"]).select("row", "n", "pos", "name")
    )
    most = documents.agg(F.max(F.size("keys"))).first()[0] or 1
    done = []
    for r in range(math.ceil(math.log2(most)) + 1):
        done.append(level.filter("n = 1").select("row", F.lit(r).alias("round"), "name"))
        if r == math.ceil(math.log2(most)):
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = cut_lineage(
            level.filter("n > 1").groupBy("row", F.expr("pos div 2").alias("pos"))
            .agg(F.expr("max(n + 1) div 2").cast("int").alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        )
        named = cut_lineage(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]))
        level = cut_lineage(pairs.join(named, ["a", "b"]).select("row", "n", "pos", "name"))

    identity = done[0]
    for one in done[1:]:
        identity = identity.unionByName(one)
    rows = cut_lineage(documents.drop("keys").join(identity, "row"))
    first = F.struct(F.col("id").isNull().alias("z"), "id", "row")
    groups = rows.groupBy("round", "name").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"))
    groups = cut_lineage(groups.filter("size > 1"))
    return rows.join(groups, ["round", "name"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        *[F.col(f"carry_{name}").alias(name) for name in carry],
    )


def deduplicated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they were; rows are found again by id and a digest of their text."""
    mark = F.xxhash64(normalised(F.col(text_col)))
    groups = exact_groups(df, id_col, text_col, {"mark": F.xxhash64}).withColumnRenamed(id_col, "dedup_id")
    keys = groups.groupBy("dedup_id", "mark").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = cut_lineage(keys.filter("NOT stays OR n > 1"))
    same = lambda rows, keys: rows[row_id].eqNullSafe(keys["dedup_id"]) & (rows[row_mark] == keys["mark"])
    row_id, row_mark = unused(df, "dedup_row_id", "dedup_row_mark")
    rows = df.withColumns({row_id: F.col(id_col), row_mark: mark})
    out = rows.join(gone, same(rows, gone), "left_anti").select(*df.columns)
    again = gone.filter("stays")  # rows that repeat both id and text: one of them stays
    if again.isEmpty():
        return out
    once = rows.join(again, same(rows, again), "left_semi").dropDuplicates([row_id, row_mark])
    return out.unionByName(once.select(*df.columns))
