"""SimHash near-dedup by pigeonhole blocks.

A text's words (A-Z lowered, split at ``[\\x20\\x09-\\x0D]+``) give shingles of ``width`` words; a bit of the
fingerprint is set if it is set in over half of the shingles' XXH64 values. Fingerprints within ``distance``
differing bits are linked, and a document's component is the smallest id it can reach.

The 64 bits are cut into ``distance + 4`` blocks: two close fingerprints agree in at least 4 of them, so they
share a key in one of the tables, one for each choice of 4 blocks. Only distinct fingerprints are joined on
the keys, so copies never multiply. The free bits of a bucket bound its size (2**22 fingerprints of 8
bytes at distance 2); a bucket is verified as a whole and gives one row for each linked fingerprint, not its pairs:
small ones by their distance matrix, larger ones by looking up every fingerprint within the distance in the
sorted bucket, which is linear in the bucket.

Defined cases: null counts as empty; without words the fingerprint is zero, linked like any other; fewer words
than ``width`` are one shingle; repeated rows and ids stay rows; null ids are nobody's smallest; further columns of
the input are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .batches import by_bytes, unused
from .components import connected

SEED = 42
MATRIX = 1024  # fingerprints whose distance matrix is taken at once: 8 MB


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words of one text, in order; fewer words are one run, no words none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    values = shingles(text, width)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """``id, fp``; the fingerprint as a signed long with the same bits."""
    schema = StructType([StructField("id", df.schema[id_col].dataType), StructField("fp", LongType())])

    def run(batches):
        for batch in by_bytes(batches, "text"):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def block_masks(distance: int, same: int = 4) -> list[int]:
    """The bits of each choice of ``same`` of ``distance + same`` blocks."""
    count = distance + same
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, same)]


def linked(values: np.ndarray, free: int, distance: int) -> np.ndarray:
    """For each of the distinct sorted ``values`` (equal but in the bits of ``free``), the index of its component's first value."""
    n = len(values)
    if n <= MATRIX:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
        left, right = np.nonzero(np.triu(near, 1))
    else:
        bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
        flips = [np.bitwise_or.reduce(np.array(c, np.uint64)) for k in range(1, distance + 1) for c in combinations(bits, k)]
        lefts, rights = [], []
        for flip in flips:
            other = values ^ flip
            at = np.searchsorted(values, other)
            hit = np.nonzero((at < n) & (values[np.minimum(at, n - 1)] == other) & (other > values))[0]
            lefts.append(hit)
            rights.append(at[hit])
        left, right = np.concatenate(lefts), np.concatenate(rights)
    root = np.arange(n)
    while True:  # the smaller root wins, then paths are shortened
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges ``a, b`` that connect exactly the components of the distinct fingerprints ``fp``."""
    masks = block_masks(distance)
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    buckets = keyed.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("t", "fps")

    def run(batches):
        for batch in batches:
            pairs = []
            for t, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.sort(found.values.to_numpy().view(np.uint64))
                root = linked(values, ~masks[t], distance)
                moved = np.nonzero(root != np.arange(len(values)))[0]
                pairs.append(np.stack([values[moved], values[root[moved]]]))
            a, b = np.concatenate(pairs, axis=1).view(np.int64) if pairs else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, id_col: str, text_col: str, width: int = 3, distance: int = 2) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id``, a row for each row of ``df``."""
    documents = cut_lineage(fingerprints(df, id_col, text_col, width))
    classes = cut_lineage(documents.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected(links(classes.select("fp"), distance))
    rooted = cut_lineage(classes.join(roots.withColumnRenamed("node", "fp"), "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("smallest"))
    joined = rooted.select("fp", "root").join(firsts, "root").select("fp", "smallest")
    component = cut_lineage(classes.join(joined, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")))
    return documents.join(component, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_deduplicated(df: DataFrame, id_col: str, text_col: str, width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``df`` of one document of each component, the smallest id, all columns as they were.

    A document is an id with a text: rows that repeat both count as one and stay together.
    """
    mark = F.xxhash64(F.coalesce(text_col, F.lit("")))
    keyed = df.select(F.struct(F.col(id_col).alias("near_id"), mark.alias("near_mark")).alias("key"), F.col(text_col).alias("near_text"))
    groups = near_groups(keyed, "key", "near_text", width, distance)
    gone = cut_lineage(groups.filter("key <> component_id").select("key.*").distinct())
    row_id, row_mark = unused(df, "near_row_id", "near_row_mark")
    rows = df.withColumns({row_id: F.col(id_col), row_mark: mark})
    same = rows[row_id].eqNullSafe(gone["near_id"]) & (rows[row_mark] == gone["near_mark"])
    return rows.join(gone, same, "left_anti").select(*df.columns)
