"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Row p of the matrix says how many rows of input partition p go to each shard. Given the partitions' row counts it is
drawn from the multivariate hypergeometric law, by halving the range of partitions: a node of the tree splits what
its shards still take between its halves, with a generator seeded by the node, so each task walks down to its own
row in log2(partitions) draws and no matrix is gathered. A partition deals its rows out by a
random permutation of its row of the matrix, the rows are exchanged, and each shard is permuted again: a row goes to
a random cell of its shard and is ranked there by a random key, so no task holds a shard. The cells' offsets
follow from the same generators without another pass over the data.

Shard sizes differ by at most one row. Which shards have one more is drawn too.

The input has to give the same partitions with the same rows in the same order whenever it is computed, as a stored
table does; otherwise store it first. A partition whose row count is not the counted one stops the job.

Defined cases: rows with nulls, long texts and repeated rows are rows like any other; an empty table gives no rows;
columns named ``shard`` or ``slot`` in the input are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut_lineage
from .batches import unused

CELL_ROWS = 2048
NUMPY_LIMIT = 1_000_000_000  # numpy's hypergeometric sampler takes populations below it


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows without replacement are good."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, p_up, p_down = rng.random() - peak, mode, mode, peak, peak
    while u > 0 and (up < high or down > low):  # outward from the mode
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def divided(rng: np.random.Generator, takes: np.ndarray, draws: int) -> np.ndarray:
    """How much of each shard's room goes to ``draws`` of the rows."""
    out, rest = np.zeros_like(takes), int(takes.sum())
    for k, room in enumerate(takes.tolist()):
        rest -= room
        out[k] = hypergeometric(rng, room, rest, draws)
        draws -= int(out[k])
    return out


class Matrix:
    """The communication matrix of partitions with these row counts; rows are drawn when asked for."""

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.before = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        self.seed = seed
        rows = int(self.before[-1])
        self.room = np.full(shards, rows // shards, np.int64)
        self.room[np.random.default_rng([seed, 1]).permutation(shards)[: rows % shards]] += 1
        self.cells = np.maximum(1, -(-self.room // CELL_ROWS))

    def row(self, p: int) -> np.ndarray:
        low, high, takes = 0, len(self.before) - 1, self.room
        while high - low > 1:
            middle = (low + high) // 2
            left = divided(np.random.default_rng([self.seed, 2, low, high]), takes, int(self.before[middle] - self.before[low]))
            low, high, takes = (low, middle, left) if p < middle else (middle, high, takes - left)
        return takes

    def dealt(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, cell and key of each row of partition p, in the order of its rows."""
        rng = np.random.default_rng([self.seed, 3, p])
        shard = rng.permutation(np.repeat(np.arange(len(self.room), dtype=np.int32), self.row(p)))
        cell = rng.integers(0, self.cells[shard])
        return shard, cell, rng.integers(0, 1 << 63, len(shard))


def into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    found = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    matrix = spark.sparkContext.broadcast(Matrix(counts, shards, seed))
    cell_col, key_col, row_col, rank_col, offset_col = unused(df, "shard_cell", "shard_key", "shard_row", "shard_rank", "shard_offset")
    added = ["shard", cell_col, key_col, row_col]
    kinds = [IntegerType(), LongType(), LongType(), LongType()]
    schema = StructType([*df.schema.fields, *[StructField(n, k) for n, k in zip(added, kinds, strict=True)]])

    def deal(batches):
        p, at = TaskContext.get().partitionId(), 0
        shard, cell, key = matrix.value.dealt(p) if p < len(counts) else [np.zeros(0, np.int64)] * 3
        changed = f"partition {p} has not the {len(shard)} rows it was counted with; store the input first"
        for batch in batches:
            end = at + batch.num_rows
            if end > len(shard):
                raise RuntimeError(changed)
            numbers = [shard[at:end].astype(np.int32), cell[at:end], key[at:end], np.arange(at, end) + (p << 33)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, numbers)], names=[*batch.schema.names, *added])
            at = end
        if at != len(shard):
            raise RuntimeError(changed)

    def sizes(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                shard, cell, _ = matrix.value.dealt(p)
                keys, n = np.unique(shard.astype(np.int64) << 40 | cell, return_counts=True)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, [(keys >> 40).astype(np.int32), keys & (1 << 40) - 1, n])), names=["shard", cell_col, "n"])

    cells = spark.range(len(counts)).repartition("id").mapInArrow(sizes, f"shard int, {cell_col} long, n long")
    cells = cut_lineage(cells.groupBy("shard", cell_col).agg(F.sum("n").alias("n")))
    earlier = W.partitionBy("shard").orderBy(cell_col).rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("shard", cell_col, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(offset_col))
    rank = F.row_number().over(W.partitionBy("shard", cell_col).orderBy(key_col, row_col))
    ranked = df.mapInArrow(deal, schema).withColumn(rank_col, rank)
    placed = ranked.join(offsets, ["shard", cell_col])
    return placed.select(*df.columns, "shard", (F.col(offset_col) + F.col(rank_col) - 1).cast("long").alias("slot"))
