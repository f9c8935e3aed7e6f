"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j); the pairs cost linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2).

Features of a text: its lower-case words hashed to ``WORDS`` buckets with the square root of their counts, scaled to
length one; each structure statistic (shares of capitals, symbols, digits and repeated words, word and line
lengths and the like) as one of ``BINS`` indicators. Only the text itself is an input.

The fit takes a bounded sample, at most ``sample_rows`` labelled rows (those with the smallest hash of their id), whose
features Spark computes; they are fitted by mini-batch AdaGrad. Scoring is one pass over all rows without a
shuffle; the model's size is fixed by the number of buckets.

Defined cases: null counts as empty; an empty text gets a score like any other; labels that are null are left out, several
labels of one id count as 1 if their mean is above a half; without labelled rows every score is 0.5; repeated rows are
scored one by one; further columns are left out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from .batches import by_bytes, texts

WORDS = 1 << 14
BINS = 16
FACTORS = 8
THRESHOLD = 0.3
MEMORY = 150_000
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")
DIGITS = re.compile(r"\d")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure statistics, each in 0 to 1."""
    n, m = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n")
    counts = len(set(words))
    return [
        min(1.0, np.log2(n) / 20),
        min(1.0, len(words) / n * 2),
        len(CAPITALS.findall(text)) / n,
        min(1.0, len(SYMBOLS.findall(text)) / n * 4),
        min(1.0, len(DIGITS.findall(text)) / n * 4),
        counts / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        len(set(lines)) / len(lines),
        min(1.0, np.log2(1 + n / len(lines)) / 16),
        sum(line.rstrip().endswith((".", "?", "!", '"')) for line in lines) / len(lines),
        min(1.0, text.count("|") / m),
        min(1.0, text.count("!") / m),
    ]


STATISTICS = len(statistics("", []))
SIZE = WORDS + STATISTICS * BINS


class Features:
    """Sparse features of texts, with a memory of bounded size for the words' buckets."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values."""
        words = text.lower().split()
        known = list(map(self.known.get, words))
        if None in known:
            known = [self.bucket(w) if b is None else b for w, b in zip(words, known, strict=True)]
        columns, counts = np.unique(np.array(known, np.int32), return_counts=True)
        values = np.sqrt(counts / max(len(words), 1))
        bins = np.minimum((np.sqrt(statistics(text, words)) * BINS).astype(np.int32), BINS - 1)
        own = WORDS + np.arange(STATISTICS, dtype=np.int32) * BINS + bins
        return np.concatenate([columns, own]), np.concatenate([values, np.full(STATISTICS, 0.5)]).astype(np.float32)


class Machine:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(SIZE)
        self.factors = rng.normal(0, 0.01, (SIZE, FACTORS))

    def raw(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw score of each row and its factor sums; rows begin at ``starts`` and none is empty."""
        weighted = self.factors[columns] * values[:, None]
        sums = np.add.reduceat(weighted, starts)
        squares = np.add.reduceat((weighted * weighted).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[columns] * values, starts) + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(c) for c, _ in rows])
        raw, _ = self.raw(np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> Machine:
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                sizes = np.array([len(rows[i][0]) for i in chosen])
                columns, values = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
                raw, sums = self.raw(columns, values, np.cumsum(sizes) - sizes)
                error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - labels[chosen]) / len(chosen)
                each = np.repeat(error, sizes) * values
                used, place = np.unique(columns, return_inverse=True)
                slope_w = np.bincount(place, each) + decay * self.linear[used]
                inner = each[:, None] * (np.repeat(sums, sizes, axis=0) - self.factors[columns] * values[:, None])
                slope_v = np.stack([np.bincount(place, inner[:, f]) for f in range(FACTORS)], axis=1) + decay * self.factors[used]
                seen_w[used] += slope_w**2
                seen_v[used] += slope_v**2
                seen_b += error.sum() ** 2
                self.linear[used] -= rate * slope_w / np.sqrt(seen_w[used])
                self.factors[used] -= rate / 2 * slope_v / np.sqrt(seen_v[used])
                self.bias -= rate * error.sum() / np.sqrt(seen_b)
        return self


def fit(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, learn: Column, sample_rows: int = 8000) -> Machine:
    """Learn from labelled rows of ``labels`` where ``learn`` holds (an expression over ``labels``' id)."""
    known = labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    sample = known.agg((F.avg(label_col) > 0.5).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most sample_rows rows
    rows = rows.groupBy("id").agg(F.min(F.struct("label", F.coalesce("text", F.lit("")).alias("text"))).alias("r")).select("r.*")
    schema = StructType([StructField("label", DoubleType()), StructField("columns", BinaryType()), StructField("values", BinaryType())])

    def run(batches):
        features = Features()
        for batch in by_bytes(batches, "text"):
            found = [features.of(t) for t in texts(batch.column(1))]
            arrays = [pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["label", "columns", "values"])

    # sorted, so that the fit doesn't depend on the tasks' order; a row is a few kB and there are at most sample_rows
    found = sorted((r["label"], bytes(r["columns"]), bytes(r["values"])) for r in rows.mapInArrow(run, schema).collect())
    machine = Machine()
    if found:
        pairs = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for _, c, v in found]
        machine.fit(pairs, np.array([label for label, _, _ in found]))
    return machine


def score(df: DataFrame, id_col: str, text_col: str, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, score, predicted``, a row for each row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    schema = StructType([df.schema[id_col], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        features = Features()
        for batch in by_bytes(batches, "text", 1 << 20):
            found = shared.value.score([features.of(t) for t in texts(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def accepted(df: DataFrame, text_col: str, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score of at least ``threshold``, all columns as they were."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    at = df.columns.index(text_col)

    def run(batches):
        features = Features()
        for batch in by_bytes(batches, at, 1 << 20):
            found = shared.value.score([features.of(t) for t in texts(batch.column(at))])
            yield batch.filter(pa.array(found >= threshold))

    return df.mapInArrow(run, df.schema)
