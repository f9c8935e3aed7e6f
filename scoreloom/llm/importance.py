"""Importance resampling towards a target corpus by hashed word n-grams, the hashes taken from prefix CRCs.

A text is separator-normalised (words joined by one space) and scanned once; the running CRC-32 is stored at every place. The CRC
of any n-gram then follows from two prefixes: with ``c`` the CRC before it and ``d`` the CRC after it, it is ``d`` xor ``c`` shifted by as many
zero bytes as the n-gram has, the shift being linear over GF(2). No n-gram is spelled out or hashed on its own.

An n-gram's bucket is its CRC modulo ``buckets``. A bucket's gain is the floored log ratio of its smoothed shares in the target and in the
source, a document's weight the sum of the gains of its n-grams, and its score the weight with Gumbel noise that only its id
decides, so the highest scores are a draw without replacement in proportion to the weights.

Scale: two passes over the texts. The first leaves one histogram of at most ``buckets`` numbers a task, the second a few integers a
document, which are range-partitioned by score; places are counted per partition, so no task ranks all rows. Only ``buckets`` gains reach
the driver and the tasks. A long text is scanned in pieces that hand the last words on.

Defined cases: a null or empty text has no words, weight 0 and is never drawn; a null id draws noise like an empty one; repeated rows are
rows of their own and tie; empty tables count nothing; further columns are left out (``resample`` keeps them).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut_lineage
from .batches import by_bytes, texts

BUCKETS = 10_000
LONGEST = 3
LANE = 256
SLICE = 1 << 20
END = 0xFF  # no byte of UTF-8

LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


BYTE = _byte_table()


def _zero(state: np.ndarray) -> np.ndarray:
    """The register after one zero byte."""
    return BYTE[state & 0xFF] ^ (state >> 8)


def _applied(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 0xFF] ^ tables[1][state >> 8 & 0xFF] ^ tables[2][state >> 16 & 0xFF] ^ tables[3][state >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables, by byte of the CRC, of the shift by 0 to 255 zero bytes, and by 256, 512, ... of them."""
    short = np.zeros((LANE, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, LANE):
        short[n] = _zero(short[n - 1])
    long = [_zero(short[-1])]
    while len(long) < 32:
        long.append(_applied(long[-1], long[-1]))
    return short, long


SHORT, LONG = _shifts()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC moved by its number of zero bytes."""
    low = zeros & (LANE - 1)
    out = SHORT[low, 0, crc & 0xFF] ^ SHORT[low, 1, crc >> 8 & 0xFF] ^ SHORT[low, 2, crc >> 16 & 0xFF] ^ SHORT[low, 3, crc >> 24]
    high = zeros >> 8
    far = np.flatnonzero(high)
    for tables in LONG:
        if not len(far):
            break
        odd = far[high[far] & 1 == 1]
        out[odd] = _applied(tables, out[odd])
        high = high >> 1
        far = far[high[far] > 0]
    return out


def running(data: np.ndarray) -> np.ndarray:
    """The CRC-32 of every prefix of the bytes, the empty one first. Lanes of ``LANE`` bytes go on side by side from the CRC at their start."""
    n = len(data)
    lanes = -(-n // LANE)
    heads, crc = np.zeros(lanes, np.uint32), 0
    for k in range(lanes):
        heads[k] = crc
        crc = zlib.crc32(data[k * LANE : (k + 1) * LANE], crc)
    columns = np.zeros(lanes * LANE, np.uint8)
    columns[:n] = data
    columns = np.ascontiguousarray(columns.reshape(lanes, LANE).T)
    state, after = heads ^ np.uint32(0xFFFFFFFF), np.zeros((LANE, lanes), np.uint32)
    for k in range(LANE):
        state = BYTE[(state ^ columns[k]) & 0xFF] ^ (state >> 8)
        after[k] = state
    return np.concatenate([np.zeros(1, np.uint32), after.T.reshape(-1)[:n] ^ np.uint32(0xFFFFFFFF)])


class Scan:
    """Words of some texts (UTF-8) and the prefix CRCs around them."""

    def __init__(self, raw: list[bytes]):
        data = np.frombuffer((b"\xff".join(raw) + b"\xff").translate(LETTERS), np.uint8)
        word = np.zeros(len(data) + 1, bool)
        word[1:] = (data != 32) & (data != END)
        starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        #: first word of each text, and of the text of each word
        self.offsets = np.concatenate([[0], np.searchsorted(starts, np.flatnonzero(data == END))])
        self.first = np.repeat(self.offsets[:-1], np.diff(self.offsets))
        normal = data[word[1:] | word[:-1]]  # one separator after each word
        crc = running(np.where(normal == END, np.uint8(32), normal))
        lengths = ends - starts
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        self.before, self.after = crc[self.starts], crc[self.ends]

    def grams(self, longest: int, since: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length, (last word, CRC) of the n-grams that end at word ``since`` or later."""
        for n in range(1, longest + 1):
            last = np.arange(max(since, n - 1), len(self.starts))
            start = last - n + 1
            inside = start >= self.first[last]
            last, start = last[inside], start[inside]
            yield last, self.after[last] ^ shifted(self.before[start], self.ends[last] - self.starts[start])


def _pieces(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that begin with the last ``longest - 1`` words of what went before, and the number of these."""
    text = text.translate(LETTERS)
    kept, handed, start = longest - 1, [], 0
    while start < len(text):
        stop = text.find(b" ", start + SLICE)
        stop = len(text) if stop < 0 else stop
        piece = b" ".join([*handed, text[start:stop]])
        yield piece, len(handed)
        handed = piece.rsplit(None, kept)[-kept:] if kept else []
        start = stop


def _scans(column: pa.Array, longest: int) -> Iterator[tuple[Scan, int, int]]:
    """(scan, first row, words handed on) of bounded pieces of the rows of one slice."""
    raw = [t.encode() for t in texts(column)]
    if len(raw) == 1 and len(raw[0]) > SLICE:
        for piece, handed in _pieces(raw[0], longest):
            yield Scan([piece]), 0, handed
    else:
        yield Scan(raw), 0, 0


def bucket_counts(df: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket, n``: how many n-grams of 1 to ``longest`` words each bucket has; buckets without any are left out."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches, 0, SLICE):
            for scan, _, since in _scans(batch.column(0), longest):
                for _, crc in scan.grams(longest, since):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    made = df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket from the two tables of ``bucket_counts``; ``buckets`` numbers, whatever the corpus."""
    s, t = [0] * buckets, [0] * buckets
    for counts, found in ((s, source), (t, target)):
        for r in found.collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)]


def weights(df: DataFrame, id_col: str, text_col: str, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """``id_col, n_words, n_features, weight`` of every row."""
    schema = StructType([df.schema[id_col], *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches):
        of = np.array(gain, np.int64)
        for batch in by_bytes(batches, 1, SLICE):
            rows = batch.num_rows
            words, features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for scan, row, since in _scans(batch.column(1), longest):
                own = scan.offsets - np.minimum(scan.offsets, since)
                words[row:] += np.diff(own)
                for last, crc in scan.grams(longest, since):
                    sums = np.concatenate([[0], np.cumsum(of[crc % np.uint32(len(of))])])
                    at = np.searchsorted(last, scan.offsets)
                    features[row:] += np.diff(at)
                    weight[row:] += np.diff(sums[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).alias("value")).mapInArrow(run, schema)


def noise(id_col: str, seed: int) -> Column:
    """1000 times a Gumbel value, floored, from the first 32 bits of sha256(``seed:id``)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(
    docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, seed: int = 42, min_words: int = 20, percent: int = 5,
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row.

    ``rank`` is 1, 2, ... by score and then id for the drawn ``percent`` of the rows with ``min_words`` words or more, null for all others.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest), buckets)
    scored = weights(docs, id_col, text_col, gain, longest)
    scored = scored.withColumns({"score": F.col("weight") + noise(id_col, seed), "able": F.col("n_words") >= min_words})
    order = [F.desc("able"), F.desc("score"), F.asc(id_col)]
    # the number of a row in its range, and of its range, in one column
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if("able").alias("able_rows"))
    # one row for each range: the rows before it, and how many are drawn of all
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"),
        F.floor(F.sum("able_rows").over(everything) * percent / 100).alias("drawn"),
    )
    found = placed.join(parts, "part").withColumn("rank", F.col("place") + F.col("earlier"))
    return found.select(id_col, "n_features", "weight", "score", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows are told apart by id, so copies of a drawn id come along."""
    drawn = ranked(docs, target, id_col, text_col, target_col, **options).filter("rank IS NOT NULL").select(F.col(id_col).alias("drawn_id"))
    same = docs[id_col].eqNullSafe(drawn["drawn_id"])
    return docs.join(drawn, same, "left_semi")
