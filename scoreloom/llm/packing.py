"""Best-fit packing of token pieces by hierarchical residual packing.

Documents are tokenised with a given vocabulary and followed by an end id; only those longer than a sequence
are cut, the first piece taking the rest. Pieces are then items: groups of about ``group_items`` items are packed by best
fit, largest first. Of the bins a group leaves no two fit into one, so at most one of them is half empty or more: these go on as items
of the next round, ``group_items`` times fewer each, until they are one group; there they meet as many of the emptiest other
bins, and after it no two bins of the whole fit into one. A bin is named by its first item, so no numbers are handed out by one task.

Scale: texts are read once and not exchanged; what is exchanged are items of a few integers, in groups of
bounded size. The places of the rounds are put together by joins on bins.

Defined cases: null counts as empty, so it is the end id alone; repeated rows are items of their own; an empty table
gives no sequences; further columns of the input are left out.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache, reduce
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..session import cut_lineage
from .batches import by_bytes, texts, unused

SIZE = 2048
GROUP_ITEMS = 65_536
JOINED = 256
SPACE = "\u0120"  # fixed value: how byte-level vocabularies spell a space
WORD = re.compile(r" [^\W_]+")
BESIDE = re.compile(r"\s\s")
ENDINGS = frozenset(".,;:!?|&$%#*")
TAIL = re.compile(r"( ?[^\W_]+)([.,;:!?|&$%#*]+)")
WORD_START = re.compile(r"(?<=\S)(?= \S)")
MARKS = ".,;:!?"
LOOSE = re.compile(r"[^0-9A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]")  # a mark behind something else than a letter or digit


class Tokens:
    """Ids of whole texts. Byte-level splitting starts a new token before a single space, around a single
    line end and between a letter or digit and a mark, whatever stands beside them, so texts are cut there and the ids of the parts remembered, in two
    memories of bounded size: when the newer is full it becomes the older one, and what is used again moves over."""

    def __init__(self, path: str, memory: int = 350_000, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain  # names of special tokens in a text are then its plain text
        vocab = self.library.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith(SPACE)]] = True
        self.memory, self.known, self.older = memory, {}, {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def parts(self, text: str) -> list[str]:
        if "\0" in text or BESIDE.search(text):
            return WORD_START.split(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not LOOSE.search(text):
            for mark in MARKS:
                cut = cut.replace(mark, "\0" + mark)
        return cut.split("\0")

    def learn(self, parts: list[str]) -> None:
        """Remember the ids of parts that the newer memory lacks."""
        known, older = self.known, self.older
        joined, new = [], {}
        for part in parts:
            if (ids := older.get(part)) is not None:
                known[part] = ids
            elif part[-1:] in ENDINGS and (halves := TAIL.fullmatch(part)):  # between a letter or number and a mark a new token starts, too
                joined.append((part, *halves.groups()))
                new |= {half: None for half in halves.groups() if half not in known}
            else:
                new[part] = None
        words = [part for part in new if WORD.fullmatch(part)]
        for at in range(0, len(words), JOINED):  # one text of many words; only a word's first token begins with a space
            some = words[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = pairwise([*np.nonzero(self.spaced[ids])[0].tolist(), len(ids)])
            raw = ids.tobytes()
            known |= {word: raw[4 * a : 4 * b] for word, (a, b) in zip(some, ends, strict=True)}
        others = [part for part in new if part not in known]
        for part, found in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            ids = found.ids
            known[part] = struct.pack(f"<{len(ids)}I", *ids)
        for part, word, tail in joined:
            known[part] = known[word] + known[tail]

    def ids(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        cut = list(map(self.parts, batch))
        every = list(chain.from_iterable(cut))
        found = list(map(self.known.get, every))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        self.learn(list(dict.fromkeys([every[i] for i in lacking])))
        for i in lacking:
            found[i] = self.known[every[i]]
        ends = accumulate(map(len, cut), initial=0)
        return [b"".join(found[a:b]) for a, b in pairwise(ends)]


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, size: int = SIZE, end_id: int = 0, forget: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids``: each document's ids and the end id in pieces of at most ``size``.

    A worker keeps its memory of parts for its next task, unless it is told to ``forget``, where it also serves other operators.
    """
    schema = StructType([
        StructField(id_col, df.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids", BinaryType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        library = tokens(path)
        for batch in by_bytes(batches, "text", 1 << 20):
            row, piece, start, ids = [], [], [], []
            for i, found in enumerate(library.ids(texts(batch.column(1)))):
                found += end
                n = len(found) // 4
                first = (n - 1) % size + 1
                for k, s in enumerate([0, *range(first, n, size)]):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    ids.append(found[4 * s : 4 * (s + size if k else first)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary()),
            ], names=[id_col, "piece", "start", "length", "ids"])
        if forget:
            library.forget()

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For items from large to small: the index of the first item of its bin, and the place there."""
    opened: list[list[int]] = [[] for _ in range(size + 1)]
    free = 0  # bit r: there is a bin with r free places
    first, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = free >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            stack = opened[room]
            owner = stack.pop()
            if not stack:
                free ^= 1 << room
        else:
            room, owner = size, i
        first[i], place[i] = owner, size - room
        if left := room - n:
            opened[left].append(owner)
            free |= 1 << left
    return first, place


def pack(items: DataFrame, length_col: str = "length", size: int = SIZE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; lengths have to lie in 1 to ``size``. No two sequences of the result fit into one."""
    (item_col,) = unused(items, "item")
    kept = cut_lineage(items.withColumn(item_col, F.monotonically_increasing_id()))
    bins = kept.select(F.col(item_col).alias("item"), F.col(length_col).cast("long").alias("fill"))

    def one_round(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "item"], ascending=[False, True], ignore_index=True)
        fills, names = group["fill"].to_numpy(), group["item"].to_numpy()
        if fills[-1] < 1 or fills[0] > size:
            raise ValueError(f"lengths have to lie in 1 to {size}")
        first, place = best_fit(fills, size)
        total = np.bincount(first, weights=fills, minlength=len(fills)).astype(np.int64)
        return pd.DataFrame({"item": names, "bin": names[first], "place": place, "fill": total[first]})

    def packed(placed: DataFrame | None, bins: DataFrame, groups: int, number: int) -> tuple[DataFrame, DataFrame]:
        """All items with their bins after one more round over ``bins``, and the bins that this round left."""
        chosen = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)).alias("g")
        step = bins.select("item", "fill", chosen).groupBy("g").applyInPandas(one_round, "item long, bin long, place long, fill long")
        step = cut_lineage(step)
        left = step.filter("item = bin").select("item", "fill")
        if placed is None:
            return step.select("item", "bin", "place"), left
        moved = step.filter("item <> bin").select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("more"))
        placed = placed.join(moved, "bin", "left").select(
            "item", F.coalesce("to", "bin").alias("bin"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")
        )
        return placed, left

    count = bins.count()
    number, hosts = 1, []
    placed, left = packed(None, bins, max(1, -(-count // group_items)), number)
    while count > group_items:  # a group leaves at most one bin that is half empty or more; only those can still go into others
        hosts.append(left.filter(F.col("fill") * 2 > size))
        small = left.filter(F.col("fill") * 2 <= size)
        count, least = small.agg(F.count(F.lit(1)), F.min("fill")).first()
        if not count:
            break
        number += 1
        if count > group_items:
            placed, left = packed(placed, small, -(-count // group_items), number)
        else:  # the root: with as many hosts as there are such bins, the emptiest, whatever fits anywhere fits here
            roomy = cut_lineage(_emptiest(reduce(DataFrame.unionByName, hosts).filter(F.col("fill") <= size - least), count))
            placed, left = packed(placed, small.unionByName(roomy), 1, number)
    placed = placed.select(F.col("item").alias(item_col), F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return kept.drop("sequence_id", "offset").join(placed, item_col).drop(item_col)


def _emptiest(bins: DataFrame, count: int) -> DataFrame:
    """``count`` bins of the smallest fills; there are no more different fills than places."""
    taken, fills = 0, []
    for r in bins.groupBy("fill").agg(F.count(F.lit(1)).alias("n")).orderBy("fill").collect():
        if taken + r["n"] >= count:
            return bins.filter(F.col("fill").isin(fills)).unionByName(bins.filter(F.col("fill") == r["fill"]).limit(count - taken))
        taken += r["n"]
        fills.append(r["fill"])
    return bins
