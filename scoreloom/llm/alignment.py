"""Cross-tokenizer alignment by interval coalescing.

Tokens of two tokenizers over the same bytes are intervals. All intervals of a slice are sorted by start, the running maximum of
their ends is taken, and a group breaks where a start reaches it: no token crosses that place. Inside the groups every pair of
tokens that overlap is expanded into a link. A pair of ids counts as often as its tokens are linked anywhere in the corpus.

Tokenizer A is a ``tokenizers`` JSON of byte-level BPE and reads a space and the text; B is a ``sentencepiece`` model, which adds the
space. Names of special tokens inside texts are plain text. A text whose joined token bytes differ from a space and itself has no tokens.

Scale: each text is tokenised once, in slices of bounded size. A slice names its distinct id pairs by small numbers, the most frequent first, and keeps
its links as these numbers, beside its documents; only the pairs, once per slice and with their counts, are added up over the corpus. The sums go
back to their slice by a grouped join whose groups are one slice each, so a frequent pair or a long list of documents meets in no task.

Defined cases: null and empty texts have no tokens and zeros; repeated rows are rows of their own (their links count each time); empty
tables give no rows; further columns are left out.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .batches import by_bytes, texts
from .bpe import byte_letters
from .byte_bpe import cut
from .packing import Tokens

SLICE = 1 << 20
MARK = "▁"  # fixed value: how pieces spell a space
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Side:
    """Bytes of the ids of one vocabulary."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.lengths = np.array([len(s) for s in strings], np.int64)
        #: spelling of an id followed by each separator
        self.spelled = [f"{i}{mark}" for i in range(len(strings)) for mark in (",", "|", ";", "")]


class Pair:
    """Both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.library_a = Tokens(path_a, plain=True)
        vocab = self.library_a.library.get_vocab()
        with open(path_a, encoding="utf-8") as f:
            added = {t["content"] for t in json.load(f)["added_tokens"]}
        letters = {c: b for b, c in enumerate(byte_letters())}
        strings = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            strings[i] = token.encode() if token in added else bytes(map(letters.__getitem__, token))
        self.a = Side(strings)
        self.library_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(self.library_b.id_to_piece(i), self.library_b.is_byte(i)) for i in range(self.library_b.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if byte else p.replace(MARK, " ").encode() for p, byte in pieces])

    def ids(self, batch: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text; none for a text that is empty or that either of them doesn't give back."""
        none = np.zeros(0, np.int64)
        of_a = [np.frombuffer(ids, "<u4").astype(np.int64) for ids in self.library_a.ids([" " + t if t else "" for t in batch])]
        of_b = [np.array(ids, np.int64) for ids in self.library_b.encode(batch, num_threads=1)]
        for i, text in enumerate(batch):
            whole = b" " + text.encode()
            if not text or any(b"".join(map(side.strings.__getitem__, ids.tolist())) != whole for side, ids in ((self.a, of_a[i]), (self.b, of_b[i]))):
                of_a[i] = of_b[i] = none
        return of_a, of_b

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` of one text's ids and their group numbers, which begin at 0."""
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        if not groups:
            return ""
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        words = np.empty(len(ids_a) + len(ids_b), object)
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        marks_a, marks_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        marks_a[end_a - 1] = 1
        marks_b[end_b - 1] = 2
        marks_b[-1] = 3
        spelled_a, spelled_b = self.a.spelled, self.b.spelled
        words[np.arange(len(ids_a)) + (end_b - in_b)[group_a]] = [spelled_a[k] for k in (ids_a * 4 + marks_a).tolist()]
        words[np.arange(len(ids_b)) + end_a[group_b]] = [spelled_b[k] for k in (ids_b * 4 + marks_b).tolist()]
        return "".join(words.tolist())


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def coalesced(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Group number of each interval: a new one wherever, by start, a start reaches the running maximum of the ends."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the intervals that overlap; on either side they are in order and apart."""
    low = np.searchsorted(ends_b, starts_a, side="right")
    count = np.maximum(np.searchsorted(starts_b, ends_a, side="left") - low, 0)
    first = np.cumsum(count) - count
    a = np.repeat(np.arange(len(starts_a)), count)
    return a, np.arange(len(a)) - np.repeat(first - low, count)


def _laid_out(ids: list[np.ndarray], side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a slice, where they begin and end with text after text, and the first id of each text."""
    flat = np.concatenate(ids)
    ends = np.cumsum(side.lengths[flat])
    return flat, ends - side.lengths[flat], ends, np.cumsum([0, *map(len, ids)])


class Aligned:
    """Tokens, groups and links of some texts; a link is its two ids in one number."""

    def __init__(self, both: Pair, batch: list[str]):
        self.of_a, self.of_b = both.ids(batch)
        a, starts_a, ends_a, edges_a = _laid_out(self.of_a, both.a)
        b, starts_b, ends_b, edges_b = _laid_out(self.of_b, both.b)
        group = coalesced(np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b]), np.repeat([0, 1], [len(a), len(b)]))
        group_a, group_b = group[: len(a)], group[len(a) :]
        first = np.append(group_a, group.max(initial=-1) + 1)[edges_a]
        self.n_groups = np.diff(first).tolist()
        slices = zip(first.tolist(), pairwise(edges_a.tolist()), pairwise(edges_b.tolist()), strict=False)
        self.groups = [
            both.spelled(of_a, of_b, group_a[a0:a1] - g, group_b[b0:b1] - g)
            for of_a, of_b, (g, (a0, a1), (b0, b1)) in zip(self.of_a, self.of_b, slices, strict=True)
        ]
        link_a, link_b = overlaps(starts_a, ends_a, starts_b, ends_b)
        self.links = a[link_a] << 32 | b[link_b]
        self.edges = np.searchsorted(link_a, edges_a)

    @classmethod
    def of(cls, both: Pair, batch: list[str]) -> Aligned:
        """A long text is aligned in parts that begin with a single space between other signs: either tokenizer begins a token there."""
        if len(batch) > 1 or len(batch[0]) <= SLICE:
            return cls(both, batch)
        parts = [cls(both, [part[k > 0 :]]) for k, part in enumerate(cut(batch[0], SLICE))]
        if not all(len(p.of_a[0]) for p in parts):
            return cls(both, [""])
        whole = parts[0]
        whole.of_a, whole.of_b = ([np.concatenate([getattr(p, side)[0] for p in parts])] for side in ("of_a", "of_b"))
        whole.n_groups, whole.groups = [sum(p.n_groups[0] for p in parts)], [";".join([p.groups[0] for p in parts])]
        whole.links = np.concatenate([p.links for p in parts])
        whole.edges = np.array([0, len(whole.links)])
        return whole


def _smallest(values: np.ndarray) -> bytes:
    """Little-endian unsigned numbers, of two bytes where they fit and of four else."""
    wide = len(values) and values.max() >= 1 << 16
    return (b"4" if wide else b"2") + values.astype("<u4" if wide else "<u2").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[:1] == b"4" else "<u2", offset=1)


def align(df: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """``id_col, a, b, groups, n_a, n_b, n_groups, n_links, slice, links, pairs`` of every row.

    ``a`` and ``b`` are ids as little-endian unsigned 32-bit integers, ``groups`` their alignment as ``a1,a2|b1;a3|b2,b3``. The last three are for
    ``link_counts``: the slice, the row's links as numbers of the slice's id pairs, and on one row of the slice the pairs themselves and how often each is linked there.
    """
    schema = StructType([
        df.schema[id_col], StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("groups", StringType()),
        *[StructField(c, LongType()) for c in COUNTS], StructField("slice", StringType()), StructField("links", BinaryType()), StructField("pairs", BinaryType()),
    ])

    def run(batches):
        both = pair_of(path_a, path_b)
        for batch in by_bytes(batches, 1, SLICE):
            found = Aligned.of(both, texts(batch.column(1)))
            distinct, number, often = np.unique(found.links, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            number, edges, rows = place[number], found.edges, batch.num_rows
            pairs = np.stack([distinct[order], often[order]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()) for ids in (found.of_a, found.of_b)],
                pa.array(found.groups, pa.string()), *[pa.array(map(len, ids), pa.int64()) for ids in (found.of_a, found.of_b)],
                pa.array(found.n_groups, pa.int64()), pa.array(np.diff(edges)), pa.array([uuid.uuid4().hex] * rows),
                pa.array([_smallest(number[x:y]) for x, y in pairwise(edges.tolist())], pa.binary()), pa.array([pairs] + [None] * (rows - 1), pa.binary()),
            ], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).alias("value")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``slice, number, a_id, b_id, n`` of the pairs of each slice of a stored table of ``align``."""
    schema = "slice string, number int, a_id int, b_id int, n long"

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(values), pa.string()), pa.array(np.arange(len(values), dtype=np.int32)), pa.array((values[:, 0] >> 32).astype(np.int32)),
                    pa.array((values[:, 0] & 0xFFFFFFFF).astype(np.int32)), pa.array(values[:, 1].astype(np.int64)),
                ], names=["slice", "number", "a_id", "b_id", "n"])

    return aligned.filter("pairs IS NOT NULL").select("slice", "pairs").mapInArrow(run, schema)


def link_counts(aligned: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of a stored table of ``align``, and ``n_best, count_sum`` of each row.

    ``count_sum`` adds up, over the row's links, how many links of the corpus hold the same id pair; ``n_best`` counts the links whose pair holds the
    highest such number of its B id.
    """
    pairs = cut_lineage(pair_counts(aligned))
    counts = cut_lineage(pairs.groupBy("a_id", "b_id").agg(F.sum("n").alias("count")))
    top = counts.groupBy("b_id").agg(F.max("count").alias("top"))  # at most one row for each id of B's vocabulary
    judged = counts.join(F.broadcast(top), "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("top")).alias("best"))
    told = pairs.select("slice", "number", "a_id", "b_id").join(judged, ["a_id", "b_id"]).select("slice", "number", "count", "best")
    schema = StructType([*[aligned.schema[k] for k in keep], StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        number = known.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        links = [_numbers(raw) for raw in rows.column("links").to_pylist()]
        sums = [pa.array([int(v[own].sum()) for own in links], pa.int64()) for v in (best, count)]
        return pa.Table.from_arrays([*[rows.column(k) for k in keep], *sums], names=schema.names)

    rows = aligned.select(*keep, "slice", "links")
    return rows.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(add, schema)
