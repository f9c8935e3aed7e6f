"""Byte-level BPE encoding and decoding by a table of ranks, in two tiers.

Texts are split into pre-tokens, byte ranges of the whole slice. The first tier is a minimal perfect hash over the vocabulary: one
look-up per pre-token, done for all of a slice at once, gives the only entry that can equal it, and the bytes are compared. A pre-token that
isn't in the vocabulary goes to the second tier: its bytes form a linked list, adjacent parts whose joint bytes have a
rank wait in a heap by (rank, position), and stale entries are skipped. Decoding concatenates vocabulary bytes.

The split is that of ``public_tokenizers.PATTERN``: contractions, runs of letters, of digits and of other signs with at most one space before, and
white space whose last character stays with what follows. It is done on arrays of character classes, which are taken from the library that
the ranks are for, so that its Unicode version counts.

Scale: one pass over the rows without a shuffle. A task holds one slice of bounded size; a longer text is cut where a pre-token
begins in any case, and the memories of merged pre-tokens are bounded in bytes, so no result depends on them.

Defined cases: null counts as empty; an empty text has no ids and decodes to no bytes; names of special tokens are plain text;
ids that the vocabulary lacks decode to nothing; repeated rows are encoded one by one; further columns are left out.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .batches import by_bytes, texts

SPACE, LETTER, DIGIT, SIGN, BORDER = range(5)
LAST = 0x110000  # stands behind each text
SLICE = 1 << 20
MEMORY = 64 << 20
ENTRY = 160  # bytes of a remembered pre-token beside its own and its ids
CUT = re.compile(r"(?<=\S) (?=\S)")
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]  # fixed values


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, as the library's pattern engine sees it."""
    import tiktoken

    every = "".join(chr(c) for c in range(LAST) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    found = np.full(LAST + 1, SIGN, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        ids = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        found[np.frombuffer(bytes(ids).decode().encode("utf-32-le"), np.uint32)] = kind
    found[LAST] = BORDER
    return found


def pretokens(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte places where the pre-tokens of the joined texts begin and end, and the first pre-token of each text."""
    border = LAST.to_bytes(4, "little")
    points = np.frombuffer(border.join([t.encode("utf-32-le") for t in batch]) + border, np.uint32)
    kind = classes()[points]
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    # white space before something else: its last character begins a pre-token, and a plain space takes what follows with it
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BORDER))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # a lone apostrophe that begins a pre-token
    quote = np.flatnonzero((points == 39) & start[:n])
    quote = quote[kind[quote + 1] == LETTER]
    for letters in CONTRACTIONS:
        here = quote[quote + len(letters) < n]
        for k, letter in enumerate(letters):
            here = here[points[here + k + 1] == ord(letter)]
        start[here + 1] = False
        start[here + len(letters) + 1] = True
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    borders = np.flatnonzero(kind == BORDER)
    width[borders] = 0
    place = np.concatenate([[0], np.cumsum(width)])
    at = np.flatnonzero(start[:n] & (kind != BORDER))
    # a pre-token ends where the next one begins, whether or not a border lies between
    begins = place[at]
    ends = np.append(begins[1:], place[-1])
    return begins, ends, np.concatenate([[0], np.searchsorted(at, borders)])


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: as many slots as keys.

    Keys are hashed by a polynomial over their bytes, dealt into buckets, and a bucket's displacement (largest buckets first) sends its
    keys to free slots; a bucket of one key names its slot.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        lengths = np.array([len(k) for k in keys], np.int64)
        flat = np.frombuffer(b"".join(keys), np.uint8)
        starts = np.cumsum(lengths) - lengths
        self.longest = int(lengths.max(initial=0))
        for salt in range(64):
            self.base = (0x9E3779B97F4A7C15 + 2 * salt) % (1 << 64)
            self.powers = self._powers(max(len(flat), 1))
            hashed = self.hashed(flat, starts, starts + lengths)
            if len(np.unique(hashed)) == self.size:
                break
        else:
            raise ValueError("equal keys")
        self.buckets = max(1, self.size // 3)
        bucket = (hashed % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.size, bool)
        self.moves = np.zeros(self.buckets, np.int64)
        key_of = np.zeros(self.size, np.int64)
        sizes = np.diff(edges)
        for k in range(int(sizes.max(initial=0)), 1, -1):
            waiting = np.flatnonzero(sizes == k)
            own = order[edges[waiting][:, None] + np.arange(k)]
            move = 0
            while len(waiting):  # all waiting buckets try the same displacement; of those that clash the first stays
                slots = self._slots(hashed[own], np.full((1, 1), move, np.uint64))
                good = np.flatnonzero(free[slots].all(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1))
                _, first, which = np.unique(slots[good], return_index=True, return_inverse=True)
                owner = (first // k)[which].reshape(-1, k)
                good = good[(owner == np.arange(len(good))[:, None]).all(axis=1)]
                self.moves[waiting[good]] = move
                key_of[slots[good]] = own[good]
                free[slots[good]] = False
                waiting, own = np.delete(waiting, good), np.delete(own, good, axis=0)
                move += 1
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.moves[b] = -1 - slot
            key_of[slot] = order[edges[b]]
        self.key_of = key_of
        self.flat, self.starts, self.lengths = flat, starts, lengths

    def _powers(self, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base, np.uint64)]))

    def _slots(self, hashed: np.ndarray, move: np.ndarray) -> np.ndarray:
        mixed = (hashed ^ (hashed >> np.uint64(29))) + move * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((mixed ^ (mixed >> np.uint64(33))) % np.uint64(max(self.size, 1))).astype(np.int64)

    def hashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of byte ranges, whatever their place: a difference of two prefix sums, its power of the start taken out."""
        if len(self.powers) <= len(data):
            self.powers = self._powers(2 * len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])])
        return (sums[ends] - sums[starts]) * self._inverse()[starts]

    def _inverse(self) -> np.ndarray:
        known = getattr(self, "inverses", None)
        if known is None or known[0] != self.base or len(known[1]) < len(self.powers):
            inverse = np.full(len(self.powers), pow(self.base, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.inverses = known = (self.base, np.multiply.accumulate(inverse))
        return known[1]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of the key that equals each byte range, -1 without one."""
        lengths = ends - starts
        found = np.full(len(starts), -1, np.int64)
        if not self.size:
            return found
        hashed = self.hashed(data, starts, ends)
        move = self.moves[(hashed % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(move < 0, -1 - move, self._slots(hashed, np.maximum(move, 0).astype(np.uint64)))
        key = self.key_of[slot]
        same = np.flatnonzero((self.lengths[key] == lengths) & (lengths > 0))
        here, there, longest = starts[same], self.starts[key[same]], lengths[same]
        equal = np.ones(len(same), bool)
        for k in range(self.longest):
            more = np.flatnonzero(equal & (longest > k))
            if not len(more):
                break
            equal[more] = data[here[more] + k] == self.flat[there[more] + k]
        same = same[equal]
        found[same] = key[same]
        return found


class Ranks:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.ids = np.array([self.ranks[k] for k in keys], np.uint32)
        #: for decoding: where the bytes of an id lie
        self.place = np.zeros((int(self.ids.max()) + 1, 2), np.int64)
        self.place[self.ids] = np.stack([self.hash.starts, self.hash.lengths], axis=1)
        #: ids of single bytes, and ranks of two, -1 without one
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.double = [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.memory, self.held, self.known, self.older = memory, 0, {}, {}

    def merged(self, raw: bytes) -> list[int]:
        """Ids of a pre-token by its bytes alone. ``pair`` holds the rank of each part with the next one, so an entry that differs is stale."""
        rank_of, n = self.ranks.get, len(raw)
        ids = list(map(self.single.__getitem__, raw))
        pair = [self.double[a << 8 | b] for a, b in pairwise(raw)]
        queue = [rank << 32 | i for i, rank in enumerate(pair) if rank >= 0]
        pair.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            left, rank = entry & 0xFFFFFFFF, entry >> 32
            if pair[left] != rank:
                continue  # stale: one of the two parts was merged meanwhile
            right = after[left]
            ids[left], pair[right] = rank, -1
            after[left] = stop = after[right]
            if stop < n:
                before[stop] = left
                if (rank := rank_of(raw[left : after[stop]], -1)) >= 0:
                    push(queue, rank << 32 | left)
                pair[left] = rank
            else:
                pair[left] = -1
            if (prior := before[left]) >= 0:
                if (rank := rank_of(raw[prior:stop], -1)) >= 0:
                    push(queue, rank << 32 | prior)
                pair[prior] = rank
        found, i = [], 0
        while i < n:
            found.append(ids[i])
            i = after[i]
        return found

    def learn(self, pieces: list[bytes]) -> None:
        """Remember the ids of pre-tokens in the newer of two memories; when it is full it becomes the older one."""
        known, older = self.known, self.older
        for raw in pieces:
            if raw not in known:
                ids = older.get(raw)
                if ids is None:
                    found = self.merged(raw)
                    ids = struct.pack(f"<{len(found)}I", *found)
                known[raw] = ids
                self.held += len(raw) + len(ids) + ENTRY

    def encode_all(self, batch: list[str]) -> list[memoryview]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = "".join(batch).encode()
        starts, ends, firsts = pretokens(batch)
        key = self.hash.find(np.frombuffer(raw, np.uint8), starts, ends)
        lacking = np.flatnonzero(key < 0)
        if self.held > self.memory:
            self.known, self.older, self.held = {}, self.known, 0
        pieces = [raw[a:b] for a, b in zip(starts[lacking].tolist(), ends[lacking].tolist(), strict=True)]
        merged = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(merged) if ids is None]
        self.learn([pieces[i] for i in new])
        for i in new:
            merged[i] = self.known[pieces[i]]
        count = np.ones(len(key), np.int64)
        count[lacking] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        from_heap = np.repeat(key < 0, count)
        ids = np.empty(len(from_heap), "<u4")
        ids[~from_heap] = self.ids[key[key >= 0]]
        ids[from_heap] = np.frombuffer(b"".join(merged), "<u4")
        edges = np.concatenate([[0], np.cumsum(count)])[firsts] * 4
        view = memoryview(ids.tobytes())
        return [view[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(batch) == 1 and len(batch[0]) > SLICE:
            return [b"".join([self.encode_all([part])[0] for part in cut(batch[0])])]
        return [bytes(ids) for ids in self.encode_all(batch)]

    def decode(self, ids: bytes) -> bytes:
        values = np.frombuffer(ids, "<u4")
        places = self.place[values[values < len(self.place)]]
        ends = np.cumsum(places[:, 1])
        total = int(ends[-1]) if len(ends) else 0
        return self.hash.flat[np.repeat(places[:, 0] - ends + places[:, 1], places[:, 1]) + np.arange(total)].tobytes()


def cut(text: str, size: int = SLICE) -> list[str]:
    """Parts of about ``size`` characters; a single space between two signs that aren't white space always begins a pre-token."""
    parts, start = [], 0
    while (found := CUT.search(text, start + size)) is not None:
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``id_col, ids``: ids as little-endian unsigned 32-bit integers."""
    schema = StructType([df.schema[id_col], StructField("ids", BinaryType())])
    if id_col == "ids":
        raise ValueError("the id column can't be named ids")

    def run(batches):
        model = ranks(path)
        for batch in by_bytes(batches, 1, SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.encode(texts(batch.column(1))), pa.binary())], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).alias("value")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str, path: str, ids_col: str = "ids") -> DataFrame:
    """``id_col, ids_col, decoded`` (bytes) of binary ids; null counts as empty."""
    schema = StructType([df.schema[id_col], df.schema[ids_col], StructField("decoded", BinaryType())])
    if "decoded" in (id_col, ids_col):
        raise ValueError("a kept column can't be named decoded")

    def run(batches):
        model = ranks(path)
        for batch in by_bytes(batches, 1, SLICE):
            made = pa.array([model.decode(i or b"") for i in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema)
