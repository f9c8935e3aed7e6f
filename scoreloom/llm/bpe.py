"""BPE encoding and decoding with a given vocabulary file.

A word's symbols form a doubly linked list. Every adjacent pair that the merge table knows waits in a
priority queue by (merge rank, position); the best pair is merged into its left symbol, its new neighbours are
queued, and entries whose pair is no longer what was queued are skipped. Decoding concatenates
vocabulary strings, with the separator that the file's decoder asks for.

The file is a ``tokenizers`` JSON of a word-level BPE: normal form C, white space to one space, lower case,
a split into words, digits and symbol runs, bytes spelled as printable characters, and a word-end suffix. Nothing is
trained. Special tokens in a text are recognised first, as the file says.

Python's tables are of another Unicode version than the library's. The code points for which normal form, order of marks,
case or class differ are found once on the driver (``unlike``); the stretches between spaces that hold one of them are
normalised and split by the library itself, then merged as all others are.

Scale: one pass over the rows without a shuffle; a task holds one slice of bounded bytes and a word memory of
bounded size, emptied when full, so the result never depends on it.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; repeated rows are
encoded one by one; further columns of the input are left out.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .batches import by_bytes, texts

SPACE = regex.compile(r"\p{White_Space}+")
HIGH = re.compile("[\U00010000-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable spelling of each byte: itself where printable, else the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def normal(text: str) -> str:
    return SPACE.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def unlike(path: str) -> str:
    """The code points that the library treats otherwise than Python does, in ascending order."""
    mark = "\x01"  # composes with nothing
    # the other planes are private or hold nothing yet: neither cases, marks nor classes
    points = [chr(c) for c in (*range(2, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000))]
    everything = "".join(points)
    library = tokenizers.Tokenizer.from_file(path).normalizer.normalize_str

    def both(texts: list[str]):
        joined = mark.join(texts)
        return zip(points, library(joined).split(mark), normal(joined).split(mark), strict=True)

    found = {c for c, theirs, own in both(points) if theirs != own}
    for around in ("x\u0345{}", "x{}\u0334"):  # marks of the last and the first class: the order tells the class of the one between
        found |= {c for c, theirs, own in both([around.format(c) for c in points]) if theirs != own}
    parts = {c: unicodedata.normalize("NFD", c) for c in points}
    for c, theirs, own in both(list(parts.values())):
        if theirs != own:
            found |= {c, *parts[c][1:]}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        others = tokenizers.normalizers.Replace(tokenizers.Regex(kind), "").normalize_str(everything)
        found |= set(others) ^ set(regex.sub(kind, "", everything))
    # and what turns into one of them
    found |= {c for c, theirs, own in both(points) if not (found.isdisjoint(theirs) and found.isdisjoint(own))}
    return "".join(sorted(found))


class Bpe:
    """Encoder and decoder over one vocabulary file. ``odd``: the code points of ``unlike``, found here if not given."""

    def __init__(self, path: str, memory: int = 600_000, odd: str | None = None):
        self.odd = frozenset(unlike(path) if odd is None else odd)
        self.low = re.compile("[\\0" + re.escape("".join(c for c in self.odd if c < "\U00010000")) + "]")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.joint = " " if spec["decoder"] is None else ""
        #: rank of a pair of ids, packed into one integer; the joined id of a rank
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.joined = [self.vocab[a + b] for a, b in model["merges"]]
        words = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.words = regex.compile(words)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The ids left when no merge applies any more. A queue entry is (rank, position) in one integer; a rank names one pair."""
        rank_of, joined, n = self.ranks.get, self.joined, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            left, rank = entry & 0xFFFFFFFF, entry >> 32
            right = after[left]
            if right < 0 or symbols[left] < 0 or rank_of(symbols[left] << 32 | symbols[right]) != rank:
                continue  # stale: one of the two was merged meanwhile
            symbols[left] = new = joined[rank]
            symbols[right] = -1
            after[left] = right = after[right]
            if right >= 0:
                before[right] = left
                if (rank := rank_of(new << 32 | symbols[right])) is not None:
                    push(queue, rank << 32 | left)
            if (left := before[left]) >= 0 and (rank := rank_of(symbols[left] << 32 | new)) is not None:
                push(queue, rank << 32 | left)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = list(map(self.inner.__getitem__, raw))
        symbols[-1] = self.last[raw[-1]]
        return self.merged(symbols) if len(symbols) > 1 else symbols

    def chunk(self, chunk: str) -> bytes:
        """Ids, little-endian unsigned 32-bit, of a text without white space."""
        words = self.words.findall(chunk)
        if len(words) == 1:
            return np.array(self.word(words[0]), "<u4").tobytes()
        return b"".join(self.remembered(word, self.chunk) for word in words)

    def remembered(self, text: str, make) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            ids = make(text)
            if len(text) <= 32:
                if len(self.known) >= self.memory:
                    self.known.clear()
                self.known[text] = ids
        return ids

    @cached_property
    def library(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.path)

    def odd_chunk(self, text: str) -> bytes:
        """Ids of a text whose normal form and words the library gives, spelled in the letters of bytes."""
        out = []
        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            out += self.merged([*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.suffix]])
        return np.array(out, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        if self.is_odd(text):
            return b"".join(self.odd_chunk(chunk) if self.is_odd(chunk) else self.plain(chunk) for chunk in text.split(" "))
        return self.plain(text)

    def is_odd(self, text: str) -> bool:
        if text.isascii():
            return False
        return bool(self.low.search(text)) or (bool(HIGH.search(text)) and not self.odd.isdisjoint(text))

    def plain(self, text: str) -> bytes:
        chunks = normal(text).split(" ")
        known = list(map(self.known.get, chunks))
        if None in known:
            known = [self.remembered(chunk, self.chunk) if ids is None else ids for chunk, ids in zip(chunks, known, strict=True)]
        return b"".join(known)

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.piece(text)
        return b"".join(np.array([self.specials[p]], "<u4").tobytes() if p in self.specials else self.piece(p) for p in self.special.split(text))

    def decode(self, ids: bytes) -> str:
        """Ids that the vocabulary lacks are left out."""
        strings = self.strings
        return self.joint.join([strings[i] for i in np.frombuffer(ids, "<u4").tolist() if i in strings])


@lru_cache(maxsize=2)
def bpe(path: str, odd: str) -> Bpe:
    return Bpe(path, odd=odd)


def _mapped(df: DataFrame, kept: list[str], column: str, name: str, kind, limit: int, make) -> DataFrame:
    """The ``kept`` columns and a new one made of ``column``."""
    if name in kept:
        raise ValueError(f"a kept column can't be named {name}")
    schema = StructType([*[df.schema[k] for k in kept], StructField(name, kind)])
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def run(batches: Iterable[pa.RecordBatch]):
        one = make()
        for batch in by_bytes(batches, len(kept), limit):
            made = pa.array(one(batch.column(len(kept))), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], names=[*kept, name])

    return df.select(*[df[k] for k in kept], df[column].alias("value")).mapInArrow(run, schema)


def encode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``id_col, ids``: ids as little-endian unsigned 32-bit integers."""

    odd = unlike(path)

    def make():
        model = bpe(path, odd)
        return lambda column: [model.encode(t) for t in texts(column)]

    return _mapped(df, [id_col], text_col, "ids", BinaryType(), 4 << 20, make)


def decode(df: DataFrame, id_col: str, path: str, ids_col: str = "ids") -> DataFrame:
    """``id_col, ids_col, decoded`` of binary ids; null counts as empty."""

    odd = unlike(path)

    def make():
        model = bpe(path, odd)
        return lambda column: [model.decode(i or b"") for i in column.to_pylist()]

    return _mapped(df, [id_col, ids_col], ids_col, "decoded", StringType(), 4 << 20, make)
