"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it into phrases, each the
longest match at its place; the language that needs the fewest phrases for each symbol wins. Symbols are lower-case
letters; any run of other characters is one separator.

A state is known by its place in one array that holds the moves of all automata: its move by a symbol lies at place +
symbol and names its owner, so one look tells whether there is such a move. A symbol without a move ends the phrase and
starts the next one. The array's size follows the moves, at most three for each symbol learned, not the alphabets.

Texts are parsed whole. A batch is walked for all languages at once, one numpy step for each place of its segments of
``SEGMENT`` symbols; a segment first starts anew and is then corrected from the state in which its predecessor really
ended, up to the place where both walks are in the same state. Phrases therefore cross segments as if there were none.

The fit reads a bounded sample, given by ``sample_rows`` labelled rows for each language (those with the smallest hash
of their id) and ``sample_chars`` symbols for each language, shared equally among the distinct texts and taken over their whole length; the
array's size follows from it and is what is broadcast. Every letter of a sample is a symbol of its own. Scoring
is one pass without a shuffle.

Defined cases: null text or a text without letters: ``und``, score 0; ties go to the language that sorts first; no
labelled rows: ``und`` everywhere; rows without a label are not learned from; repeated rows are scored one by one; further
columns are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .batches import by_bytes, texts

SEGMENT = 256  # symbols that are walked in one go; the result does not depend on it
PLACE = (1 << 32) - 1
PIECES = 32  # pieces that are read of a text of more than four samples
CHUNK = 512  # symbols of a piece of a text that is too long for its part of the sample


def letter_codes() -> np.ndarray:
    """Code point -> the code point of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            out[point] = ord(c.lower()[0])
    return out


def letters(text: str, codes: np.ndarray) -> np.ndarray:
    """Lower-case letters, each run of other characters as one 0."""
    found = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return found[keep]


def automaton(symbols: Iterable[int]) -> list[dict[int, int]]:
    """Suffix automaton of a symbol sequence: the moves of each state; state 0 is the start."""
    length, link, moves = [0], [-1], [{}]
    last = 0
    for symbol in symbols:
        state = len(moves)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(moves)
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return moves


def places(rows: list[list[int]]) -> list[int]:
    """A place above 0 for each row of symbols: no two rows share a place, and no two moves the slot place + symbol.

    Rows with most symbols come first, each at the first free slot that fits; ``after`` leads to the next free slot.
    """
    out = [0] * len(rows)
    after: list[int] = [0]
    named = bytearray(1)

    def free(slot: int) -> int:
        while len(after) <= slot:
            after.append(len(after))
        end = slot
        while after[end] != end:
            end = after[end]
            if end == len(after):
                after.append(end)
        while after[slot] != end:
            after[slot], slot = end, after[slot]
        return end

    tried: dict[tuple[int, int], int] = {}
    for row in sorted(range(len(rows)), key=lambda r: (-len(rows[r]), r)):
        symbols = sorted(rows[row]) or [0]
        first = symbols[0]
        kind = (len(symbols), first)  # slots below have been tried for rows of this size and first symbol
        slot = free(max(tried.get(kind, 0), first + 1))
        while True:
            place = slot - first
            if len(named) <= place:
                named.extend(bytes(place + 1))
            if not named[place] and all(free(place + s) == place + s for s in symbols[1:]):
                break
            slot = free(slot + 1)
        tried[kind] = slot + 1
        out[row] = place
        named[place] = 1
        for s in symbols[: len(rows[row])]:
            after[place + s] = place + s + 1
            if place + s + 1 == len(after):
                after.append(place + s + 1)
    return out


def parts(sizes: list[int], total: int) -> list[int]:
    """Equal parts of ``total``, none above its size; what one leaves goes to the others."""
    out = [0] * len(sizes)
    for place, k in enumerate(sorted(range(len(sizes)), key=lambda k: (sizes[k], k))):
        out[k] = min(sizes[k], total // (len(sizes) - place))
        total -= out[k]
    return out


def spread(stream: np.ndarray, size: int) -> list[np.ndarray]:
    """Pieces of ``stream`` of ``size`` symbols in all, at equal distances from its start to its end."""
    if len(stream) <= size:
        return [stream]
    count = max(1, -(-size // CHUNK))
    lengths = [size * (k + 1) // count - size * k // count for k in range(count)]
    starts = [(len(stream) - lengths[k]) * k // max(1, count - 1) for k in range(count)]
    return [stream[s : s + n] for s, n in zip(starts, lengths, strict=True)]


class Model:
    def __init__(self, samples: dict[str, list[str]], sample_chars: int):
        self.codes = letter_codes()
        self.languages = sorted(samples)
        streams = []
        for name in self.languages:
            found = [letters(text, self.codes) for text in dict.fromkeys(samples[name])]
            found = [f for f in found if f.any()]
            pieces = []
            for stream, size in zip(found, parts([len(f) + 1 for f in found], sample_chars), strict=True):
                for piece in spread(stream, max(0, size - 1)):
                    pieces += [piece, np.zeros(1, np.uint32)]
            stream = np.concatenate([*pieces, np.zeros(0, np.uint32)])
            streams.append(stream)
        # a letter's number by code point of its lower case: 0 no letter, 1 in no sample, then the known ones
        known = np.unique(np.concatenate([*streams, np.zeros(0, np.uint32)]))
        known = known[known > 0]
        self.numbers = np.minimum(self.codes, 1).astype(np.uint16 if len(known) + 2 < 1 << 16 else np.uint32)
        self.numbers[known] = np.arange(2, len(known) + 2)
        automata = [automaton(self.numbers[stream].tolist()) for stream in streams]
        place = iter(places([list(row) for moves in automata for row in moves[1:]]))
        #: place of the state that a symbol leads to from the start; 0 is the place without moves, after a symbol that the sample lacks
        self.roots = np.zeros((len(automata), len(known) + 2), np.int64)
        at, to = [], []
        last = 0
        for language, moves in enumerate(automata):
            name = [0, *[next(place) for _ in moves[1:]]]
            last = max(last, *name)
            for symbol, state in moves[0].items():
                self.roots[language, symbol] = name[state]
            for owner, row in zip(name[1:], moves[1:], strict=True):
                for symbol, state in row.items():
                    at.append(owner + symbol)
                    to.append(owner << 32 | name[state])
        self.moves = np.full(last + len(known) + 2, -1, np.int64)  # owner << 32 | place moved to
        self.moves[at] = to

    def step(self, state: np.ndarray, symbol: np.ndarray, language) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts."""
        found = self.moves[state + symbol]
        new = (found >> 32) != state
        return np.where(new, self.roots[language, symbol], found & PLACE), new

    def walked(self, grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and phrases (language, segment) of segments that each start anew."""
        order = np.argsort(-size, kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        state = np.zeros((len(self.languages), len(order)), np.int64)
        count = np.zeros_like(state)
        active = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")  # segments longer than the step
        for at in range(SEGMENT):
            n = active[at]
            if not n:
                break
            state[:, :n], new = self.step(state[:, :n], steps[at, :n], slice(None))
            count[:, :n] += new
        back = np.argsort(order, kind="stable")
        return state[:, back], count[:, back]

    def joined(self, grid: np.ndarray, size: np.ndarray, follows: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
        """Correct ``end`` and ``count`` of the segments that follow one of the same text."""
        start = np.zeros_like(end)  # the state that a segment's figures rest on
        at = np.flatnonzero(follows)
        language, segment = (x.ravel() for x in np.meshgrid(np.arange(len(end)), at, indexing="ij"))
        true = end[language, segment - 1]
        start[language, segment] = true
        ends = end.copy()
        held = np.zeros(len(true), np.int64)
        here = np.flatnonzero(true)
        a, b = held[here], true[here]
        for step in range(SEGMENT):
            if not len(here):
                break
            symbol = grid[segment[here], step]
            a, first = self.step(a, symbol, language[here])
            b, second = self.step(b, symbol, language[here])
            count[language[here], segment[here]] += second.astype(np.int64) - first
            over = size[segment[here]] == step + 1
            ends[language[here[over]], segment[here[over]]] = b[over]
            left = (a != b) & ~over
            here, a, b = here[left], a[left], b[left]
        late = np.argwhere(ends != end)  # no common state within the segment: the next one rests on another state than was assumed
        end[:] = ends
        for k, s in late.tolist():
            while s + 1 < len(follows) and follows[s + 1] and start[k, s + 1] != end[k, s]:
                s += 1
                a, b = start.item(k, s), end.item(k, s - 1)
                start[k, s] = b
                for symbol in grid[s, : size[s]].tolist():
                    (a, first), (b, second) = self.one(a, symbol, k), self.one(b, symbol, k)
                    count[k, s] += second - first
                    if a == b:
                        break
                else:
                    end[k, s] = b

    def one(self, state: int, symbol: int, language: int) -> tuple[int, bool]:
        found = self.moves.item(state + symbol)
        return (found & PLACE, False) if found >> 32 == state else (self.roots.item(language, symbol), True)

    def phrases(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (text, language) and symbols of each text; no symbols without a letter."""
        streams = []
        for text in batch:
            stream = letters(text, self.codes)
            streams.append(self.numbers[stream] if stream.any() else np.zeros(0, self.numbers.dtype))
        lengths = np.array([len(s) for s in streams], np.int64)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(batch)), pieces)
        grid = np.zeros(len(owner) * SEGMENT, self.numbers.dtype)
        size = np.full(len(owner), SEGMENT, np.int64)
        at = 0
        for stream, n in zip(streams, pieces.tolist(), strict=True):
            grid[at * SEGMENT : at * SEGMENT + len(stream)] = stream
            if n:
                size[at + n - 1] = len(stream) - (n - 1) * SEGMENT
            at += n
        grid = grid.reshape(-1, SEGMENT)
        end, count = self.walked(grid, size)
        self.joined(grid, size, np.r_[False, owner[1:] == owner[:-1]][: len(owner)], end, count)
        total = np.zeros((len(batch), len(self.languages)), np.int64)
        np.add.at(total, owner, count.T)
        return total, lengths

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(batch), np.zeros(len(batch))
        total, lengths = self.phrases(batch)
        rate = total / np.maximum(lengths, 1)[:, None]
        best = rate.argmin(axis=1)
        # the winner's share when each language weighs 2 ** -(phrases above the winner's)
        weights = np.exp2(-np.minimum(total - total.min(axis=1)[:, None], 1000).astype(float))
        score = np.where(lengths > 0, 1 / weights.sum(axis=1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), lengths.tolist(), strict=True)], score


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, sample_rows: int = 64, sample_chars: int = 40_000) -> Model:
    """Learn from the rows where ``learn`` holds and the language is known."""
    known = df.filter(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = known.select("id", "lang", place.alias("k")).filter(F.col("k") <= sample_rows)
    ids = [r["id"] for r in chosen.collect()]
    rows = df.filter(learn & F.col(id_col).isin(ids) & F.col(lang_col).isNotNull())
    # very long texts come as pieces from start to end, so that the driver's memory is bounded; Model takes each text's part over its length
    whole = F.coalesce(F.col(text_col), F.lit(""))
    size, piece = F.char_length(whole), max(1, 4 * sample_chars // PIECES)
    starts = [F.floor((size - piece) * (k / (PIECES - 1))).cast("int") + 1 for k in range(PIECES)]
    text = F.when(size <= 4 * sample_chars, whole).otherwise(F.concat_ws(" ", *[F.substring(whole, s, piece) for s in starts]))
    one = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(lang_col).alias("lang"), text.alias("text"))).alias("r"))
    samples: dict[str, list[str]] = {}
    for r in one.select("id", "r.*").orderBy(F.xxhash64("id"), "id").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples, sample_chars)


def identify(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``id_col, lang_pred, score`` (0 to 1), a row for each row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([df.schema[id_col], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for batch in by_bytes(batches, "text", 2 << 20):
            names, score = shared.value.predict(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
