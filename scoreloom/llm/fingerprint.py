"""Document fingerprints by improbable features.

Every window of ``WINDOW`` bytes has an entropy class. Classes are ranked by how rare they are among all windows of
all texts, at every offset (one count over the corpus, ``class_counts``); windows below ``WEAKEST`` carry too little to count.
A window that is the rarest (first of equals) in at least ``POPULAR`` of the ``SPAN``-long runs of neighbouring windows
is a feature. Features go, in the order of the text, into chained Bloom filters of ``FILTER_BITS`` bits, at
most ``FILTER_FEATURES`` in one. Two fingerprints are compared filter by filter: the overlap of set bits, less what chance
gives, over the most that is possible; each filter takes its best partner, weighted by its set bits.

Entropies are kept in integers and a text never sees its neighbours in a batch, so equal texts have equal
fingerprints wherever they are.

Scale: the neighbour of a document is found without a global sort in one task: ids are cut into ranges, rows are
exchanged once by range and sorted there, and the first row of each range also goes to the range before it. A long text's
windows are looked at in blocks of ``BLOCK`` that overlap by as much as a choice can depend on, so memory beside the text itself is bounded.

Defined cases: null counts as empty; an empty text has an empty fingerprint, like only to another empty one (1); texts
under ``SHORT`` code points hold too few windows to choose from, and some long ones only weak windows: all their
``SHORT_WINDOW``-byte windows are features (a text shorter than that is one); ids are integers, null ids come first and equal ids are ordered by text;
after the last document comes the first; further columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .batches import by_bytes, texts

WINDOW = 32
SPAN = 32
POPULAR = 8
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
SHORT = 4 * WINDOW
SHORT_WINDOW = 8
CLASSES = 64
WEAKEST = CLASSES // 4
GAP = WINDOW + SPAN
ROWS_PER_RANGE = 500
MOST_RANGES = 100_000  # a range is read as a stream, so its size costs no memory
BLOCK = 1 << 20

_COUNTS = np.arange(WINDOW + 1, dtype=np.float64)
_TERM = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * (1 << 20)).astype(np.int64)  # c log c, fixed point
_STEP = np.diff(_TERM, prepend=0)
_FULL = int(_TERM[WINDOW])
_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def _classes(sums: np.ndarray) -> np.ndarray:
    """Entropy classes 0 to CLASSES - 1 of windows with these sums of c log c."""
    return np.minimum((_FULL - sums) * CLASSES // _FULL, CLASSES - 1)


def window_sums(data: np.ndarray) -> np.ndarray:
    """Sum of c log c over the byte counts of each window, for every offset."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW + 1) + order
    end = np.searchsorted(key, key + WINDOW)
    place = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)  # equal bytes in the window from here (itself too), and before it
    ahead[order] = end - place
    behind[order] = place - np.cumsum(np.bincount(end, minlength=n + 1))[:n]
    first = int(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    change = _STEP[behind[WINDOW:] + 1] - _STEP[ahead[: n - WINDOW]]
    return np.concatenate([[first], first + np.cumsum(change)])


def _groups(encoded: list[bytes]):
    """All windows of all texts in groups of pieces (text, bytes, windows that only stand beside, own windows), about ``BLOCK`` bytes a group."""
    group, size = [], 0
    for text, raw in enumerate(encoded):
        windows = max(0, len(raw) - WINDOW + 1)
        for start in range(0, windows, BLOCK):
            end, low = min(windows, start + BLOCK), max(0, start - SPAN)
            piece = raw[low : end + SPAN + WINDOW]
            group.append((text, piece, start - low, end - start))
            size += len(piece) + GAP
            if size >= BLOCK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _scanned(group: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' bytes with gaps around, where they start, the class of each window, and which windows lie in a piece and are its own."""
    sizes = np.array([len(piece) for _, piece, _, _ in group], np.int64)
    starts = GAP + np.cumsum(np.concatenate([[0], sizes[:-1] + GAP]))
    data = np.zeros(int(sizes.sum()) + GAP * (len(group) + 1), np.uint8)
    inside, own = np.zeros(len(data) - WINDOW + 1, bool), np.zeros(len(data) - WINDOW + 1, bool)
    for (_, piece, beside, count), start in zip(group, starts.tolist(), strict=True):
        data[start : start + len(piece)] = np.frombuffer(piece, np.uint8)
        inside[start : start + len(piece) - WINDOW + 1] = True
        own[start + beside : start + beside + count] = True
    return data, starts, _classes(window_sums(data)), inside, own


def class_counts(df: DataFrame, text_col: str) -> list[int]:
    """How many windows of all texts are in each entropy class."""

    def run(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in by_bytes(batches, 0, BLOCK):
            for group in _groups([t.encode("utf-8", "surrogatepass") for t in texts(batch.column(0))]):
                _, _, classes, _, own = _scanned(group)
                total += np.bincount(classes[own], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["class", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    counts = dict(found.collect())
    return [counts.get(c, 0) for c in range(CLASSES)]


def rarity(counts: list[int]) -> np.ndarray:
    """Rank of each class, 0 for the rarest; of equals the higher entropy first; weak classes get the rank CLASSES."""
    ranks = np.full(CLASSES, CLASSES, np.int64)
    for place, c in enumerate(sorted(range(WEAKEST, CLASSES), key=lambda c: (counts[c], -c))):
        ranks[c] = place
    return ranks


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def short_features(raw: bytes) -> np.ndarray:
    """Hashes of all short windows, each once, by their first place."""
    if 0 < len(raw) < SHORT_WINDOW:
        raw = raw.ljust(SHORT_WINDOW, b"\0")
    found = [np.zeros(0, np.uint64)]
    for start in range(0, len(raw) - SHORT_WINDOW + 1, 1 << 16):
        data = np.frombuffer(raw[start : start + (1 << 16) + SHORT_WINDOW - 1], np.uint8).astype(np.uint64)
        own = _mixed((np.lib.stride_tricks.sliding_window_view(data, SHORT_WINDOW) * _POWERS[:SHORT_WINDOW]).sum(axis=1, dtype=np.uint64))
        found.append(own[np.sort(np.unique(own, return_index=True)[1])])
    return np.concatenate(found)


def features(batch: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected windows of each text, in order, each once."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in batch]
    chosen: list[list[np.ndarray]] = [[] for _ in batch]
    for group in _groups([raw if len(text) >= SHORT else b"" for text, raw in zip(batch, encoded, strict=True)]):
        data, starts, classes, inside, own = _scanned(group)
        rank = ranks[classes]
        rank[~inside] = CLASSES
        key = rank << 40 | np.arange(len(rank))
        least, width = key, 1
        while width < SPAN:  # least of the 2, 4, ... SPAN windows from here
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = least[least < CLASSES << 40] & (1 << 40) - 1
        at = np.nonzero(np.bincount(least, minlength=1) >= POPULAR)[0]
        at = at[own[at]]
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        hashes = _mixed((view[at].astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64))
        cuts = [*np.searchsorted(at, starts).tolist(), len(hashes)]
        for k, (text, *_) in enumerate(group):
            chosen[text].append(hashes[cuts[k] : cuts[k + 1]])
    found = []
    for raw, parts in zip(encoded, chosen, strict=True):
        hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        if not len(hashes):
            hashes = short_features(raw)
        _, first = np.unique(hashes, return_index=True)
        found.append(hashes[np.sort(first)])
    return found


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chained Bloom filters as rows of 0 and 1."""
    rows = -(-len(hashes) // FILTER_FEATURES)
    bits = np.zeros((rows, FILTER_BITS), np.uint8)
    owner = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[owner, (hashes >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return bits


def digests(batch: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    return [filters(f) for f in features(batch, ranks)]


def _one_way(a: np.ndarray, b: np.ndarray) -> float:
    """How much of ``a`` the best partners among ``b`` hold, in blocks of filters."""
    m = FILTER_BITS
    sizes, nb = a.sum(axis=1, dtype=np.int64).astype(float), b.sum(axis=1, dtype=np.int64)[None, :].astype(float)
    partners = b.T.astype(np.float32)
    best = np.zeros(len(a))
    for start in range(0, len(a), 64):
        na = sizes[start : start + 64, None]
        both = a[start : start + 64].astype(np.float32) @ partners
        chance = na * nb / m
        spread = np.sqrt(chance * (m - na) * (m - nb) / m / (m - 1))
        score = np.where(both > chance + 2 * spread, (both - chance) / np.maximum(np.minimum(na, nb) - chance, 1e-9), 0.0)
        best[start : start + 64] = np.clip(score, 0, 1).max(axis=1)
    return float((best * sizes).sum() / sizes.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests; empty digests are like each other only."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return (_one_way(a, b) + _one_way(b, a)) / 2


def text_of(digest: np.ndarray) -> str:
    """Hex digits of the filters; empty for an empty text."""
    return np.packbits(digest, axis=1).tobytes().hex()


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``range, ahead, id, text``, exchanged by range and sorted: the row after a row (``ahead`` 0) is its next document."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = df.select(F.coalesce("id", F.lit(-(1 << 63))).alias("k"))
    count = ids.count()
    wanted = min(MOST_RANGES, max(1, -(-count // ROWS_PER_RANGE)))
    cuts = ids.agg(F.percentile_approx("k", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("c")).first()[0] if wanted > 1 and count else []
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("long")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right"))

    first = dict(ids.groupBy(range_of("k").alias("range")).agg(F.min("k")).collect())
    own = sorted(first)
    before = {first[r]: own[i - 1] for i, r in enumerate(own)}  # -1: the first range follows the last

    @F.pandas_udf("long")
    def range_before(k: pd.Series) -> pd.Series:
        return pd.Series([before.get(x, -1) for x in k.tolist()], dtype="int64")

    k = F.coalesce("id", F.lit(-(1 << 63)))
    placed = df.select("id", "text", range_of(k).alias("own"), range_before(k).alias("other"))
    place = lambda column, ahead: F.struct(F.col(column).alias("range"), F.lit(ahead).alias("ahead"))
    places = F.when(F.col("other") < 0, F.array(place("own", 0))).otherwise(F.array(place("own", 0), place("other", 1)))
    rows = placed.select(F.explode(places).alias("p"), "id", "text").select("p.range", "p.ahead", "id", "text")
    return rows.repartition("range").sortWithinPartitions("range", "ahead", "id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(df: DataFrame, id_col: str, text_col: str, counts: list[int] | None = None) -> DataFrame:
    """``id_col, text, edited, fingerprint, edited_fingerprint, near_edited, near_next``, a row for each row of ``df``."""
    ranks = rarity(class_counts(df, text_col) if counts is None else counts)
    names = ["text", "edited", "fingerprint", "edited_fingerprint"]
    schema = StructType([
        df.schema[id_col], *[StructField(n, StringType()) for n in names], StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
    ])

    def out(rows: list, digest: list[np.ndarray]) -> pa.RecordBatch:
        """``rows`` (range, ahead, id, text) and one row more, which only follows."""
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        new = [edited(rows[i][3] or "", rows[i + 1][3] or "") for i in pairs]
        changed = digests(new, ranks)
        columns = [
            [rows[i][2] for i in pairs], [rows[i][3] for i in pairs], new, [text_of(digest[i]) for i in pairs], [text_of(d) for d in changed],
            [likeness(digest[i], d) for i, d in zip(pairs, changed, strict=True)], [likeness(digest[i], digest[i + 1]) for i in pairs],
        ]
        kinds = [pa.int64(), *[pa.string()] * 4, *[pa.float64()] * 2]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([arrays[0].cast(id_type), *arrays[1:]], names=[id_col, *names, "near_edited", "near_next"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[df.schema[id_col].dataType.simpleString()]

    def run(batches: Iterable[pa.RecordBatch]):
        rows: list = []
        known: list[np.ndarray] = []
        for batch in by_bytes(batches, 3, BLOCK):
            fresh = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            rows += fresh
            known += digests([r[3] or "" for r in fresh], ranks)
            if len(rows) > 1:
                yield out(rows, known)
            rows, known = rows[-1:], known[-1:]

    return with_next(df, id_col, text_col).mapInArrow(run, schema)
