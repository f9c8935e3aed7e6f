"""BPE, packing and sharding against the library, brute force and awkward rows."""

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from fixtures import LONG, ROWS, awkward, documents
from tokenizers import Tokenizer

from scoreloom.llm import bpe, packing, shards
from scoreloom.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def ids(found):
    return np.array(found.ids, "<u4").tobytes()


def test_bpe_equals_the_library(sf):
    library, own = Tokenizer.from_file(WORDS), bpe.Bpe(WORDS, memory=500)
    random.seed(4)
    alphabet = ["the", "Th", "é", "E\u0301", "ß", "Σ", "İ", " ", "\n", "'s", "'", "12", "ñ", "😀", "<|endoftext|>", "<|start", "|>", "\u00a0", "-", "中", "aaaaaaaaaa", "\x1c", "\u200b"]
    texts = ["", *["".join(random.choices(alphabet, k=random.randint(1, 20))) for _ in range(4000)], *[t for _, t, _ in documents(sf)], LONG]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == ids(found), text
        assert own.decode(ids(found)) == library.decode(found.ids, skip_special_tokens=False)


def test_bpe_of_all_code_points():
    """Alone, in a word, and beside marks of the first and last class; the library's own ids for each."""
    library, own = Tokenizer.from_file(WORDS), bpe.Bpe(WORDS)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0x110000, 61), *range(0xE0000, 0xE1000))]
    for i in range(0, len(points), 20_000):
        texts = [f"{c} ab{c}Cd {c}1! " for c in points[i : i + 20_000]]
        for text, expected in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == expected.ids, ascii(text)
    odd = bpe.unlike(WORDS)
    assert len(odd) > 1000
    texts = [f"x\u0345{c}\u0334y {unicodedata.normalize('NFD', c)}e\u0301 plain {c}{c}" for c in odd]
    for text, expected in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected.ids, ascii(text)


def test_bpe_of_awkward_rows(spark):
    encoded = bpe.encode(awkward(spark), "doc_id", "text", WORDS)
    rows = bpe.decode(encoded, "doc_id", WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t in ROWS:
        found = library.encode(t or "", add_special_tokens=False)
        want[d, ids(found), library.decode(found.ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in rows) == want
    assert bpe.encode(awkward(spark, []), "doc_id", "text", WORDS).count() == 0


def test_parts_have_the_ids_of_the_whole():
    tokens = packing.Tokens(BYTES, memory=50)
    random.seed(2)
    alphabet = ["a", "B", "²", "7", ",", "|", "foo", "!?", ".", "  ", " ", " ", "\n", "\t", "é", "<|endoftext|>", "'s", "\x1c", "\0", "\u2028"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 14))) for _ in range(8000)]
    for at in range(0, len(texts), 100):
        batch = texts[at : at + 100]
        assert tokens.ids(batch) == [ids(f) for f in tokens.library.encode_batch(batch, add_special_tokens=False)]


def test_best_fit():
    first, place = packing.best_fit(np.array([7, 5, 4, 3, 1]), 10)
    assert first.tolist() == [0, 1, 1, 0, 1] and place.tolist() == [0, 0, 5, 7, 9]


def test_packing_of_awkward_rows(spark):
    pieces = packing.token_pieces(awkward(spark), "doc_id", "text", BYTES, 2048, 0)
    rows = packing.pack(pieces, group_items=4).collect()
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for d, t in ROWS:
        found = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(found) - 1) % 2048 + 1
        for k, s in enumerate([0, *range(first, len(found), 2048)]):
            own = found[s : s + 2048] if k else found[:first]
            want[d, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows) == want
    assert packing.pack(packing.token_pieces(awkward(spark, []), "doc_id", "text", BYTES)).count() == 0


def test_packing_is_gapless_and_tight(spark):
    random.seed(5)
    lengths = [random.choice([random.randint(1, 2048), random.randint(1, 300)]) for _ in range(6000)]
    items = spark.createDataFrame([(n, 9) for n in lengths], "length long, offset long")
    rows = packing.pack(items, group_items=500).collect()
    assert Counter(r["length"] for r in rows) == Counter(lengths)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    fills = sorted(sum(n for _, n in own) for own in bins.values())
    assert fills[0] + fills[1] > 2048
    whole = len(np.unique(packing.best_fit(np.sort(lengths)[::-1], 2048)[0]))
    assert len(bins) <= 1.01 * whole


def test_packing_to_a_root(spark):
    random.seed(6)
    lengths = [random.choice([1, random.randint(700, 1999), random.randint(900, 1100)]) for _ in range(1500)]
    items = spark.createDataFrame([(n,) for n in lengths], "length long")
    rows = packing.pack(items, group_items=6).collect()
    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    assert fills.total() == sum(lengths) and max(fills.values()) <= 2048
    assert sum(sorted(fills.values())[:2]) > 2048


def test_packing_when_nothing_fits(spark):
    items = spark.range(300).selectExpr("1100L AS length")
    assert packing.pack(items, group_items=50).select("sequence_id").distinct().count() == 300


def test_hypergeometric_sampler_beyond_the_library():
    rng = np.random.default_rng(0)
    draws = [shards.hypergeometric(rng, 2_000_000_000, 6_000_000_000, 400) for _ in range(4000)]
    assert abs(np.mean(draws) - 100) < 1 and abs(np.var(draws) - 75) < 8
    assert shards.hypergeometric(rng, 0, 10**10, 50) == 0 and shards.hypergeometric(rng, 10**10, 0, 50) == 50


def test_matrix_has_exact_margins():
    counts = [0, 5, 1000, 3, 0, 777, 1]
    matrix = shards.Matrix(counts, 7, seed=3)
    rows = np.array([matrix.row(p) for p in range(len(counts))])
    assert rows.sum(axis=1).tolist() == counts and (rows.sum(axis=0) == matrix.room).all() and np.ptp(matrix.room) <= 1


def test_shards_are_exact_and_uniform(spark, sf):
    df = spark.range(4800).repartition(5).sortWithinPartitions("id")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/shard-input"
    df.write.mode("overwrite").parquet(path)
    rows = shards.into_shards(spark.read.parquet(path), 8, seed=1).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["slot"], r["id"]))
    assert all(sorted(s for s, _ in own) == list(range(600)) for own in by.values()) and len(by) == 8
    assert len({r["id"] for r in rows}) == 4800
    means = [np.mean([i for s, i in own if s < 300]) for own in by.values()]
    assert all(abs(m - 2400) < 5 * 1386 / 300**0.5 for m in means)
    again = shards.into_shards(spark.read.parquet(path), 8, seed=1)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_shards_of_awkward_rows(spark):
    rows = shards.into_shards(awkward(spark), 4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(ROWS)
    assert sorted(Counter(r["shard"] for r in rows).values()) == [3, 4, 4, 4]
    assert shards.into_shards(awkward(spark, []), 4).count() == 0


def test_sharding_query(spark, sf):
    rows = QUERIES["op3_sharding"](spark, sf).collect()
    want = {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t, _ in documents(sf)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
