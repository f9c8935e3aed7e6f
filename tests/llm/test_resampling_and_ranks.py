"""Importance resampling, byte-level BPE and cross-tokenizer alignment against brute force and the libraries."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from fixtures import LONG, ROWS, awkward, documents
from tokenizers import Tokenizer

from scoreloom.llm import alignment, byte_bpe, importance
from scoreloom.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATHS = BYTES, PIECES


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# ------------------------------------------------------------- resampling


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(words):
    return Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def expected_ranks(rows, target, percent=5, least=20):
    found = [(d, words_of(t)) for d, t in rows]
    source, wanted = Counter(), Counter()
    for _, w in found:
        source.update(buckets_of(w))
    for t in target:
        wanted.update(buckets_of(words_of(t)))
    s, t = sum(source.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s / ((source[b] + 1) * t))) for b in range(10_000)}
    out = []
    for d, w in found:
        own = buckets_of(w)
        weight = sum(gain[b] * n for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((-score, d) for d, _, _, score, n in out if n >= least)
    drawn = {d: k + 1 for k, (_, d) in enumerate(able[: math.floor(percent * len(able) / 100)])}
    return [(d, n, weight, score, drawn.get(d)) for d, n, weight, score, _ in out]


def test_running_crc_and_shifts():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 70_000, dtype=np.uint8)
    crc = importance.running(data)
    for a, b in [(0, 0), (0, 1), (5, 5), (255, 257), (17, 300), (3, 69_999), (0, 70_000), (40_000, 70_000)]:
        moved = importance.shifted(crc[[a]], np.array([b - a]))[0]
        assert crc[b] == zlib.crc32(data[:b]) and crc[b] ^ moved == zlib.crc32(data[a:b])
    assert importance.running(data[:0]).tolist() == [0]


def test_resampling_query(spark, sf):
    rows = [(d, t) for d, t, _ in documents(sf)]
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    got = [tuple(r) for r in QUERIES["op11_importance_resampling"](spark, sf).collect()]
    want = expected_ranks(rows, target)
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[4] is not None for r in want) >= 5


def test_resampling_of_awkward_rows(spark, monkeypatch):
    rows = [(d, t) for d, t in ROWS if d not in (4, None)] + [(20 + i, f"row {i} of " + "some more words here " * (i % 4)) for i in range(60)]
    target = spark.createDataFrame([(None,), ("",), ("some more words",), ("the quick brown fox",)], "body string")
    got = [tuple(r) for r in importance.ranked(awkward(spark, rows), target, "doc_id", "text", "body", percent=30, min_words=8).collect()]
    want = expected_ranks(rows, ["some more words", "the quick brown fox"], 30, 8)
    assert sorted(got, key=str) == sorted(want, key=str)
    drawn = importance.resample(awkward(spark, rows), target, "doc_id", "text", "body", percent=30, min_words=8)
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r[0] for r in want if r[4]) and "score" in drawn.columns
    repeated = importance.ranked(awkward(spark), target, "doc_id", "text", "body", percent=100, min_words=1).collect()
    assert len(repeated) == len(ROWS) and sorted(r["rank"] for r in repeated if r["rank"]) == list(range(1, sum(bool(words_of(t)) for _, t in ROWS) + 1))
    nothing = awkward(spark, [])
    assert importance.ranked(nothing, target, "doc_id", "text", "body").count() == 0
    assert importance.ranked(awkward(spark, rows), target.limit(0), "doc_id", "text", "body").count() == len(rows)


def test_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    text = "Word and Ünïcode; " * 900 + "x" * 5000 + " the end. A b"
    monkeypatch.setattr(importance, "SLICE", 700)
    own = Counter()
    for scan, _, since in importance._scans(pa.array([text]), 3):
        for _, crc in scan.grams(3, since):
            own.update((crc % 10_000).tolist())
    assert own == buckets_of(words_of(text))


# ------------------------------------------------------------- byte-level BPE


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    random.seed(3)
    keys = list({bytes(random.choices(range(256), k=random.randint(1, 9))) for _ in range(5000)})
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.key_of.tolist()) == list(range(len(keys)))
    asked = keys + [k + b"?" for k in keys] + [b"", b"\0"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(k) for k in asked])
    where = {k: i for i, k in enumerate(keys)}
    assert table.find(data, ends - [len(k) for k in asked], ends).tolist() == [where.get(k, -1) for k in asked]
    assert byte_bpe.PerfectHash([]).find(data, ends[:2] - 1, ends[:2]).tolist() == [-1, -1]


def test_bytes_equal_the_library(sf):
    theirs, own = library(), byte_bpe.Ranks(RANKS, memory=5000)
    random.seed(7)
    signs = ["'", "s", "re", "'ll", "'ve", "ve", " ", "  ", "\n", "\t", "a", "Zq", "é", "1", "23", "²", "　", " ", "中", "😀", ".", ",", "!'", "'S", "\x1c", "͸",
             "꟱", "\U000323b0", "x" * 70, "<|endoftext|>"]
    texts = ["", *["".join(random.choices(signs, k=random.randint(0, 14))) for _ in range(6000)], *[t for _, t, _ in documents(sf)], LONG]
    for at in range(0, len(texts), 300):
        batch = texts[at : at + 300]
        for text, ids in zip(batch, own.encode(batch), strict=True):
            want = theirs.encode_ordinary(text)
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert own.decode(ids) == text.encode()
    assert own.decode(np.array([4_000_000_000, own.ranks[b"a"]], "<u4").tobytes()) == b"a"


def test_bytes_of_every_code_point():
    theirs, own = library(), byte_bpe.Ranks(RANKS)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 8000):
        text = " a".join(every[at : at + 8000])
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == theirs.encode_ordinary(text)


def test_long_text_in_parts():
    text = "It's  a day\n in 'May'. " * 200
    parts = byte_bpe.cut(text, 100)
    theirs = library()
    assert "".join(parts) == text and len(parts) > 30
    assert [i for p in parts for i in theirs.encode_ordinary(p)] == theirs.encode_ordinary(text)


def test_byte_bpe_query_and_awkward_rows(spark, sf):
    theirs = library()

    def want(rows):
        found = [(d, t or "", theirs.encode_ordinary(t or "")) for d, t in rows]
        return Counter((d, len(ids), digest(ids), hashlib.sha256(t.encode()).hexdigest()) for d, t, ids in found)

    rows = QUERIES["op12_byte_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, rows)) == want([(d, t) for d, t, _ in documents(sf)])
    made = byte_bpe.decode(byte_bpe.encode(awkward(spark), "doc_id", "text", RANKS), "doc_id", RANKS).collect()
    made = [(r["doc_id"], len(r["ids"]) // 4, hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in made]
    assert Counter(made) == want(ROWS)
    assert byte_bpe.encode(awkward(spark, []), "doc_id", "text", RANKS).count() == 0


# --------------------------------------------------------------- alignment


def expected_alignment(rows):
    letters = {c: b for b, c in enumerate(alignment.byte_letters())}
    theirs = Tokenizer.from_file(BYTES)
    theirs.encode_special_tokens = True
    names = {i: t for t, i in theirs.get_vocab().items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs, total = [], Counter()
    for d, text in rows:
        a = theirs.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_a = [bytes(letters[c] for c in names[i]) if i != 50256 else b"<|endoftext|>" for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            docs.append((d, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            stop = min(ends_a[i], ends_b[j])
            i, j = i + (ends_a[i] == stop), j + (ends_b[j] == stop)
        groups, i, j = [], 0, 0
        for c in cuts:
            own_a, own_b = [], []
            while i < len(a) and ends_a[i] <= c:
                own_a.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= c:
                own_b.append(b[j])
                j += 1
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
        total.update(links)
        docs.append((d, a, b, groups, links))
    top = Counter()
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    return Counter(
        (d, len(a), len(b), len(g), len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), ";".join(g)) for d, a, b, g, links in docs
    )


def test_coalescing_and_overlaps():
    group = alignment.coalesced(np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9]), np.array([0, 0, 0, 1, 1, 1]))
    assert group.tolist() == [0, 0, 1, 0, 0, 1]
    a, b = alignment.overlaps(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 2, 5]), np.array([2, 5, 9]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_alignment_query(spark, sf):
    rows = QUERIES["op13_tokenizer_alignment"](spark, sf).collect()
    want = Counter()
    for (*numbers, groups), n in expected_alignment([(d, t) for d, t, _ in documents(sf)]).items():
        want[(*numbers, hashlib.sha256(groups.encode()).hexdigest() if groups else "")] += n
    columns = ["doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in rows) == want


def test_alignment_of_awkward_rows(spark):
    rows = [*ROWS, (30, "▁ odd"), (31, "  two  spaces "), (32, "<0x41> <s> </s> <unk>"), (33, "ﬁ   x́"), (34, LONG * 9 + "last one")]
    stored = f"{spark.conf.get('spark.checkpoint.dir')}/aligned"
    alignment.align(awkward(spark, rows), "doc_id", "text", *PATHS).write.mode("overwrite").parquet(stored)
    found = spark.read.parquet(stored)
    got = alignment.link_counts(found, ["doc_id", *alignment.COUNTS, "groups"]).collect()
    columns = ["doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == expected_alignment(rows)
    assert max(len(t or "") for _, t in rows) > alignment.SLICE
    alignment.align(awkward(spark, []), "doc_id", "text", *PATHS).write.mode("overwrite").parquet(stored + "-empty")
    assert alignment.link_counts(spark.read.parquet(stored + "-empty"), ["doc_id"]).count() == 0
