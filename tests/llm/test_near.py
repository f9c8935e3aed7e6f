"""SimHash groups, components and fingerprints against brute force and awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import LONG, ROWS, awkward, documents

from scoreloom.llm import fingerprint, simhash
from scoreloom.llm.components import connected
from scoreloom.llm.queries import QUERIES


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(i, i + 1) for i in range(80)], "random"])
def test_components(spark, edges):
    random.seed(6)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] if edges == "random" else edges
    rows = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert len(rows) == len(nodes) and {r["node"]: r["root"] for r in rows} == roots([e for e in edges if e[0] != e[1]], nodes)


def plain(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_sparks_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first()["h"] == np.array([simhash.fingerprint("A b\nC")], np.uint64).view(np.int64)[0]
    for text in [None, "", "x", "x Y", "é É\x1c a\x0bb", LONG[:5000]]:
        assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("size", [30, 3000])
def test_linked_in_a_bucket(size):
    random.seed(size)
    seeds = [random.getrandbits(22) for _ in range(size // 6)]
    values = np.array(sorted({s ^ (1 << random.randrange(22)) ^ (1 << random.randrange(22)) for s in seeds for _ in range(6)}), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    want = roots(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True), range(len(values)))
    for limit in (simhash.MATRIX, 1):
        old, simhash.MATRIX = simhash.MATRIX, limit
        try:
            assert simhash.linked(values, (1 << 22) - 1, 2).tolist() == [want[i] for i in range(len(values))]
        finally:
            simhash.MATRIX = old


def test_links_join_all_close_fingerprints(spark):
    random.seed(8)
    values = {random.getrandbits(64) for _ in range(150)}
    for v in list(values):
        values.add(v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
        if random.random() < 0.3:
            values.add(v ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    values = np.array(sorted(values), np.uint64)
    signed = values.view(np.int64).tolist()
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2).collect()}
    near = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    want = roots([(signed[a], signed[b]) for a, b in zip(*near, strict=True)], signed)
    assert roots(found, signed) == want and len(set(want.values())) < len(signed)


def expected_groups(rows, width=3):
    prints = [plain(t, width) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(near, range(len(rows)))
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root[i]] = min(d, smallest.get(root[i], d))
    return Counter((d, format(prints[i], "016x"), smallest.get(root[i])) for i, (d, _) in enumerate(rows))


def test_near_groups(spark, sf):
    assert Counter(map(tuple, simhash.near_groups(awkward(spark), "doc_id", "text").collect())) == expected_groups(ROWS)
    assert simhash.near_groups(awkward(spark, []), "doc_id", "text").count() == 0
    rows = QUERIES["op5_simhash_dedup"](spark, sf).collect()
    assert Counter(map(tuple, rows)) == expected_groups([(d, t) for d, t, _ in documents(sf)])


def test_one_document_of_each_component_stays(spark):
    df = awkward(spark)
    kept = simhash.near_deduplicated(df, "doc_id", "text")
    assert kept.columns == df.columns
    components = {c for _, _, c in expected_groups([r for r in ROWS if r[0] is not None])}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == components


def test_window_sums():
    data = np.frombuffer(random.Random(1).randbytes(400) + b"a" * 100 + b"abcd" * 50, np.uint8)
    for i, s in enumerate(fingerprint.window_sums(data)):
        counts = np.bincount(data[i : i + fingerprint.WINDOW])
        assert s == fingerprint._TERM[counts].sum()


def test_digests_ignore_neighbours():
    ranks = fingerprint.rarity(list(range(fingerprint.CLASSES)))
    texts = ["", "short", LONG[:3000], "é" * 200, LONG[100:900], "q" * 127, "q" * 128, "z" * 140_000]
    together = fingerprint.digests(texts, ranks)
    for text, digest in zip(texts, together, strict=True):
        assert np.array_equal(fingerprint.digests([text], ranks)[0], digest)
        assert fingerprint.likeness(digest, digest) == 1.0
    assert fingerprint.likeness(together[0], together[1]) == 0.0


def test_compare_with_next(spark):
    old, fingerprint.ROWS_PER_RANGE = fingerprint.ROWS_PER_RANGE, 3
    try:
        rows = fingerprint.compare_with_next(awkward(spark), "doc_id", "text").collect()
        single = fingerprint.compare_with_next(awkward(spark, [(7, "alone at last")]), "doc_id", "text").collect()
        assert fingerprint.compare_with_next(awkward(spark, []), "doc_id", "text").count() == 0
    finally:
        fingerprint.ROWS_PER_RANGE = old
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = Counter()
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(t or "") // 2
        want[d, (t or "")[: len(t or "") - half] + (following or "")[:half]] += 1
    assert Counter((r["doc_id"], r["edited"]) for r in rows) == want
    assert [(r["doc_id"], r["edited"], r["near_next"]) for r in single] == [(7, "alone a" + "alone ", 1.0)]
    prints = {(r["text"] or ""): r["fingerprint"] for r in rows}
    assert len({hashlib.sha256(p.encode()).digest() for p in prints.values()}) == len(prints)
    assert prints[""] == "" and next(r for r in rows if r["doc_id"] == 7)["near_next"] == 1.0


def brute_classes(raw):
    sums = (fingerprint._TERM[np.bincount(np.frombuffer(raw[i : i + 32], np.uint8))].sum() for i in range(len(raw) - 31))
    return [int(min((fingerprint._FULL - s) * 64 // fingerprint._FULL, 63)) for s in sums]


def brute_features(text, ranks):
    """Window by window, run by run; runs may reach over the ends of the text."""
    raw = text.encode()
    rank = [int(ranks[c]) for c in brute_classes(raw)]
    wins = Counter()
    for run in range(-31, len(rank)):
        wins[min((rank[i], i) for i in range(max(run, 0), min(run + 32, len(rank))))] += 1
    chosen = [i for r, i in sorted(wins, key=lambda w: w[1]) if r < 64 and wins[r, i] >= 8]
    mask = (1 << 64) - 1
    out = []
    for i in chosen:
        h = sum(b * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(raw[i : i + 32])) & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        out.append(h ^ h >> 31)
    return list(dict.fromkeys(out))


def test_features_equal_brute_force(spark, sf):
    texts = [t for _, t, _ in documents(sf) if t and len(t) >= fingerprint.SHORT][:12] + ["ab" * 300, "é" * 150 + "".join(map(chr, range(33, 400)))]
    counts = fingerprint.class_counts(spark.createDataFrame([(t,) for t in [*texts, "short", "", None]], "text string"), "text")
    total = Counter(c for t in texts for c in brute_classes(t.encode()))
    assert counts == [total[c] for c in range(fingerprint.CLASSES)]
    ranks = fingerprint.rarity(counts)
    expected = [brute_features(t, ranks) for t in texts]
    old = fingerprint.BLOCK
    try:
        for block in (old, 1000, 97):  # texts of one block and of many
            fingerprint.BLOCK = block
            for got, e, t in zip(fingerprint.features(texts, ranks), expected, texts, strict=True):
                assert got.tolist() == (e or fingerprint.features([t], ranks)[0].tolist())
    finally:
        fingerprint.BLOCK = old
    assert sum(map(bool, expected)) >= 12


def test_likeness_equals_brute_force():
    rng = np.random.default_rng(4)
    a, b = ((rng.random((n, fingerprint.FILTER_BITS)) < 0.3).astype(np.uint8) for n in (150, 70))
    a[40:90] |= b[10:60]

    def one_way(a, b):
        score = []
        for x in a:
            best = 0.0
            for y in b:
                both, chance = int((x & y).sum()), x.sum() * y.sum() / 2048
                if both > chance + 2 * (chance * (2048 - x.sum()) * (2048 - y.sum()) / 2048 / 2047) ** 0.5:
                    best = max(best, min(1, (both - chance) / (min(x.sum(), y.sum()) - chance)))
            score.append(best * x.sum())
        return sum(score) / a.sum()

    assert np.isclose(fingerprint.likeness(a, b), (one_way(a, b) + one_way(b, a)) / 2)


def test_fingerprint_query(spark, sf):
    rows = QUERIES["op2_document_fingerprint"](spark, sf).collect()
    assert len(rows) == len(documents(sf))
    long = [r for r in rows if r["n_chars"] >= 300]
    assert np.mean([r["near_edited"] > 0.3 for r in long]) > 0.95 and np.mean([r["near_next"] < 0.1 for r in long]) > 0.95
