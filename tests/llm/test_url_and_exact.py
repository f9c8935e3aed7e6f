"""URL filter and exact dedup against brute force, DuckDB and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from fixtures import ROWS, awkward
from pyspark.sql import functions as F

from scoreloom.llm import exact_dedup, url_filter
from scoreloom.llm.queries import ORACLE, QUERIES
from scoreloom.llm.url_filter import Rule

URLS = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.b.Example.NET/en/x?y", "https://example.net/english", "ftp://u:p@x.org:80/fr/",
        "http://x.example.com./de/", "http://example.com/de", "http://example.com/de/#/en/", "x://y://z.net/", "http://..net/", "http://org/fr/é"]


@pytest.mark.parametrize("name", ["op1_url_filter", "op9_exact_dedup"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want.select(", ".join(columns)).fetchall())


def test_rules_against_brute_force(spark):
    random.seed(1)
    labels, segments = ["a", "b", "net", "org"], ["x", "xy", "", "z"]
    rules = [Rule(random.choice(["allow", "block"]), ".".join(random.choices(labels, k=random.randint(1, 3))), "/" + "/".join(random.choices(segments, k=random.randint(0, 3)))) for _ in range(60)]
    trie = url_filter.build(rules)
    for _ in range(3000):
        host = ".".join(random.choices([*labels, ""], k=random.randint(1, 4)))
        path = "/".join(["", *random.choices(segments, k=random.randint(0, 4))])
        fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.text), r.host.count("."), r.action == "block"), default=None)
        found = url_filter.longest(trie, host, path)
        assert (found and (found.text, found.action)) == (best and (best.text, best.action))


def test_awkward_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    rules = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, "page_id", "url", rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("net", "", None, "allow") and got[5] == ("net", "/", "net/", "block")
    assert got[6] == ("a.b.example.net", "/en/x", "example.net/en/", "allow") and got[7][3] == "block"
    assert got[11] == ("example.com", "/de/", "example.com/de/", "block") and got[10][3] == "allow"
    assert url_filter.judge(df.limit(0), "page_id", "url", rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.build([Rule("block", "net", "x")])


def expected(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append((d is None, d, i))
    return Counter((d, min(g)[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, d, _ in g)


def weak(block, salt):
    """Collides until the third salt."""
    h = F.pmod(F.xxhash64(block), F.lit(3)) if salt < 2 else F.xxhash64(block)
    return [h.alias("h"), F.lit(0).alias("c")]


@pytest.mark.parametrize("size, digest", [(4096, exact_dedup.block_digest), (1000, weak)])
def test_awkward_texts(spark, size, digest):
    carry = {"sha": lambda t: F.sha2(t, 256)}
    got = exact_dedup.exact_groups(awkward(spark), "doc_id", "text", carry, size, digest)
    rows = got.collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["sha"]) for r in rows) == expected(ROWS)
    kept = Counter(r["sha"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({k[3] for k in expected(ROWS)})
    empty = awkward(spark, [])
    assert exact_dedup.exact_groups(empty, "doc_id", "text").count() == 0


def test_rows_that_stay(spark):
    df = awkward(spark)
    got = exact_dedup.deduplicated(df, "doc_id", "text")
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 3, 4, 5, 7, 9, 11, 12, 13]
