"""The pipeline against a brute-force version, and its awkward rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_near import expected_groups
from tokenizers import Tokenizer

from scoreloom.llm import pii, quality
from scoreloom.llm.queries import held_out


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.fit(docs, "doc_id", "text", spark.read.parquet(f"{sf}/labels.parquet"), "quality", ~held_out())
    features = quality.Features()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    rows = [(d, t) for d, t in rows if machine.score([features.of(t)])[0] >= 0.3]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    first = {}
    for d, t in rows:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), d)
    rows = [(d, t) for d, t in rows if d in set(first.values())]
    stay = {c for _, _, c in expected_groups(rows)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows:
        if d in stay:
            ids = [*library.encode(pii.masked(t, pii.base_spans(t)), add_special_tokens=False).ids, 0]
            cut = (len(ids) - 1) % 2048 + 1
            for k, s in enumerate([0, *range(cut, len(ids), 2048)]):
                own = ids[s : s + 2048] if k else ids[:cut]
                want[d, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(int)
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_stages_of_awkward_rows(spark, sf):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "One fine day.", None, "s", 13), (3, "One fine day.", None, "s", 13), (4, "One  fine day.", "en", "s", 99),
            (5, "Write to a.b@c.org.", "en", "s", 1), (None, "Nobody's text, but a text.", "en", "s", 1), (6, "word and word. " * 20_000, "en", "s", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{spark.conf.get('spark.checkpoint.dir')}/awkward-{len(given)}-{name}"
            stage(spark, docs, sf).write.mode("overwrite").parquet(path)
            following = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert following.dtypes == docs.dtypes
            docs = following
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    docs = spark.createDataFrame(rows, kinds)
    kept = corpus_pipeline.exact_stage(spark, docs, sf)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6]
    masked = corpus_pipeline.pii_stage(spark, docs, sf).filter(F.col("doc_id") == 5).first()
    assert masked["text"] == "Write to [EMAIL]." and masked["n_chars"] == 17
