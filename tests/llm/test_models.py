"""Language, quality and personal data: held-out accuracy, brute force and awkward rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from fixtures import ROWS, awkward, documents
from pyspark.sql import functions as F

from scoreloom.llm import language, pii, quality
from scoreloom.llm.queries import QUERIES, held_out


def phrases(text, training):
    """Cross-parsing by search for the longest match."""
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in training:
            n += 1
        count += 1
        at += max(n, 1)
    return count


def test_phrases_equal_brute_force():
    """Whole texts of one to many segments, texts of one phrase, periodic ones, and symbols that the sample lacks."""
    rng = random.Random(3)
    training = {"x": "".join(rng.choices("abc", k=300)), "y": " ".join("".join(rng.choices("bcef", k=4)) for _ in range(120)) + " " + "a" * 40}
    model = language.Model({name: [t] for name, t in training.items()}, 4000)
    texts = [rng.choices(rng.choice(["abcabcabcd", "bcefa", "a", "ab", "zqa", "bcefbcef "]), k=rng.choice([1, 2, 60, 255, 256, 257, 512, 700, 3000])) for _ in range(200)]
    texts = [" ".join("".join(t).split()) for t in texts] + [training["y"][100:] + training["x"] * 3]
    total, lengths = model.phrases(texts)
    for text, row, n in zip(texts, total.tolist(), lengths.tolist(), strict=True):
        assert row == [phrases(text, training[name] + " ") for name in ("x", "y")] and n == len(text)


def test_prediction_is_the_fewest_phrases(sf):
    texts = {}
    for _, text, lang in documents(sf):
        if text and lang:
            texts.setdefault(lang, []).append(text)
    model = language.Model({lang: t[:4] for lang, t in texts.items()}, 3000)
    held = [t[4] for t in texts.values() if len(t) > 4]
    total, lengths = model.phrases(held)
    names, scores = model.predict(held)
    for name, score, row in zip(names, scores, total.tolist(), strict=True):
        assert name == model.languages[row.index(min(row))] and np.isclose(score, 1 / sum(2.0 ** -(n - min(row)) for n in row))


def test_language_held_out(spark, sf):
    rows = QUERIES["op4_language_id"](spark, sf).collect()
    truth = {d: lang for d, _, lang in documents(sf)}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the a b lazy fox jumps", "en"), ("ünïcödé das und der", "de"), (None, "en"), ("x", None)])], "doc_id long, text string, lang string")
    model = language.fit(train, "doc_id", "text", "lang", F.lit(True))
    rows = language.identify(awkward(spark), "doc_id", "text", model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ROWS)
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3, 12)} == {("und", 0.0)}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (7, 8)} == {"en"} and language.identify(awkward(spark, []), "doc_id", "text", model).count() == 0
    none = language.fit(train.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in language.identify(awkward(spark), "doc_id", "text", none).collect()} == {"und"}


def test_machine_scores_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine()
    machine.linear, machine.factors, machine.bias = rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)), 0.3
    rows = [(np.sort(rng.choice(quality.SIZE, n, replace=False)).astype(np.int32), rng.normal(size=n).astype(np.float32)) for n in (1, 5, 12)]
    for (columns, values), got in zip(rows, machine.score(rows), strict=True):
        raw = machine.bias + machine.linear[columns] @ values
        raw += sum(machine.factors[columns[i]] @ machine.factors[columns[j]] * values[i] * values[j] for i in range(len(columns)) for j in range(i))
        assert np.isclose(got, 1 / (1 + np.exp(-raw)))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_quality_classifier"](spark, sf).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [r["score"] for r in held if labels[r["doc_id"]]], [r["score"] for r in held if not labels[r["doc_id"]]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97 and np.mean([g >= 0.3 for g in good]) >= 0.97
    assert len(rows) == 1000 and all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (5, None), (None, 1), (99, 1)], "doc_id long, quality int")
    machine = quality.fit(awkward(spark), "doc_id", "text", labels, "quality", ~held_out() | F.lit(True))
    rows = quality.score(awkward(spark), "doc_id", "text", machine).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.accepted(awkward(spark), "text", machine)
    assert kept.columns == awkward(spark).columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score(awkward(spark, []), "doc_id", "text", machine).count() == 0
    unlearned = quality.fit(awkward(spark), "doc_id", "text", labels.limit(0), "quality", F.lit(True))
    assert all(abs(r["score"] - 0.5) < 0.01 for r in quality.score(awkward(spark), "doc_id", "text", unlearned).collect())


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits(m)))))
        if 13 <= len(digits(m)) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_base_spans(sf):
    random.seed(3)
    texts = ["".join(random.choices("a1239.. @@+-()5%\n:", k=random.randint(0, 40))) for _ in range(20000)] + [t for _, t, _ in documents(sf)]
    for text in texts:
        base = pii.base_spans(text)
        assert [(pii.KINDS[k], s, e) for k, s, e in base] == plain_spans(text)
        more = pii.candidates(text, base)
        assert all(e <= a or b <= s for i, (_, s, e) in enumerate(more) for _, a, b in [*base, *more[:i]])
    assert pii.base_spans("4111 1111-1111 1111") == [(pii.CARD, 0, 19)]


def test_pii_query(spark, sf):
    rows = {r["doc_id"]: r for r in QUERIES["op8_pii"](spark, sf).collect()}
    for d, text, _ in documents(sf):
        want = plain_spans(text)
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(rows[d]["spans"].split(",")) | {""}


def test_words_beside_seeds_find_more(spark):
    seeds = [(200 + i, f"Please call me at +1 (555) 010-{1000 + i} today, or mail to user{i}@site{i}.example.com soon. Host 10.0.0.{i} up.") for i in range(30)]
    new = [(100, "please call me at 555-010-7788 today"), (101, "the price is 555-010-7799 in total"), (102, "or mail to bob [at] host [dot] org soon")]
    df = awkward(spark, [*ROWS, *seeds, *new])
    rows = pii.extract(df, "doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in [*ROWS, *seeds, *new])
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows}
    assert spans[100] == [(pii.PHONE, 18, 30)] and spans[101] == [] and spans[102] == [(pii.EMAIL, 11, 34)]
    assert all(not spans[d] for d, _ in ROWS)
    redacted = pii.redact(df, "doc_id", "text")
    assert redacted.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert texts[100] == "please call me at [PHONE] today" and texts[102] == "or mail to [EMAIL] soon" and texts[1] is None
    assert texts[200] == "Please call me at [PHONE] today, or mail to [EMAIL] soon. Host [IP] up." and texts[7] == dict(ROWS)[7]
    assert pii.extract(awkward(spark, []), "doc_id", "text").count() == 0
