"""Personal data by bootstrapped contextual extraction.

Base rules find emails, IP addresses, card and phone numbers. They are the seeds: the words beside them are lexical
patterns, and other identifier-shaped mentions beside the same words are candidates. On the graph of patterns and
instances Spark scores, in ``ROUNDS`` rounds,

* a pattern by the share of its distinct instances that are believed to be of the kind (with one doubtful instance added,
  so that thin evidence counts little), provided ``SUPPORT`` believed instances stand beside it. Instances of other kinds count in full,
  those of its own kind that nothing vouches for yet only by ``UNSEEN``: they are what is to be found;
* an instance by 1 - product(1 - pattern score) over its patterns; seeds stay at 1.

Candidates that reach ``CONFIDENT`` through patterns that reach it are added; base spans always stay. A pattern beside which several
kinds occur (``the``) scores low for each, so ordinary numbers are left alone.

Scale: texts are read once; what is scored is a table of mentions with a few words each. Joins on patterns or
instances read written tables, so adaptive execution can split a frequent pattern, and counts are combined
before their exchange. Each row's spans are gathered by row, which a text bounds.

Defined cases: null counts as empty; an empty text has no spans; repeated rows and ids stay rows; offsets are code points,
ends exclusive; added spans never overlap base ones or each other; further columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import cut_lineage
from .batches import by_bytes, texts, unused
from .components import Steps

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROUNDS = 3
SUPPORT = 4
CONFIDENT = 0.8
UNSEEN = 0.2  # weight of a doubt about the own kind: a pattern bears about as many new instances as believed ones
NAMED = 64  # a longer word stands in a pattern as its digest

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
NUMBER = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Shapes of candidates, by kind; looser than the base rules, and only believed beside the right words.
SHAPES = {
    EMAIL: re.compile(r"[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])? ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){0,4}"),
    IP: re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    CARD: re.compile(r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-])"),
    PHONE: re.compile(r"(?<![\w.(-])(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){1,3}(?![\w-])"),
}
BEFORE_AT, AFTER_AT = 65, 344  # the longest that the first shape can have before and behind its sign
WORD = re.compile(r"[^\W\d_]+")
AT = re.compile(r"@|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and domain: the local part is the whole run before the sign, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    found = [(EMAIL, *span) for span in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in ADDRESS.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append((IP, *m.span()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, *m.span()))
    for m in NUMBER.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((PHONE, *m.span()))
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-shaped mentions outside ``taken`` and each other."""
    spans = sorted((s, e) for _, s, e in taken)
    found: list[tuple[int, int, int]] = []
    edges = [0, *[x for s, e in spans for x in (s, e)], len(text)]
    for low, high in zip(edges[::2], edges[1::2], strict=True):  # the gaps between base spans; overlapping ones leave none
        if high <= low:
            continue
        starts: list[int] = []  # of what is found in the gap, sorted, and where each of them ends
        ends: list[int] = []
        for kind, shape in SHAPES.items():
            if kind == IP and text.count(":", low, high) < 4 or kind in (CARD, PHONE) and not DIGIT.search(text, low, high):
                continue
            if kind == EMAIL:
                places = [m for a in AT.finditer(text, low, high) for m in shape.finditer(text, max(low, a.start() - BEFORE_AT), min(high, a.end() + AFTER_AT))]
            else:
                places = shape.finditer(text, low, high)
            for m in places:
                s, e = m.span()
                if kind == PHONE and not 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                    continue
                at = bisect_left(starts, s)
                if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
                    starts.insert(at, s)
                    ends.insert(at, e)
                    found.append((kind, s, e))
    return found


def _word(text: str, start: int, end: int) -> str:
    word = text[start:end].lower()
    return word if len(word) <= NAMED else "#" + hashlib.md5(word.encode()).hexdigest()


def contexts(text: str, mentions: list[tuple[int, int, int]]) -> list[list[str]]:
    """For each mention the word before, the two words before and the word after, however far away, each as a pattern."""
    before: list[tuple] = [()] * len(mentions)
    after: list[str | None] = [None] * len(mentions)
    words, word = WORD.finditer(text) if mentions else iter(()), None
    last: tuple = ()
    word = next(words, None)
    for i in sorted(range(len(mentions)), key=lambda i: mentions[i][1]):
        start = mentions[i][1]
        while word and word.end() <= start:
            last, word = (*last[-1:], word.span()), next(words, None)
        # a word that the mention cuts counts with its part outside
        before[i] = (*last[-1:], (word.start(), start)) if word and word.start() < start else last
    words = WORD.finditer(text) if mentions else iter(())
    word = next(words, None)
    for i in sorted(range(len(mentions)), key=lambda i: mentions[i][2]):
        end = mentions[i][2]
        while word and word.end() <= end:
            word = next(words, None)
        if word:
            after[i] = _word(text, max(word.start(), end), word.end())
    out = []
    for spans, follows in zip(before, after, strict=True):
        own = [_word(text, *span) for span in spans]
        patterns = [f"{own[-1]} _"] if own else []
        if len(own) == 2:
            patterns.append(f"{own[0]} {own[1]} _")
        out.append(patterns + ([f"_ {follows}"] if follows else []))
    return out


SCAN = "base array<struct<kind int, start long, `end` long>>, mentions array<struct<kind int, start long, `end` long, value string, seed boolean, patterns array<string>>>"


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, base, mentions``, written: one pass over the texts."""
    schema = StructType([StructField("id", df.schema[id_col].dataType), *_parse_datatype_string(SCAN).fields])
    span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    mention = [*span, ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]

    def run(batches):
        for batch in by_bytes(batches, "text"):
            base, mentions = [], []
            for text in texts(batch.column(1)):
                own = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                every = [(x, True) for x in own] + [(x, False) for x in candidates(text, own)]
                mentions.append([
                    {"kind": k, "start": s, "end": e, "value": text[s:e].lower(), "seed": seed, "patterns": patterns}
                    for ((k, s, e), seed), patterns in zip(every, contexts(text, [x for x, _ in every]), strict=True)
                ])
            arrays = [pa.array(base, pa.list_(pa.struct(span))), pa.array(mentions, pa.list_(pa.struct(mention)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "base", "mentions"])

    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return cut_lineage(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def believed(scanned: DataFrame) -> DataFrame:
    """``kind, value``: instances that confident patterns vouch for, without the seeds."""
    steps = Steps(scanned.sparkSession)
    mention = scanned.select(F.explode("mentions").alias("m")).select("m.kind", "m.value", "m.seed", F.explode("m.patterns").alias("pattern"))
    graph = steps.write("graph", mention.groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed")))
    instances = graph.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    beliefs = steps.write("beliefs", instances)
    for _ in range(ROUNDS):
        edges = steps.write("edges", graph.select("kind", "value", "pattern").join(beliefs, ["kind", "value"]))
        strong = (F.col("belief") >= CONFIDENT).cast("int")
        per_kind = edges.groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.sum(strong).alias("support"), F.count(F.lit(1)).alias("n"))
        every = per_kind.groupBy("pattern").agg(F.sum("n").alias("every"))
        weight = F.col("every") - (1 - UNSEEN) * (F.col("n") - F.col("mass")) + 1
        scored = per_kind.join(every, "pattern").filter(f"support >= {SUPPORT}").select("pattern", "kind", (F.col("mass") / weight).alias("score"))
        patterns = steps.write("patterns", scored.filter(f"score >= {CONFIDENT}"))
        vouched = edges.join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("vouched"))
        raised = beliefs.join(vouched, ["kind", "value"], "left")
        beliefs = steps.write("beliefs", raised.select("kind", "value", F.greatest("belief", F.coalesce("vouched", F.lit(0.0))).alias("belief")))
    seeds = graph.filter("seed").select("kind", "value").distinct()
    return beliefs.filter(f"belief >= {CONFIDENT}").join(seeds, ["kind", "value"], "left_anti").select("kind", "value")


def _added(scanned: DataFrame) -> DataFrame:
    """``row, added``, written: the spans that the patterns add, only rows that have any."""
    more = scanned.select("row", F.explode("mentions").alias("m")).filter("NOT m.seed").select("row", "m.kind", "m.start", "m.end", "m.value")
    found = cut_lineage(believed(scanned))
    return cut_lineage(more.join(found, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))


def extract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, base, spans``: arrays of (kind, start, end) sorted by kind and start, a row for each row of ``df``."""
    scanned = scan(df, id_col, text_col)
    joined = scanned.select("row", "id", "base").join(_added(scanned), "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return joined.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def named(spans):
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` with their personal data masked, all other columns as they were.

    Base spans follow from a row's own text; the added ones are joined by id and a digest of the text. That table holds only rows
    that the patterns add spans to, so Spark broadcasts it while it is small and texts aren't exchanged.
    """
    digest = F.xxhash64(F.coalesce(text_col, F.lit("")))
    scanned = scan(df.select(F.struct(F.col(id_col).alias("pii_id"), digest.alias("pii_hash")).alias("pii_key"), F.col(text_col).alias("pii_text")), "pii_key", "pii_text")
    added = _added(scanned).join(scanned.select("row", "id"), "row").select("id.*", "added").groupBy("pii_id", "pii_hash").agg(F.min("added").alias("pii_added"))
    row_id, row_hash, key_id, key_hash, spans_col = unused(df, "pii_row_id", "pii_row_hash", "pii_id", "pii_hash", "pii_added")
    rows = df.withColumns({row_id: F.col(id_col), row_hash: digest})
    added = cut_lineage(added).toDF(key_id, key_hash, spans_col)
    same = F.col(row_id).eqNullSafe(F.col(key_id)) & (F.col(row_hash) == F.col(key_hash))
    joined = rows.join(added, same, "left").select(*[rows[c] for c in df.columns], spans_col)
    names = df.columns
    at, width = names.index(text_col), len(names)

    def run(batches):
        for batch in by_bytes(batches, at, 4 << 20):
            new = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                spans = base_spans(text or "") + [(x["kind"], x["start"], x["end"]) for x in more or []]
                new.append(masked(text, spans) if spans else text)
            columns = list(batch.columns[:width])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, df.schema)
