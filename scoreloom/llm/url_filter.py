"""URL filter: a trie over reversed host labels, then over path segments, with the longest rule winning.

A rule is a host and a path prefix (``example.net/en/``) with the action ``allow`` or ``block``. It fits
its host and every subdomain when the url's path starts with the rule's path. Of the fitting rules the one
with the longest text wins, then the one with more host labels; the same text given twice with both
actions blocks. A url without a fitting rule gets ``default``.

The rules are the caller's list, so the trie's size is that of the list, whatever the number of urls; it
is broadcast once and every url is judged in one walk, without a shuffle.

Defined cases: null or no ``://``: host and path empty, no rule; empty path: no rule fits, since rule
paths start with ``/``; ports and user names stay part of the host; repeated rows are judged one by one;
further columns of the input are left out, so none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

HOST = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class PathNode:
    """Whole segments lead on; a rule's last, possibly cut, segment is a tail of its node."""

    following: dict[str, PathNode] = field(default_factory=dict)
    tails: dict[str, tuple[tuple, Rule]] = field(default_factory=dict)

    def fitting(self, segments: list[str]) -> Iterator[tuple[tuple, Rule]]:
        node = self
        for segment in segments:
            for tail, found in node.tails.items() if len(node.tails) < 8 else node.cut(segment):
                if segment.startswith(tail):
                    yield found
            node = node.following.get(segment)
            if node is None:
                return

    def cut(self, segment: str) -> Iterator[tuple[str, tuple[tuple, Rule]]]:
        for n in range(len(segment) + 1):
            if segment[:n] in self.tails:
                yield segment[:n], self.tails[segment[:n]]


@dataclass
class HostNode:
    below: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode | None = None


def build(rules: Iterable[Rule]) -> HostNode:
    root = HostNode()
    for rule in rules:
        if rule.action not in ("allow", "block") or not rule.host or not rule.path.startswith("/"):
            raise ValueError(f"not a rule: {rule}")
        labels, node = rule.host.translate(LOWER).split("."), root
        for label in reversed(labels):
            node = node.below.setdefault(label, HostNode())
        node.paths = place = node.paths or PathNode()
        *whole, tail = rule.path.split("/")
        for segment in whole:
            place = place.following.setdefault(segment, PathNode())
        key = (len(rule.text), len(labels), rule.action == "block")
        place.tails[tail] = max(place.tails.get(tail, ((), None)), (key, rule), key=lambda x: x[0])
    return root


def longest(trie: HostNode, host: str, path: str) -> Rule | None:
    best: tuple[tuple, Rule | None] = ((), None)
    node, segments = trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.below.get(label)
        if node is None:
            break
        if node.paths is not None:
            for found in node.paths.fitting(segments):
                if found[0] > best[0]:
                    best = found
    return best[1]


def parts(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = HOST.match(url, at + 3)
    return host.group().translate(LOWER), PATH.match(url, host.end()).group()


def judge(df: DataFrame, id_col: str, url_col: str, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict``, one row for each row of ``df``."""
    trie = df.sparkSession.sparkContext.broadcast(build(rules))
    names = ("host", "path", "rule", "verdict")
    if id_col in names:
        raise ValueError(f"the id column can't be named {id_col}")
    schema = StructType([df.schema[id_col], *[StructField(n, StringType()) for n in names]])

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = longest(trie.value, host, path)
                rows.append((host, path, rule and rule.text, rule.action if rule else default))
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] or [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    return df.select(id_col, url_col).mapInArrow(run, schema)
