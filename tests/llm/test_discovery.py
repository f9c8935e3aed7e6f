"""Patterns beside which many mentions are new."""

import pytest
from fixtures import awkward

from scoreloom.llm import pii


@pytest.mark.parametrize("new", [10, 15, 30])
def test_many_new_mentions(spark, new):
    """A quarter, a third and a half of the mentions after ``mail`` are new; numbers after ``page`` are mostly no phones."""
    rows = [(i, f"mail user{i}@site{i}.example.com") for i in range(30)] + [(100 + i, f"mail bob{i} [at] host{i} [dot] org") for i in range(new)]
    rows += [(200 + i, f"page +1 (555) 010-{1000 + i}") for i in range(5)] + [(300 + i, f"page 555-010-{2000 + i}") for i in range(30)]
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.extract(awkward(spark, rows), "doc_id", "text").collect()}
    assert all(spans[i] == [pii.EMAIL] for i in [*range(30), *range(100, 100 + new)])
    assert all(spans[i] == [pii.PHONE] for i in range(200, 205)) and not any(spans[i] for i in range(300, 330))


def test_contexts_reach_whole_words():
    far = "call " + "1" * 100 + " -- " + "9" * 100 + " then"
    start = far.index("--")
    assert pii.contexts(far, [(0, start, start + 2)]) == [["call _", "_ then"]]
    long = "x" * 200
    (found,) = pii.contexts(f"a {long} 12 b", [(0, 203, 205)])
    assert found[0].startswith("#") and found[0].endswith(" _") and found[2] == "_ b" and len(found[1]) < 50
    assert pii.contexts("abc12def", [(0, 3, 5), (1, 1, 4)]) == [["abc _", "_ def"], ["a _", "_ def"]]
    assert pii.contexts("", []) == []


def test_many_mentions_take_linear_time():
    import time

    text = " ".join(f"555 {i % 900 + 100} {i % 9000 + 1000}," for i in range(16_000))
    start = time.perf_counter()
    found = pii.candidates(text, [])
    assert len(found) == 16_000 and len(pii.contexts(text, found)) == 16_000
    assert time.perf_counter() - start < 2
