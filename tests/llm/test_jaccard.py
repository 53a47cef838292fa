"""Links and components against brute force over the sets."""

from __future__ import annotations

import itertools
import random

import pytest

from faultline.llm import jaccard
from faultline.llm.components import components

from .conftest import ODD


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        span = min(width, len(words))
        sets[i] = {tuple(words[k:k + span]) for k in range(len(words) - span + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def varied(seed, groups=12, size=9):
    """Groups of texts with different numbers of changed words, drifting copies, and a shared passage."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdefgh", k=4))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(groups):
        text = [word() for _ in range(pick.choice((4, 9, 12, 40, 120)))] + passage * pick.choice((0, 0, 1))
        for _ in range(size):
            rows.append((len(rows), " ".join(text)))
            for _ in range(pick.choice((0, 1, 1, 2, 3))):
                text[pick.randrange(len(text))] = word()
    return rows


@pytest.mark.parametrize(("width", "percent", "region"), [(3, 90, 256), (5, 80, 256), (1, 70, 4)])
def test_components_are_those_of_brute_force(docs, monkeypatch, width, percent, region):
    monkeypatch.setattr(jaccard, "REGION", region)  # a small bound, to have regions divided
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rows = varied(width)
    got = jaccard.linked_components(docs(*rows), width, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)


def test_odd_rows(docs):
    rows = [*enumerate(ODD), (20, "word"), (21, "WORD "), (21, "WORD "), (22, "the cat sat on the mat\n" * 2999), (None, "word"), (23, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.linked_components(docs(*rows)).collect())
    assert len(got) == len(rows)
    of = {i: c for i, _, c in got if i != "None"}
    assert of["20"] == of["21"] == 3 and of["22"] == 11 and of["0"] == 0 and of["1"] == 1 and of["23"] == 23
    assert [c for i, _, c in got if i == "None"] == [None]
    assert jaccard.linked_components(docs()).count() == 0


def test_rows_of_one_id_are_one_document(docs):
    a, b = "one two three four five", "six seven eight nine ten"
    got = jaccard.linked_components(docs((1, a), (5, a), (5, b), (9, b))).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 103)}
