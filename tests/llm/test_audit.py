"""The filter audit against a plain walk through every order, and its edge rows."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from faultline.llm import audit

DOCS = "doc_id long, text string, source string, mask int, part string, good long, step int"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{i}" for i in range(250))


def plain(rows, labels):
    """The contract, document by document."""
    marks = {}
    for i, q, t, *_ in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    firsts = {}
    for i, text, *_ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    out = Counter()
    for i, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, hit in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            re.search(r"[#$%&*|]", text), i is not None and firsts[text] < i), strict=True) if hit}
        good, toxic = marks.get(i, (False, False)) if i is not None else (False, False)
        for order in map("".join, permutations("ABCDE")):
            alive = True
            for step, x in enumerate(order, 1):
                at = (source or "", order, step)
                hit = x in fails
                out[at, "removed"] += hit and alive
                out[at, "redundant"] += hit and not alive
                out[at, "unique_fails"] += fails == {x}
                out[at, "good_lost"] += hit and alive and good
                out[at, "toxic_lost"] += hit and alive and toxic
                out[(source or "", x), "shapley"] += hit and alive
                alive = alive and not hit
                out[at, "kept"] += alive
    return out


def rows_of(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "p", 9, 3) for r in rows], DOCS)
    return audit.audit(docs, spark.createDataFrame([(*x, "q") for x in labels], LABELS)).collect()


def test_equals_a_walk_through_every_order(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\x0b\n", None), (4, LONG, "a"), (5, LONG, "b"), (5, LONG, "b"), (6, LONG + " #", "b"),
            (7, "same " * 300, "a"), (7, "other", "a"), (8, LONG.upper(), "b"), (9, LONG.upper(), "a"), (None, LONG, "a"), (None, None, None),
            (10, "É " * 400 + "| X", ""), (11, "a\x1cb " * 200, "c"), (12, "x" * 50_000, "c"), (-1, "same " * 300, "c")]
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, 1), (8, None, 1), (9, 1, None), (None, 1, 1), (12, 1, 1), (99, 1, 1)]
    want = plain(rows, labels)
    got = rows_of(spark, rows, labels)
    assert len(got) == 4 * 600
    for r in got:
        at = (r["part"], r["filter_order"], r["step"])
        assert {m: r[m] for m in audit.METRICS} == {m: want[at, m] for m in audit.METRICS}, at
        assert r["shapley"] == want[(r["part"], r["filter_order"][r["step"] - 1]), "shapley"]


def test_empty_tables(spark):
    assert rows_of(spark, [], [(1, 1, 1)]) == []
    got = rows_of(spark, [(1, LONG, "a")], [])
    assert len(got) == 600 and all(r["kept"] == 1 and r["removed"] == r["shapley"] == 0 for r in got)


def test_fewer_filters_and_shapley_adds_up(spark):
    """Shapley sums over all filters give what any whole order removes, times the orders."""
    cells = spark.createDataFrame([("p", m, 10 + m, m, 0) for m in range(8)], "part string, mask int, docs long, good long, toxic long")
    got = audit.interactions(cells, 3).collect()
    assert len(got) == 6 * 3 and {r["filter_order"] for r in got} == set(map("".join, permutations("ABC")))
    shapley = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}
    assert sum(shapley.values()) == 6 * sum(10 + m for m in range(1, 8))
