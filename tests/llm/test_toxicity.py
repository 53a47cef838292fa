"""The automaton against edit distances, and scores of abuse and quotation."""

from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import toxicity

from .conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


TERMS = ["idiot", "moron", "scum", "worthless", "stupid", "worth"]
AUTOMATON = toxicity.Automaton(TERMS)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["", "x", "i", "oo"])), max_size=3))
def test_automaton(term, edits):
    word = term
    for at, new in edits:
        word = word[:at] + new + word[at + 1:]
    near = [(distance(word, t), i) for i, t in enumerate(TERMS) if distance(word, t) <= toxicity.edits_for(t)]
    best = min(near, default=None)
    assert AUTOMATON.match(word) == (best and (best[1], best[0]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abé", min_size=1, max_size=11), st.integers(0, 3)), max_size=6, unique_by=lambda x: x[0]),
       st.sets(st.text("abé", min_size=2, max_size=4), max_size=2), st.lists(st.text("abéx", max_size=12), max_size=8))
def test_matcher_is_one_automaton_of_all_terms(terms, stems, words):
    given_terms, limits, stems = [t for t, _ in terms], [n for _, n in terms], sorted(stems)
    whole, parts = toxicity.Automaton(given_terms, stems, limits), toxicity.Matcher(given_terms, stems, limits)
    for word in words + given_terms:
        assert parts.match(word) == whole.match(word)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé", min_size=1, max_size=11), st.integers(0, 3)), max_size=6, unique_by=lambda x: x[0]),
       st.lists(st.text("abéx", max_size=12), max_size=12))
def test_many_words_at_once(terms, words):
    given_terms, limits = [t for t, _ in terms], [n for _, n in terms]
    whole = toxicity.Automaton(given_terms, (), limits)
    assert toxicity.Matcher(given_terms, (), limits).matches(words) == [whole.match(w) for w in words]


def test_words_of_a_block_are_matched_at_once(monkeypatch):
    texts = [f"you w{'abcdefgh'[i % 8]}rthless {'idi0t' * (i % 3)}, scum{i}" for i in range(60)] + [None, ""]
    asked, matches = [], toxicity.Matcher.matches
    monkeypatch.setattr(toxicity.Matcher, "matches", lambda self, words: asked.append(words) or matches(self, words))
    at_once = [*toxicity.features_of(texts, toxicity.Lexicon(TERMS), [None] * len(texts))]
    # The words as they are, then those with other signs than letters.
    assert len(asked) == 2 and not set(asked[0]) ^ {w.strip(",") for t in texts if t for w in t.split()}
    monkeypatch.setattr(toxicity, "BLOCK", 1)
    monkeypatch.setattr(toxicity, "MEMORY", 0)
    monkeypatch.setattr(toxicity, "FORMS", 1)
    one = toxicity.Lexicon(TERMS)
    assert at_once == [toxicity.features(t, one) for t in texts] == [*toxicity.features_of(texts, one, [None] * len(texts))]


def test_words_far_from_all_terms_make_no_states():
    terms = [a + b + "ortless" for a in "abcdefgh" for b in "ijklmnop"]
    matcher = toxicity.Lexicon(terms).automaton
    for a in "qrstuvwxyz":
        for b in "qrstuvwxyz":
            assert matcher.match(a + b + "umbrella") is None
    # One automaton of all terms makes some thousands here.
    assert matcher.entries + matcher.plain.entries < 1000 and matcher.match("ajortles") == (terms.index("ajortless"), 1)


def test_scores(spark, docs):
    model = toxicity.train(docs().selectExpr("*", "0 AS toxic"))
    texts = ["you are a stupid idiot", "you 1d10t and m0ron, pathetic scum", "wortless stupidd morons everywhere, scum", "a fine day",
             'the word "idiot" is an insult']
    got = {r.doc_id: r for r in toxicity.score(docs(*texts, *ODD), model).collect()}
    assert [got[i].predicted for i in range(5)] == [1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[5 + i].predicted == 0 for i in range(len(ODD)))
    assert toxicity.score(docs(), model).count() == 0


def test_learning(spark, docs):
    bad = [f"text {i} with blorpface in it" for i in range(60)]
    good = [f"text {i} with nothing bad in it and bloopface" for i in range(120)]
    table = docs(*bad, *good).selectExpr("*", "CAST(doc_id < 60 AS INT) AS toxic")
    model = toxicity.train(table)
    assert "blorpface" in model.terms and "bloopface" in model.ordinary
    got = {r.doc_id: r.predicted for r in toxicity.score(docs("a blorpface", "a bloopface"), model).collect()}
    assert got == {0: 1, 1: 0}


STEMMED = toxicity.Automaton(["idiot", "scummy"], ["scum", "idio", "blorp"])


def test_stems_match_words_that_begin_with_them():
    matches = {w: STEMMED.match(w) for w in ("scum", "scums", "scummy", "scumny", "idiot", "idiotic", "idjot", "blorpxyz", "blor", "blirpx", "scu")}
    assert matches == {"scum": (2, 0), "scums": (2, 0), "scummy": (1, 0), "scumny": (2, 0), "idiot": (0, 0), "idiotic": (3, 0), "idjot": (0, 1),
                       "blorpxyz": (4, 0), "blor": None, "blirpx": None, "scu": None}
    assert STEMMED.match("blorp" + "x" * 1_000_000) == (4, 0) and STEMMED.match("y" * 1_000_000) is None


def test_forgotten_states_change_nothing(monkeypatch):
    words = [a + b for a in ("idi", "mor", "wor", "scu", "stu", "x") for b in ("ot", "on", "m", "pid", "thless", "thles", "")]
    want = [toxicity.Automaton(TERMS).match(w) for w in words]
    monkeypatch.setattr(toxicity, "ENTRIES", 0)
    small = toxicity.Automaton(TERMS)
    assert [small.match(w) for w in words] == want


def test_stems_are_learned_from_few_labels(spark, docs):
    """One toxic document in a hundred, each with other endings of one stem, in no known language."""
    endings = ["a", "es", "isch", "ona", "uk", "ere", "iff", "olt", "arg", "ip", "onk", "ett"]
    bad = [f"das hier ist gnarv{e} und text {i}" for i, e in enumerate(endings)]
    good = [f"das hier ist {'gnar' * (i % 2)}gut und text {i}" for i in range(1200)]
    table = docs(*bad, *good).selectExpr("*", "CAST(doc_id < 12 AS INT) AS toxic")
    model = toxicity.train(table, seeds=())
    assert model.stems == ["gnarv"] and not model.terms
    got = {r.doc_id: r.predicted for r in toxicity.score(docs("noch ein gnarvolo", "ein gnarr", "ein gnar"), model).collect()}
    assert got == {0: 1, 1: 0, 2: 0}


def test_unlisted_ordinary_words_lower_the_edits(docs):
    bad = [f"a blorpface {i}" for i in range(60)]
    good = [f"a bloopface and glorpface {i}" for i in range(120)]
    table = docs(*bad, *good).selectExpr("*", "CAST(doc_id < 60 AS INT) AS toxic")
    model = toxicity.train(table, most_ordinary=0, seeds=())
    assert model.terms == ["blorpface"] and model.limits == [0] and not model.ordinary
    assert toxicity.train(table, seeds=()).limits == [2]


def test_labels_and_ids_may_be_null(spark):
    rows = [(None, "bad word", 1), (1, "bad word", None), (2, None, 1), (3, "fine", 0), (3, "fine", 0)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), seeds=())
    assert not model.terms and model.counts[:2] == (1, 2)


GIVEN = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not GIVEN.exists(), reason="no test tables")
def test_held_out_labels(spark):
    from faultline.llm import catalog

    labels = spark.read.parquet(f"{GIVEN}/labels.parquet")
    rows = catalog.op7_toxicity(spark, str(GIVEN)).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
