"""Surrogates: format, distinctness, coreference, collisions."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import pii

from .conftest import ODD

KEY = b"key"
REPLACE = pii.replacer(KEY, {})


@pytest.mark.parametrize(("text", "kind"), [
    ("mail me at jo.doe7@mail3.example.com now", "email"), ("from 97.51.17.173 on", "ip"), ("card 4111 1111 1111 1111 ok", "card"),
    ("pay 9807915762804490 now", "card"), ("call +1 (017) 555-7713 today", "phone"), ("id 123-45-6789.", "ssn"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "secret"), ("IBAN DE89 3704 0044 0532 0130 00.", "iban"),
    ("hash 5d41402abc4b2a76b9719d911017c592 end", "key")])
def test_kinds_and_formats(text, kind):
    (start, end, found, _), = pii.find(text)
    new, n = REPLACE(text)
    assert (found, n) == (kind, 1)
    assert new.startswith(text[:start]) and new.endswith(text[end:]) and new != text
    shape = lambda s: ["d" if c.isdigit() else "l" if c.isalpha() else c for c in s]
    if kind not in ("ip", "secret", "key"):
        assert shape(new) == shape(text)
    assert [k for *_, k, _ in pii.find(new)] == [kind]


def test_check_digits_gender_and_script():
    new = "".join(c for c in REPLACE("4111 1111 1111 1111")[0] if c.isdigit())
    assert pii.luhn(new[:-1]) == int(new[-1])
    woman, man = REPLACE("Frau Anna Schmidt")[0].split()[1], REPLACE("Mr Иван Петров")[0].split()[1]
    assert woman in pii.GIVEN["latin", "f"] and man in pii.GIVEN["cyrillic", "m"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9 - 1), st.integers(0, 10**9 - 1))
def test_numbers_stay_distinct(a, b):
    x, y = (pii.surrogate("phone", f"{n:09d}", KEY) for n in (a, b))
    assert (x == y) == (a == b) and len(x) == 9


def test_coreference_and_clean_texts(docs):
    rows = docs("a@b.org and (017) 555-7713", "A@B.org or 017 555 7713", "version 1.2.3 of 2024-01-02, 12345678", *ODD)
    got = {r.doc_id: r for r in pii.pseudonymised(rows).collect()}
    first, second = got[0].text, got[1].text
    assert first.split()[0].lower() == second.split()[0].lower() and "".join(filter(str.isdigit, first)) == "".join(filter(str.isdigit, second))
    assert got[2].text.startswith("version 1.2.3") and [got[3 + i].text for i in range(len(ODD))] == list(ODD)
    assert pii.pseudonymised(rows).columns == [*rows.columns, "n_entities"]
    assert pii.pseudonymised(docs()).count() == 0


def test_collisions_are_drawn_again(docs, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda k, f, key, attempt=0: real(k, f, key, attempt) if attempt else "x@y.org")
    rows = docs("a@b.org", "c@d.org", "x@y.org")
    attempts = pii.attempts_needed(rows, KEY)
    drawn = {pii.surrogate("email", f, KEY, attempts.get(("email", f), 0)) for f in ("a@b.org", "c@d.org", "x@y.org")}
    assert len(drawn) == 3 and not drawn & {"a@b.org", "c@d.org", "x@y.org"}


def test_values_without_letters_or_digits_are_left(docs):
    texts = ["Password: ________ and 1", "password=...... now", "at _@_._"]
    assert [REPLACE(t) for t in texts] == [(t, 0) for t in texts]
    assert [r.text for r in sorted(pii.pseudonymised(docs(*texts)).collect())] == texts


def test_small_spaces_are_left_by_longer_draws(docs, monkeypatch):
    # Every secret with one letter: 26 outcomes that all are entities themselves.
    texts = ["at _@_.com"] + [f"password=-----{chr(97 + i)} x" for i in range(26)] + [f"Mr Name{chr(97 + i)}. x" for i in range(26)]
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("ba",) * 15 + ("do",))
    want = None
    for sent in (50_000, 0):
        monkeypatch.setattr(pii, "SENT_TEXTS", sent)
        got = [r.text for r in sorted(pii.pseudonymised(docs(*texts)).collect())]
        assert len(set(got)) == 53 and not set(got) & set(texts) and got == (want or got)
        want = got
    longer = pii.surrogate("phone", "+1234567", KEY, 7)
    assert len(longer) == 11 and pii.dressed("phone", longer, "+1 23 45 67").replace(" ", "") == longer


def test_columns_of_the_caller_stay(docs):
    texts = [f"password=-----{chr(97 + i)} x" for i in range(26)]
    frame = docs(*texts).selectExpr("*", "doc_id AS _attempts", "'kept' AS _Text_Hash")
    rows = pii.pseudonymised(frame).collect()
    assert {r._Text_Hash for r in rows} == {"kept"} and all(r._attempts == r.doc_id for r in rows)
    assert len({r.text for r in rows}) == 26 and not {r.text for r in rows} & set(texts)


@settings(max_examples=300, deadline=None)
@given(st.text("ab@.+-_ 1,", max_size=40))
def test_addresses_equal_a_plain_search(text):
    plain = re.compile(r"[\w.+%'-]+@[\w-]+(?:\.[\w-]+)+")
    want = [m.span() for m in plain.finditer(text)]
    got = [(s, e) for s, e, kind, _ in pii.find(text) if kind == "email"]
    cut = [(s, s + len(text[s:e].rstrip(".-"))) for s, e in want]
    assert got == [(s, e) for s, e in cut if any(map(str.isalnum, text[s:e]))]


def test_long_texts_take_linear_time():
    started = time.perf_counter()
    assert len(pii.find("z" * 300_000 + "@ " + "jo@ex.org " * 20_000)) == 20_000
    assert time.perf_counter() - started < 5
