"""The draw against a plain walk over all n-grams, and its edge rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text, most):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[i:i + n]).encode() for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def plain(rows, targets, percent, least, most, buckets):
    def count(texts):
        return Counter(zlib.crc32(g) % buckets for t in texts for g in plain_grams(t, most)[0])

    s, t = count(r[1] for r in rows), count(targets)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out, eligible = [], []
    for i, text in rows:
        found, words = plain_grams(text, most)
        weight, score = sum(gain[zlib.crc32(g) % buckets] for g in found), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if words >= least:
                eligible.append((-score, i, len(found), weight, len(out)))
        out.append([i, len(found), weight, score, None])
    drawn = percent * len(eligible) // 100
    for rank, (*_, at) in enumerate(sorted(eligible)[:drawn], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAzZ09 -_\n\t\0\x7f@[`{éÉ日İ"), max_size=40), st.integers(1, 4))
def test_grams_are_runs_of_words(text, most):
    want, words = plain_grams(text, most)
    assert list(resampling.grams(text.encode(), resampling.gram_patterns(most))) == want
    assert resampling._words_of(len(want), most) == words


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 70_000)])
def test_equals_a_plain_draw(spark, most, buckets):
    rows = [(i, " ".join(f"w{i * k * 7919 % 53}" for k in range(i % 37))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " -- \n"), (203, "É" * 30_000), (204, "The CAT; the cat_"), (None, "w1 w2 " * 15), (5, "other words " * 20)]
    rows += [(300, "same text of many words " * 6)] * 40
    targets = ["w1 w2 w3 the cat", None, "same text", "É"]
    docs = spark.createDataFrame([(*r, 1, "x", 3.0) for r in rows], "doc_id long, text string, weight int, before string, score double")
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, doc_id int")
    got = resampling.resample(docs, target, 30, 10, most, buckets).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, targets, 30, 10, most, buckets)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert resampling.resample(none, some.select("text")).collect() == []
    got = resampling.resample(some, none.select("text"), 50, 0).collect()
    assert sorted(map(tuple, got), key=repr) == plain([(1, "a b"), (2, "c")], [], 50, 0, 1, 10_000)
