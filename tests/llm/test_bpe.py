"""Encoding by transducer and merges against the library, and the transducer against a plain table."""

from __future__ import annotations

import functools
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import bpe
from faultline.llm.common import default_tokenizer
from faultline.llm.encoding import SIGNS as SHOWN
from faultline.llm.lexicon import Transducer, compile_words
from tests.llm.conftest import ODD

PATH = default_tokenizer("byte_bpe_50k.json")
SIGNS = ["a", "B", "é", "ß", "×", "÷", "1", "²", " ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "'", "'s", "'ll", "'S", ".",
         ",", "!", "<", "|", "<|endoftext|>", "<|endoftext|", "’", "é", "日", "🙂", "word", " the", "don't", "\0", "ſ", "ⅷ", "　", "«", "_"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoders(tmp_path_factory):
    """Without a lexicon, and with one of a few pieces."""
    words = sorted({w.encode() for s in SIGNS for w in (s, " " + s, s + "a") if s and "endoftext" not in s})
    words = [w for w in words if len(set(bpe.Pieces([bpe.Part(0, w, -1)]).start)) == 1]
    vocabulary = bpe.Vocabulary(PATH)
    file = tmp_path_factory.mktemp("lexicon") / "file"
    file.write_bytes(compile_words(words, [vocabulary.encode(w) for w in words]))
    return bpe.Encoder(PATH), bpe.Encoder(PATH, str(file))


def plain(library, texts):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def coded(encoder, texts):
    ids, counts = encoder.batch([t.encode() for t in texts])
    return [r.tolist() for r in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join), min_size=1, max_size=5))
def test_ids_are_those_of_the_library(library, encoders, texts):
    want = plain(library, texts)
    for encoder in encoders:
        assert coded(encoder, texts) == want
        assert [encoder.vocabulary.decode(ids).decode() for ids in want] == texts == [library.decode(ids, skip_special_tokens=False) for ids in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, encoders, text):
    assert coded(encoders[0], [text]) == plain(library, [text])


def test_long_texts_are_cut_where_nothing_merges(library, encoders, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(400)) for _ in range(20)] + ["x" * 500, "", "a b " * 100 + "<|endoftext|>" + " \n " * 40]
    for encoder in encoders:
        assert coded(encoder, texts) == plain(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(min_size=1, max_size=7), max_size=20))
def test_transducer_is_a_table(tmp_path_factory, words, others):
    words, file = sorted(words), tmp_path_factory.mktemp("t") / "file"
    file.write_bytes(compile_words(words, [list(w) for w in words]))
    of = Transducer(str(file))
    asked = words + others
    signs = np.frombuffer(b"".join(asked), np.uint8)
    length = np.fromiter(map(len, asked), np.int64, len(asked))
    got = of.places(signs, np.cumsum(length) - length, length)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked]
    assert [of.ids[a:b].tolist() for a, b in zip(of.id_start, of.id_start[1:])] == [list(w) for w in words]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aehinorstlé "), min_size=1, max_size=14), min_size=1, max_size=30))
def test_merging_in_rounds_is_merging_one_by_one(words):
    vocabulary = encoders_vocabulary()
    coded = [w.encode() for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    ids, sizes = vocabulary.ranks.merge(vocabulary.first[np.frombuffer(b"".join(coded), np.uint8)], size)
    want = [vocabulary.merged("".join(chr(SHOWN.get(b, b)) for b in w)) for w in coded]
    assert [r.tolist() for r in np.split(ids, np.cumsum(sizes)[:-1])] == want


@functools.cache
def encoders_vocabulary():
    return bpe.Vocabulary(PATH)


def test_frequent_pieces(spark):
    counts = spark.createDataFrame([(bytes([65 + i]), 2 ** i) for i in range(20)], "piece binary, n long")
    assert bpe.frequent_pieces(counts, 5) == [bytes([65 + i]) for i in range(15, 20)]
    assert bpe.frequent_pieces(counts, 0) == [] and len(bpe.frequent_pieces(counts, 99)) == 20


def test_equal_suffixes_are_one(tmp_path):
    stems = [f"{a}{b}".encode() for a in "abcdefgh" for b in "abcdefgh"]
    words = sorted(s + e for s in stems for e in (b"ing", b"ed", b"s", b""))
    (tmp_path / "f").write_bytes(compile_words(words, [[1]] * len(words)))
    of = Transducer(str(tmp_path / "f"))
    # One first state, one for all first letters, one for all stems, and those of the endings.
    assert len(np.unique(of.target[of.owner >= 0])) + 1 <= 8


def test_tables(spark, docs, library):
    table = docs(*ODD, (3, "word"), (None, "the cat"), lang=None)
    lexicon = bpe.write_lexicon(table, words=50)
    want = {(i, t): library.encode(t or "", add_special_tokens=False).ids for i, t in [(r.doc_id, r.text) for r in table.collect()]}
    got = bpe.encode(table, lexicon).collect()
    assert len(got) == table.count() and all(r.ids in [ids for (i, _), ids in want.items() if i == r.doc_id] for r in got)
    texts = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(table, lexicon)).collect()}
    assert texts == {(i, t or "") for i, t in want}
    for r in bpe.digests(table, lexicon).collect():
        candidates = [(ids, t) for (i, t), ids in want.items() if i == r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in {
            (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for ids, t in candidates}
    counts = {bytes(r.piece): r.n for r in bpe.piece_counts(table).collect()}
    assert counts[b" cat"] == 3001 and counts[b"word"] == 2 and counts[b"\n"] >= 3000


def test_empty_table(docs):
    none = docs().limit(0)
    lexicon = bpe.write_lexicon(none)
    assert bpe.encode(none, lexicon).collect() == bpe.digests(none, lexicon).collect() == []
    some = docs("a b", None)
    assert sorted(map(tuple, bpe.encode(some, lexicon).collect())) == [(0, [64, 275]), (1, [])]


def test_block_of_words_unsure_pieces_and_special_strings(library, encoders):
    # Merged in rounds, merged one by one and looked up, in one block.
    texts = ["plainwords 日本don't<|endoftext|> word", "", "é ﬀ don't  x", "<|endoftext|>"]
    for encoder in encoders:
        assert coded(encoder, texts) == plain(library, texts)
