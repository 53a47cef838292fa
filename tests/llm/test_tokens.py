"""Token counts, files, packing and pieces against the libraries themselves."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import encoding, packing, pieces, token_counts, token_files
from faultline.llm.common import default_tokenizer

from .conftest import ODD

BYTE, WORD, PIECE = map(default_tokenizer, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path, text):
    return encoding.load(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize(("kind", "path"), [(encoding.ByteLevel, BYTE), (encoding.WordLevel, WORD)])
def test_stretches_give_the_ids_of_the_library(kind, path):
    encode, whole = kind(path), encoding.load(path)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("ab'sÉé ß.,\n\t  \x1c1²ΣΟσ́<|>endoftx"), max_size=40))
    def check(text):
        assert list(struct.unpack(f"<{len(encode(text)) // 4}I", encode(text))) == whole.encode(text, add_special_tokens=False).ids

    check()
    for text in ODD:
        assert encode(text or "") == np.asarray(library(path, text), "<u4").tobytes()


class Asked:
    """A model that notes what it is asked."""

    def __init__(self, model):
        self.model, self.words = model, []

    def tokenize(self, word):
        self.words.append(word)
        return self.model.tokenize(word)


@pytest.mark.parametrize(("kind", "path"), [(encoding.ByteLevel, BYTE), (encoding.WordLevel, WORD)])
def test_signs_behind_words_are_asked_once(kind, path):
    encode, text = kind(path), "the, of, größe, años, of?! the?! és,"
    parts = [p for p in vars(encode).values() if isinstance(p, encoding.Stretches)]
    for part in parts:
        part.model = Asked(part.model)
    assert encode(text) == np.asarray(library(path, text), "<u4").tobytes()
    for part in parts:
        assert part.model.words and len(part.model.words) == len(set(part.model.words))


def test_token_counts(docs):
    rows = token_counts.token_counts(docs(*ODD, (3, "word")), chunk=1000, overlap=16).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == sorted(
        (i, len((t or "").encode()), len(library(WORD, t))) for i, t in [*enumerate(ODD), (3, "word")])
    assert token_counts.token_counts(docs()).count() == 0


def test_token_files(spark, docs, tmp_path):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id")]
    token_files.write_tokens(docs(*rows), str(tmp_path / "ids"))
    tokens = token_files.read_tokens(spark, str(tmp_path / "ids"))
    stored = {(r.doc_id, tuple(r.ids)): r.start for r in tokens.collect()}
    assert {k: None for k in stored} == {(i, (*library(WORD, t), 1)): None for i, t in rows}
    at = 0
    for (doc_id, ids), start in sorted(stored.items(), key=lambda x: x[1]):
        assert start == at
        at += len(ids)
    assert [i for (i, _), _ in sorted(stored.items(), key=lambda x: x[1])] == sorted(
        (i for i, _ in rows), key=lambda i: (i is not None, i))
    assert {(r.doc_id, r.ids_crc32) for r in token_files.checksums(tokens).collect()} == {(i, crc(ids)) for i, ids in stored}
    assert token_files.read_tokens(spark, str(tmp_path / "ids"), (4, 6)).count() == 3
    token_files.write_tokens(docs(), str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_packing(docs):
    rows = [*enumerate(ODD), (3, "word")]
    cut = packing.pieces(docs(*rows), size=64)
    packed = packing.pack(cut, len(rows), size=64)
    got = packed.collect()
    for doc_id, text in rows:
        ids = [*library(BYTE, text), 0]
        own = sorted((r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in got if r.doc_id == doc_id)
        own = own[::2] if doc_id == 3 else own
        assert b"".join(o[3] for o in own) == np.asarray(ids, "<u4").tobytes()
        assert [o[0] for o in own] == list(range(0, len(ids), 64)) and all(o[2] == len(ids) for o in own)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(places) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack(packing.pieces(docs()), 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    sequence, offset = packing.first_fit_decreasing(np.array(lengths, np.int64), 50)
    room = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(50)
        assert (sequence[i], offset[i]) == (at, 50 - room[at])
        room[at] -= lengths[i]


def test_pieces_without_dropout_are_those_of_the_library():
    import sentencepiece

    model, encode = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.Encoder(PIECE, 0.0, 1, 1)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("the cat\n  éß日.,1🙂\t\x00"), max_size=40))
    def check(text):
        assert list(struct.unpack(f"<{len(encode(text, 1)) // 4}I", encode(text, 1))) == model.encode(text)

    check()


def test_pieces_decode_without_loss_and_vary(docs):
    table = docs(*ODD, (3, "word"))
    texts = {i: t or "" for i, t in enumerate(ODD)}
    for dropout in (0.0, 0.3, 1.0):
        coded = pieces.encode(table, dropout=dropout, seed=4)
        assert {(r.doc_id, r.text) for r in pieces.decode(coded).collect()} == set(texts.items())
    rows = pieces.checked(table, dropout=0.3).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(ODD) + 1
    text = "segmentation of uncommon vocabulary " * 5
    ways = {pieces.Encoder(PIECE, 0.5, seed, 1)(text, 1) for seed in range(6)}
    assert len(ways) > 1 and pieces.Encoder(PIECE, 0.5, 3, 1)(text, 1) == pieces.Encoder(PIECE, 0.5, 3, 1)(text, 1)
    assert pieces.checked(docs()).count() == 0


def test_a_word_takes_many_segmentations(docs):
    encode, plain = pieces.Encoder(PIECE, 0.3, 1), pieces.Encoder(PIECE, 0.0, 1)
    ways = {encode("segmentation", i) for i in range(300)}
    assert len(ways) > 10 and {encode.model.decode(struct.unpack(f"<{len(w) // 4}I", w)) for w in ways} == {"segmentation"}
    # Also within one document; and runs are as long as independent lots make them.
    by_line = encode("\n".join(["segmentation"] * 200), 7).split(encode.line_end)
    assert len({bytes(w) for w in by_line[1:]}) > 10
    taken, _ = plain.model.encode(" segmentation")
    share = sum(encode.lots.first(encode.lots.key(str(i)), 1)[0] >= taken for i in range(4000)) / 4000
    assert taken > 3 and abs(share - 0.7 ** taken) < 0.02
    table = docs(*[(i, "segmentation") for i in range(100)])
    assert len({tuple(r.ids) for r in pieces.encode(table, dropout=0.3).collect()}) > 10


def test_long_runs_and_long_stretches(monkeypatch):
    whole = pieces.Encoder(PIECE, 0.3, 1)("segmentation " * 20 + "segmentation" * 9, 5)
    monkeypatch.setattr(pieces, "LONGEST", 0)
    assert pieces.Encoder(PIECE, 0.3, 1)("segmentation " * 20 + "segmentation" * 9, 5) == whole
    text = "uncommon vocabulary " * 400
    taken = [len(pieces.Encoder(PIECE, rate, 1)(text, 5)) for rate in (0.0, 1e-6, 0.1, 1.0)]
    assert taken[0] == taken[1] < taken[2] < taken[3]
    monkeypatch.setattr(pieces, "RUN", 2)
    lots = pieces.Lots(0.1, 1)
    runs = [next(lots.later(9, place, first)) for place, first in enumerate(lots.first(9, 4000))]
    assert abs(sum(runs) / 4000 - 9) < 0.6


def stretches_of(text: str) -> list[str]:
    """Words with the spaces before them, and line ends, in order; a space is put before the text."""
    if not text:
        return []
    out, lead = [], " "
    for line in text.split("\n"):
        if "  " in line or line[:1] == " " or line[-1:] == " ":
            out += re.findall(" +[^ ]*|[^ ]+", lead + line)
        elif line or lead:
            head, *rest = line.split(" ")
            out.append(lead + head)
            out += [" " + word for word in rest]
        out.append("\n")
        lead = ""
    out.pop()
    return out


@pytest.mark.parametrize(("dropout", "block"), [(0.1, 1 << 20), (0.5, 7), (0.9, 40)])
def test_rounds_take_the_choices_of_a_plain_agenda(monkeypatch, dropout, block):
    monkeypatch.setattr(pieces, "BLOCK", block)
    encoder = pieces.Encoder(PIECE, dropout, 11)
    signs = st.sampled_from(["the", "cat", " ", " ", "  ", "\n", "segment", "ation", "é", "ß", "日", "🙂", "▁", "\0", "a", "tion", "1", "word" * 20])

    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.lists(signs, max_size=25).map("".join), min_size=1, max_size=6))
    def check(texts):
        got = encoder.batch(texts, list(range(len(texts))))
        for doc_id, (text, coded) in enumerate(zip(texts, got, strict=True)):
            key, place, want = encoder.key(doc_id), 0, b""
            for part in stretches_of(text):
                if part == "\n":
                    want += encoder.line_end[4:]
                else:
                    runs = encoder.lots.later(key, place, int(encoder.lots.first(key, place + 1)[place]))
                    want += encoder.model.encode(part, runs)[1]
                    place += 1
            assert coded == want

    check()


def test_distinct_stretches():
    text = "the cat and the dog and a cat"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    start = np.array([0, *(i for i, c in enumerate(text) if c == " ")])
    of, first = pieces._distinct(text, points, start, np.diff(np.append(start, len(text))))
    words = [text[a:b] for a, b in zip(start, [*start[1:], len(text)])]
    assert [words[i] for i in first[of]] == words and len(first) == len(set(words))


def test_pieces_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 20_000)
    encoder, plain = pieces.Encoder(PIECE, 0.2, 1), pieces.Encoder(PIECE, 0.2, 1)
    texts = [" ".join(f"w{i * k}" for k in range(200)) for i in range(20)]
    got = [encoder(t, i) for i, t in enumerate(texts)]
    assert len(encoder.known) < 400 and got == plain.batch(texts, list(range(20)))


def test_full_pieces_take_sequences_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "FULL_BLOCK", 16)
    rows = spark.range(500, numPartitions=3).selectExpr(
        "id DIV 10 AS doc_id", "id % 10 * 64 AS start", "CAST(if(id % 10 < 9, 64, 1 + id DIV 10) AS long) AS length", "'x' AS _group")
    packed = packing.pack(rows, 50, size=64)
    got = packed.collect()
    assert packed.columns == ["doc_id", "start", "length", "_group", "sequence_id", "offset"] and {r._group for r in got} == {"x"}
    full = [r.sequence_id for r in got if r.length == 64]
    rest = {r.sequence_id for r in got if r.length < 64}
    assert len(got) == 500 and len(set(full)) == len(full) == 450 and not rest & set(full) and min(full) >= packing.FULL_IDS
    filled = {}
    for r in sorted((r for r in got if r.length < 64), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64 and len(rest) <= 25


def test_the_model_is_taken_from_the_tokenizer_once():
    from faultline.llm.common import default_tokenizer
    from faultline.llm.encoding import Stretches, load

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, 0

        @property
        def model(self):
            self.asked += 1
            return self.tokenizer.model

    tokenizer = Counted(load(default_tokenizer("word_bpe_49k.json")))
    stretch = Stretches(tokenizer, lower=True)
    assert all(len(stretch[w]) for w in ("plain", "words", "behind.", "others")) and tokenizer.asked == 1
