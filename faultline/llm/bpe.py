"""Byte-pair encoding and decoding with a transducer of frequent words.

A text falls into pieces at places where no merge can cross, found for a whole batch at once: between
visible signs and white space, and between letters, digits and signs.  The most frequent pieces of the corpus
are compiled, with their ids, into a minimal acyclic transducer whose file every worker maps into memory.
Pieces that it does not hold are merged exactly, by rank: words in rounds over a whole block, pieces of
several words or unsure signs one by one after the vocabulary's own split.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, cut, default_tokenizer, held, least_bin, reachable, shared_folder
from faultline.llm.encoding import SIGNS, load
from faultline.llm.lexicon import Transducer, compile_words

#: Bytes of text that are worked on at once.
BLOCK = 1 << 20
_LONE_SPACE = re.compile(rb"[A-Za-z0-9] (?=[A-Za-z0-9])")
#: Longest piece, in bytes, that is counted and compiled; longer ones are merged each time.
LONGEST = 32
#: Bytes of pieces and ids that a worker remembers beside the transducer.
MEMORY = 32 << 20
#: Distinct pieces that a task counts before it sends them on.
COUNTED = 200_000

# Kinds of bytes; pieces end between some of them.
_OTHER, _SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE = range(6)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127] = _SIGN
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[ord("0"):ord("9") + 1] = _DIGIT
    kinds[ord("A"):ord("Z") + 1] = kinds[ord("a"):ord("z") + 1] = _LETTER
    kinds[ord("'")] = _QUOTE
    return kinds


_KIND = _kinds()


def kinds_of(signs: np.ndarray) -> np.ndarray:
    """The kind of each byte; letters of Latin-1 are c3 and a byte other than those of the two signs of arithmetic."""
    kind = _KIND[signs]
    lead = np.flatnonzero(signs[:-1] == 0xC3)
    lead = lead[(signs[lead + 1] != 0x97) & (signs[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def cut_places(signs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte.  Only sure ends of words count, so a piece may hold several words.

    White space begins a piece behind anything visible; the last of several white spaces begins one before
    anything visible; so does what is visible behind white space other than a space.  Letters, digits and
    signs end each other, but for an apostrophe before a letter, which may be a short form.  Bytes of
    signs beyond ASCII, other than the letters of Latin-1, are unsure and end nothing.
    """
    before, here = kind[:-1], kind[1:]
    visible, space = kind >= _LETTER, kind == _SPACE
    begins = np.zeros(len(signs), bool)
    begins[1:] = ((before != here) & (before >= _LETTER) & (here >= _SPACE) & ~((before == _QUOTE) & (here == _LETTER))
                  & ~((before >= _SIGN) & (here >= _SIGN)))
    begins[1:] |= space[:-1] & visible[1:] & (signs[:-1] != 32)
    begins[1:-1] |= space[:-2] & space[1:-1] & visible[2:]
    return begins


class Ranks:
    """Ranks of pairs of ids, and what they make, for whole arrays: a table with open places."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        keys = np.asarray([a << 32 | b for a, b in merges], np.int64)
        self.made = np.asarray([made for _, made in merges.values()], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            # One key per open place; the others go on to the next.
            taken, first = np.unique(at, return_index=True)
            settled = np.zeros(len(left), bool)
            settled[first[self.keys[taken] < 0]] = True
            self.keys[at[settled]], self.rank[at[settled]] = keys[left[settled]], left[settled]
            left, at = left[~settled], (at[~settled] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where nothing merges it."""
        keys = first << 32 | second
        at = self._place(keys)
        found = self.keys[at]
        rank = np.where(found == keys, self.rank[at], self.NONE)
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[on]]
            rank[on] = np.where(found == keys[on], self.rank[at[on]], self.NONE)
            on = on[(found != keys[on]) & (found >= 0)]
        return rank

    def merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words, ``size`` ids each: in every round the best and then leftmost pair of each word."""
        size, word = size.copy(), np.repeat(np.arange(len(size)), size)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank = np.full(len(ids), self.NONE, np.int32)
        rank[inner] = self(ids[inner], ids[inner + 1])
        while len(ids):
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            at = np.flatnonzero((rank == best[word]) & (rank < self.NONE))
            if not len(at):
                break
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            ids[at] = self.made[rank[at]]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            size[word[at]] -= 1
            ids, word, rank = ids[kept], word[kept], rank[kept]
            at = at - np.arange(len(at))
            rank[at] = self.NONE
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                rank[left] = self(ids[left], ids[left + 1])
        return ids, size


class Vocabulary:
    """Words, ranks and special strings of a vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        if told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or told["model"]["ignore_merges"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.ids: dict[str, int] = told["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.ranks = Ranks(self.merges)
        self.first = np.asarray([self.ids[chr(SIGNS.get(b, b))] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: special strings that take in what stands around them")
        self.split = load(path).pre_tokenizer.pre_tokenize_str
        byte_of = {chr(SIGNS.get(b, b)): b for b in range(256)}
        self.raw = [b""] * (1 + max(*self.ids.values(), *self.special.values()))
        for word, i in self.ids.items():
            self.raw[i] = bytes(byte_of[c] for c in word)
        for word, i in self.special.items():
            self.raw[i] = word.encode()
        self.decimals = [b"%d" % i for i in range(len(self.raw))]
        self.spelled = {s.encode(): i for s, i in self.special.items()}
        self.specials = re.compile(b"(%s)" % b"|".join(map(re.escape, sorted(self.spelled, key=len, reverse=True))))

    def apart(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        """Stretches without special strings, and the id of the special string behind each (-1 at the end)."""
        split = self.specials.split(text) if any(s in text for s in self.spelled) else [text]
        for at in range(0, len(split), 2):
            yield split[at], self.spelled[split[at + 1]] if at + 1 < len(split) else -1

    def merged(self, word: str) -> list[int]:
        """Ids of one word, spelled in the signs that stand for its bytes: always the best rank first, then leftmost."""
        ids = [self.ids[c] for c in word]
        if len(ids) < 2:
            return ids
        merges = self.merges.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        agenda = [(*m, at, a, b) for at, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges((a, b)))]
        heapq.heapify(agenda)
        while agenda:
            _, made, at, a, b = heapq.heappop(agenda)
            other = after[at]
            # A merge of symbols that have changed since is out of date.
            if ids[at] != a or other >= len(ids) or ids[other] != b:
                continue
            ids[at], ids[other] = made, -1
            after[at] = following = after[other]
            if following < len(ids):
                before[following] = at
                if m := merges((made, ids[following])):
                    heapq.heappush(agenda, (*m, at, made, ids[following]))
            if before[at] >= 0 and (m := merges((ids[before[at]], made))):
                heapq.heappush(agenda, (*m, before[at], ids[before[at]], made))
        return [i for i in ids if i >= 0]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece without special strings, split into words as the vocabulary does."""
        return [i for word, _ in self.split(piece.decode()) for i in self.merged(word)]

    def decode(self, ids) -> bytes:
        """The bytes of ids, special ones in their spelling."""
        return b"".join(map(self.raw.__getitem__, ids))


class Part(NamedTuple):
    """A stretch of a text between special strings, or between two sure ends of words in a long one."""

    number: int
    signs: bytes
    #: The special id behind it, or -1.
    special: int


def parts_of(texts: list[bytes], vocabulary: Vocabulary) -> Iterator[Part]:
    """Every text in parts of about BLOCK bytes at most; a word longer than that stays whole."""
    for number, text in enumerate(texts):
        for part, special in vocabulary.apart(text):
            at = 0
            while len(part) - at > BLOCK and (end := _end_of_block(part, at + BLOCK)):
                yield Part(number, part[at:end], -1)
                at = end
            yield Part(number, part[at:], special)


def _end_of_block(text: bytes, start: int) -> int:
    """The first place from ``start`` on, with visible signs on both sides, where a lone space begins a piece; 0 if none does."""
    found = _LONE_SPACE.search(text, start)
    return found.start() + 1 if found else 0


def blocks_of(parts: Iterator[Part]) -> Iterator[list[Part]]:
    """Parts in lists of about BLOCK bytes."""
    block, size = [], 0
    for part in parts:
        if block and size + len(part.signs) > BLOCK:
            yield block
            block, size = [], 0
        block.append(part)
        size += len(part.signs)
    if block:
        yield block


class Pieces:
    """A block of parts as one array of bytes, and where its pieces lie."""

    def __init__(self, parts: list[Part]):
        self.signs = np.frombuffer(b"".join(p.signs for p in parts), np.uint8)
        ends = np.cumsum(np.fromiter((len(p.signs) for p in parts), np.int64, len(parts)))
        self.kind = kinds_of(self.signs)
        begins = cut_places(self.signs, self.kind) if len(self.signs) else np.zeros(0, bool)
        # White space at the end of a part is one word, whatever the next part begins with.
        inner = ends[(ends > 1) & (ends < len(begins))]
        begins[inner[(_KIND[self.signs[inner - 1]] == _SPACE) & (_KIND[self.signs[inner - 2]] == _SPACE)] - 1] = False
        begins[ends[ends < len(begins)]] = True
        begins[:1] = True
        self.start = np.flatnonzero(begins)
        self.length = np.diff(np.append(self.start, len(self.signs)))
        self.part = np.searchsorted(ends, self.start, side="right")

    def single(self) -> np.ndarray:
        """Whether each piece is surely one word: letters, digits, signs or white space only, behind a space or not."""
        if not len(self.start):
            return np.zeros(0, bool)
        kind = np.where(self.kind == _QUOTE, _SIGN, self.kind)
        spaced = self.start[(self.signs[self.start] == 32) & (self.length > 1)]
        kind[spaced] = kind[spaced + 1]
        least = np.minimum.reduceat(kind, self.start)
        return (least == np.maximum.reduceat(kind, self.start)) & (least != _OTHER)


class Encoder:
    """Ids of whole texts by the transducer of a file, and by merging for pieces that it does not hold."""

    def __init__(self, path: str, lexicon: str | None = None):
        self.vocabulary = Vocabulary(path)
        self.lexicon = Transducer(lexicon) if lexicon else None
        self.memory: dict[bytes, list[int]] = {}
        self.size = 0

    def _unseen(self, piece: bytes) -> list[int]:
        ids = self.memory.get(piece)
        if ids is None:
            ids = self.vocabulary.encode(piece)
            if len(piece) <= 8 * LONGEST:
                # The sizes of the objects, roughly.
                self.size += 250 + len(piece) + 8 * len(ids)
                if self.size > MEMORY:
                    self.memory.clear()
                    self.size = 250 + len(piece) + 8 * len(ids)
                self.memory[piece] = ids
        return ids

    def blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block by block: the ids of its parts behind each other, the text of each part and its ids."""
        for parts in blocks_of(parts_of(texts, self.vocabulary)):
            yield self._block(parts)

    def _block(self, parts: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = Pieces(parts)
        place = np.full(len(pieces.start), -1, np.int64)
        if self.lexicon:
            place = self.lexicon.places(pieces.signs, pieces.start, pieces.length)
        seen, alone = np.flatnonzero(place >= 0), pieces.single() & (pieces.length <= 2 * LONGEST)
        words, unseen = np.flatnonzero((place < 0) & alone), np.flatnonzero((place < 0) & ~alone)
        signs = pieces.signs.tobytes()
        bounds = zip(pieces.start[unseen].tolist(), (pieces.start + pieces.length)[unseen].tolist(), strict=True)
        merged = [self._unseen(signs[a:b]) for a, b in bounds]
        size = np.zeros(len(place), np.int64)
        size[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
        of_words, size[words] = self.vocabulary.ranks.merge(
            self.vocabulary.first[pieces.signs[spans(pieces.start[words], pieces.length[words])]], pieces.length[words])
        if len(seen):
            first = self.lexicon.id_start[place[seen]].astype(np.int64)
            size[seen] = self.lexicon.id_start[place[seen] + 1] - first
        special = np.fromiter((p.special for p in parts), np.int64, len(parts))
        behind = special >= 0
        earlier = np.cumsum(behind) - behind
        by_part = np.bincount(pieces.part, weights=size, minlength=len(parts)).astype(np.int64)
        ids = np.empty(int(by_part.sum() + behind.sum()), np.int32)
        at = np.cumsum(size) - size + earlier[pieces.part]
        if len(seen):
            ids[spans(at[seen], size[seen])] = self.lexicon.ids[spans(first, size[seen])]
        ids[spans(at[words], size[words])] = of_words
        ids[spans(at[unseen], size[unseen])] = np.fromiter((i for m in merged for i in m), np.int32)
        ids[(np.cumsum(by_part) + earlier)[behind]] = special[behind]
        return ids, np.fromiter((p.number for p in parts), np.int64, len(parts)), by_part + behind

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and how many each has."""
        counts, rows = np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
        for ids, numbers, sizes in self.blocks(texts):
            rows.append(ids)
            np.add.at(counts, numbers, sizes)
        return np.concatenate(rows), counts


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, behind each other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def piece_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """piece (bytes) and how often it stands in all whole texts; tasks send sums of what they have counted."""
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = held((Vocabulary, path), lambda: Vocabulary(path)), Counter()
        for batch in batches:
            for parts in blocks_of(parts_of(_texts(batch, 0), vocabulary)):
                pieces = Pieces(parts)
                short = pieces.length <= LONGEST
                signs, start = pieces.signs.tobytes(), pieces.start[short]
                counts.update([signs[a:b] for a, b in zip(start.tolist(), (start + pieces.length[short]).tolist(), strict=True)])
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    reachable(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def frequent_pieces(counts: DataFrame, most: int) -> list[bytes]:
    """The pieces of the highest counts, ``most`` at most, sorted; pieces whose counts lie close together go in or stay out together.

    The limit comes from a histogram of counts, in bins of an eighth of a doubling, so that only what is chosen is brought together.
    """
    counts = cut(counts.withColumn("bin", F.floor(F.log2("n") * 8)))
    limit = least_bin(counts, "bin", most)
    return sorted(bytes(r["piece"]) for r in counts.filter(F.col("bin") >= limit).select("piece").collect())


def write_lexicon(docs: DataFrame, tokenizer: str | None = None, words: int = 1 << 17) -> str:
    """Compile the most frequent pieces of ``docs``, ``words`` at most, into a file of the shared folder; its place.

    What is brought to the driver is bounded by the parameters ``words`` and LONGEST: some MB.
    """
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")
    frequent = frequent_pieces(piece_counts(docs, path), words)
    vocabulary = Vocabulary(path)
    spark = docs.sparkSession
    place = f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(compile_words(frequent, [vocabulary.encode(w) for w in frequent])))
    out.close()
    return place


def _encoder(spark: SparkSession, path: str, lexicon: str | None) -> Callable[[], Encoder]:
    """Gives each worker its encoder; Spark brings the lexicon's file to every machine, also to later ones."""
    if lexicon:
        spark.sparkContext.addFile(lexicon)
    name = lexicon and lexicon.rsplit("/", 1)[1]
    return lambda: held((Encoder, path, name), lambda: Encoder(path, name and SparkFiles.get(name)))


def encode(docs: DataFrame, lexicon: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids of every whole text, special strings read as such; a null or empty text has no ids.

    ``lexicon`` is the place of a file by :func:`write_lexicon`; without it every piece is merged.  Repeated
    rows get equal ids; extra columns are not read.
    """
    encoder = _encoder(docs.sparkSession, tokenizer or default_tokenizer("byte_bpe_50k.json"), lexicon)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, counts = encoder().batch(_texts(batch, 1))
        rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text, bytes that are no UTF-8 the sign for that."""
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary = held((Vocabulary, path), lambda: Vocabulary(path))
        texts = [vocabulary.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, lexicon: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them.

    A text is encoded, decoded and hashed block by block.
    """
    encoder = _encoder(docs.sparkSession, tokenizer or default_tokenizer("byte_bpe_50k.json"), lexicon)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, texts = encoder(), _texts(batch, 1)
        coded, decoded, counts = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts], [0] * len(texts)
        for flat, numbers, sizes in of.blocks(texts):
            at = 0
            for number, n in zip(numbers.tolist(), sizes.tolist(), strict=True):
                ids = flat[at:at + n].tolist()
                at += n
                if ids:
                    coded[number].update(b"," * (counts[number] > 0) + b",".join(map(of.vocabulary.decimals.__getitem__, ids)))
                    # Parts end between whole signs, so that each is decoded by itself.
                    decoded[number].update(of.vocabulary.decode(ids).decode("utf-8", "replace").encode())
                    counts[number] += n
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), *(pa.array([h.hexdigest() for h in hashes], pa.string()) for hashes in (coded, decoded))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
