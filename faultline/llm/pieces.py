"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best score first, then leftmost.  Each candidate is skipped with
the dropout rate by itself; what is drawn is how many are taken before the next is skipped, by a
hash keyed by the seed, the document and the place of the stretch in it, so a seed fixes every choice
and a word takes its segmentation anew wherever it stands.  Workers remember what a stretch becomes
without a skip; stretches into which a skip falls go through the agenda together, in rounds.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.bpe import Ranks, spans
from faultline.llm.common import arrow_map, columns_of, default_tokenizer, held

SPACE = "▁"
#: Stands for the space sign itself inside a text; no piece holds it.
_LITERAL = "\0"
MEMORY, LONGEST = 96 << 20, 48
#: Signs that are worked on at once.
BLOCK = 1 << 20
_BEGIN = re.compile(r"(?<=[^ ]) |\n")
#: Lots end at so many candidates taken in a row; beyond, a further lot adds to the first.
RUN = 4096
_ONES = 2**64 - 1
ENCODED = "doc_id long, ids array<int>"


class Model:
    """Pieces and scores of a model file, and the agenda of merges over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids, self.scores, self.raw, self.bytes = {}, [0.0] * self.size, [b""] * self.size, {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[i] = i, model.get_score(i)
                self.raw[i] = piece.replace(SPACE, " ").encode()
        # Stretches end before a space; that is exact only while no piece holds one inside.
        if any(re.search(f"[^{SPACE}]{SPACE}|[\n\0]", piece) for piece in self.ids):
            raise ValueError(f"{path}: a piece holds a space or line end inside, so stretches cannot be encoded apart")

    def encode(self, stretch: str, skips: Iterator[int] = iter(())) -> tuple[int, bytes]:
        """Ids (little-endian, 32 bits) of a stretch, and the candidates taken since the last skip.

        ``skips`` says how many candidates are taken before each that is skipped; after its end
        all are taken.
        """
        ids, scores = self.ids.get, self.scores
        signs = stretch.replace(SPACE, _LITERAL).replace(" ", SPACE)
        n = len(signs)
        # The symbol that begins at i ends at end[i] (0: none begins there); start is the inverse.
        end, start = list(range(1, n + 1)), list(range(-1, n))
        run, taken = next(skips, -1), 0
        agenda = [(-scores[i], at, at + 1, at + 2, i) for at in range(n - 1) if (i := ids(signs[at:at + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, left, middle, right, i = pop(agenda)
            if end[left] != middle or end[middle] != right:
                continue
            if taken == run:
                run, taken = next(skips, -1), 0
                continue
            taken += 1
            end[left], end[middle], start[right] = right, 0, left
            if right < n and (i := ids(signs[left:end[right]])) is not None:
                push(agenda, (-scores[i], left, right, end[right], i))
            if left and (i := ids(signs[start[left]:right])) is not None:
                push(agenda, (-scores[i], start[left], left, right, i))
        out, at = [], 0
        while at < n:
            if (i := ids(signs[at:end[at]])) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in stretch[at].encode()]
            at = end[at]
        return taken, struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids from ``Encoder``; the first space is the one that encoding put there."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Rounds:
    """The agenda over many stretches at once: in every round each takes, or skips, its best and then leftmost candidate."""

    def __init__(self, model: Model):
        ids = model.ids
        splits = {(ids[piece[:k]], ids[piece[k:]]): (0, i) for piece, i in ids.items() for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids}
        self.pairs, none = Ranks(splits), Ranks.NONE
        # Equal scores are equal ranks, so that the leftmost goes first.
        order = np.unique(-np.asarray(model.scores), return_inverse=True)[1].astype(np.int32)
        self.rank = np.append(order[self.pairs.made], np.int32(none)).astype(np.int32)
        self.of_sign = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_sign[ord(piece)] = i
        # A text's own space sign is spelled in bytes; its spaces are the sign.
        self.of_sign[ord(" ")], self.of_sign[ord(SPACE)] = self.of_sign[ord(SPACE)], -1

    def codes(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all signs behind each other (-1 for signs that are no piece), and the signs of each stretch."""
        signs = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.of_sign[signs].astype(np.int64), np.fromiter(map(len, stretches), np.int64, len(stretches))

    def _find(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = self.pairs(ids[at], ids[at + 1])
        return pair, self.rank[np.minimum(pair, len(self.rank) - 1)]

    def merge(self, ids: np.ndarray, size: np.ndarray, runs: np.ndarray | None = None, draw=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each stretch has, and the candidates each has taken since its last skip.

        ``runs`` says how many candidates each stretch takes before one is skipped, ``draw`` of stretches and
        turns the next such numbers; without them all are taken.
        """
        none, n = Ranks.NONE, len(size)
        word, live, size = np.repeat(np.arange(n), size), np.arange(n), size.copy()
        taken, turn = np.zeros(n, np.int64), np.ones(n, np.int64)
        runs = np.full(n, RUN, np.int64) if runs is None else runs.astype(np.int64)
        pair, rank = np.full(len(ids), none, np.int32), np.full(len(ids), none, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair[inner], rank[inner] = self._find(ids, inner)
        ended = [(live[:0], size[:0], ids[:0], taken[:0])]
        while len(ids):
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            over = best == none
            if over.sum() * 4 >= len(over):
                # Stretches that have ended are laid aside, many at a time.
                gone = over[word]
                ended.append((live[over], size[over], ids[gone], taken[over]))
                word = (np.cumsum(~over) - 1)[word[~gone]]
                ids, pair, rank = ids[~gone], pair[~gone], rank[~gone]
                live, size, taken, turn, runs, best = (x[~over] for x in (live, size, taken, turn, runs, best))
                if not len(ids):
                    break
            at = np.flatnonzero((rank == best[word]) & (rank < none))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            skipped = taken[word[at]] == runs[word[at]]
            out, at = at[skipped], at[~skipped]
            if len(out):
                pair[out] = rank[out] = none
                of = word[out]
                runs[of], taken[of] = draw(live[of], turn[of]), 0
                turn[of] += 1
            if len(at):
                ids[at] = self.pairs.made[pair[at]]
                kept = np.ones(len(ids), bool)
                kept[at + 1] = False
                size[word[at]] -= 1
                taken[word[at]] += 1
                ids, word, pair, rank = ids[kept], word[kept], pair[kept], rank[kept]
                at = at - np.arange(len(at))
                pair[at] = rank[at] = none
                for left in (at, at - 1):
                    left = left[(left >= 0) & (left + 1 < len(ids))]
                    left = left[word[left] == word[left + 1]]
                    pair[left], rank[left] = self._find(ids, left)
        number, sizes, flat, took = (np.concatenate(x) for x in zip(*ended, strict=True))
        counts, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        counts[number], last[number] = sizes, took
        result = np.empty(len(flat), np.int64)
        result[spans((np.cumsum(counts) - counts)[number], sizes)] = flat
        return result, counts, last


class Lots:
    """Runs of candidates taken before one is skipped, by document, place and turn."""

    def __init__(self, dropout: float, seed: int):
        self.seed = seed
        # A run is at least k long with (1 - dropout)**k: so many lots of 2**64 lie below.
        below = [int((1 - dropout) ** k * 2**64) for k in range(1, RUN + 1)]
        self.listed = sorted(min(b, _ONES) for b in below)
        self.below = np.array(self.listed, np.uint64)

    def key(self, document: str) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%s" % (self.seed, document.encode()), digest_size=8).digest(), "little")

    def first(self, key: int, places: int) -> np.ndarray:
        """The first run at each place."""
        return self._runs(np.arange(places, dtype=np.uint64) << np.uint64(32), key)

    def later(self, key: int, place: int, first: int) -> Iterator[int]:
        """All runs at a place, of which the first is known."""
        turn, run, last = 1, first, first
        while True:
            while last == RUN:
                last = self._run(place << 32 | turn, key)
                run, turn = run + last, turn + 1
            yield run
            run = last = self._run(place << 32 | turn, key)
            turn += 1

    def _run(self, at: int, key: int) -> int:
        x = ((at + 1) * 0x9E3779B97F4A7C15 + key) & _ONES
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ONES
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ONES
        return RUN - bisect_right(self.listed, x ^ (x >> 31))

    def runs(self, places: np.ndarray, turns: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The runs at places and turns of the documents with these keys; RUN stands for longer ones too."""
        return self._runs(places.astype(np.uint64) << np.uint64(32) | turns.astype(np.uint64), keys)

    def _runs(self, at: np.ndarray, key) -> np.ndarray:
        x = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(key, np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return RUN - np.searchsorted(self.below, x ^ (x >> np.uint64(31)), side="right")


class Known:
    """What stretches become without a skip; half of the memory is given up when it is full.

    A stretch's bytes are the number of candidates taken and the ids, all in 32 bits.
    """

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def find(self, stretches: list[str]) -> list[bytes | None]:
        found = list(map(self.new.get, stretches))
        missing = [i for i, f in enumerate(found) if f is None]
        again = {}
        for i, f in zip(missing, map(self.old.get, map(stretches.__getitem__, missing))):
            if f is not None:
                found[i] = again[stretches[i]] = f
        self.put(again)
        return found

    def put(self, learned: dict[str, bytes]) -> None:
        # The sizes of the objects, roughly.
        self.size += 200 * len(learned) + 2 * sum(map(len, learned)) + sum(map(len, learned.values()))
        self.new.update(learned)
        if self.size > MEMORY // 2:
            self.old, self.new, self.size = self.new, {}, 0


class Encoder:
    """Ids of whole texts under one seed and dropout.

    ``variants`` lets documents share so many keys; none gives each its own.
    """

    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = None):
        self.model, self.variants = Model(path), variants
        self.rounds = Rounds(self.model)
        self.lots = Lots(dropout, seed) if dropout > 0 else None
        self.known = Known()
        self.line_end = struct.pack("<I", self.model.bytes[10])

    def key(self, doc_id: int | None) -> int:
        of = str(doc_id) if self.variants is None else str(zlib.crc32(str(doc_id).encode()) % self.variants)
        return self.lots.key(of) if self.lots else 0

    def __call__(self, text: str, doc_id: int | None) -> bytes:
        return self.batch([text], [doc_id])[0]

    def batch(self, texts: list[str], doc_ids: list[int | None]) -> list[bytes]:
        """The ids of each text, little-endian in 32 bits; about BLOCK signs are worked on at once, of long texts too."""
        out: list[list[bytes]] = [[] for _ in texts]
        places, block, size = [0] * len(texts), [], 0
        for number, (text, doc_id) in enumerate(zip(texts, doc_ids, strict=True)):
            if not text:
                continue
            text, key, at = " " + text, self.key(doc_id), 0
            while at < len(text):
                found = _BEGIN.search(text, at + BLOCK)
                end = found.start() if found else len(text)
                block.append((number, text[at:end], key))
                at, size = end, size + end - at
                if size >= BLOCK:
                    self._flush(block, places, out)
                    block, size = [], 0
        self._flush(block, places, out)
        return [b"".join(coded) for coded in out]

    def _flush(self, block: list[tuple[int, str, int]], places: list[int], out: list[list[bytes]]) -> None:
        """Encode parts of texts, each from the start of a stretch on; ``places`` are the stretches of each text before."""
        if not block:
            return
        signs = "".join(part for _, part, _ in block)
        points = np.frombuffer(signs.encode("utf-32-le", "surrogatepass"), "<u4")
        part_ends = np.cumsum([len(part) for _, part, _ in block])
        # A stretch is a word with the spaces before it, or a line end.
        line_end, space = points == 10, points == 32
        begins = np.ones(len(points), bool)
        begins[1:] = line_end[1:] | line_end[:-1] | space[1:] & ~space[:-1]
        begins[part_ends[:-1]] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, len(points)))
        part = np.searchsorted(part_ends, start, side="right")
        # Line ends are no places and take no lots.
        word = ~line_end[start]
        counts = np.bincount(part, weights=word, minlength=len(block)).astype(np.int64)
        base = np.zeros(len(block), np.int64)
        for i, (number, *_) in enumerate(block):
            base[i] = places[number]
            places[number] += int(counts[i])
        place = np.cumsum(word) - 1 + (base - np.cumsum(counts) + counts)[part]
        keys = np.asarray([key for *_, key in block], np.uint64)[part]
        runs = np.full(len(start), RUN, np.int64)
        if self.lots:
            runs[word] = self.lots.runs(place[word], np.zeros(int(word.sum()), np.int64), keys[word])
        of, first = _distinct(signs, points, start, length)
        distinct = [signs[a:b] for a, b in zip(start[first].tolist(), (start + length)[first].tolist(), strict=True)]
        ids, sizes = self._coded(distinct, of, place, runs, keys)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(np.bincount(part, minlength=len(block))))].tolist()
        for (number, *_), a, b in zip(block, ends, ends[1:]):
            out[number].append(ids[a:b].tobytes())

    def _coded(self, distinct: list[str], of: np.ndarray, place: np.ndarray, runs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches behind each other, and how many each has; ``of`` says which of the distinct ones each is."""
        codes, signs = self.rounds.codes(distinct)
        first_code = np.cumsum(signs) - signs
        plain = (signs <= LONGEST) & (np.minimum.reduceat(codes, first_code) >= 0)
        found = self.known.find(distinct)
        if "\n" in distinct:
            found[distinct.index("\n")] = struct.pack("<I", 0) + self.line_end
        new = np.fromiter((f is None for f in found), bool, len(found))
        if new.any():
            ids, sizes, taken = self.rounds.merge(codes[np.repeat(new & plain, signs)], signs[new & plain])
            headed = np.empty(len(ids) + len(sizes), np.int64)
            heads = np.cumsum(sizes + 1) - sizes - 1
            headed[heads] = taken
            headed[spans(heads + 1, sizes)] = ids
            quick = np.flatnonzero(new & plain).tolist()
            for i, f in zip(quick, _split(headed, sizes + 1), strict=True):
                found[i] = f
            for i in np.flatnonzero(new & ~plain).tolist():
                took, coded = self.model.encode(distinct[i])
                found[i] = struct.pack("<I", took) + coded
            self.known.put({distinct[i]: found[i] for i in np.flatnonzero(new & (signs <= LONGEST)).tolist()})
        flat = [np.frombuffer(b"".join(found), "<u4")]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4 - 1
        start = np.cumsum(size + 1) - size
        took = flat[0][start - 1].astype(np.int64)
        start, size = start[of], size[of]
        if self.lots:
            taken = took[of]
            # A run of RUN may be longer, so only its later lots tell whether a skip falls into a very long stretch.
            drawn = np.flatnonzero((runs < taken) | (runs == RUN) & (taken > RUN))
            quick, slow = drawn[plain[of[drawn]]], drawn[~plain[of[drawn]]].tolist()
            ids, size[quick], _ = self.rounds.merge(
                codes[spans(first_code[of[quick]], signs[of[quick]])], signs[of[quick]], runs[quick],
                lambda number, turn: self.lots.runs(place[quick[number]], turn, keys[quick[number]]))
            start[quick] = len(flat[0]) + np.cumsum(size[quick]) - size[quick]
            flat.append(ids.astype("<u4"))
            at = len(flat[0]) + len(ids)
            for i in slow:
                runs_of = self.lots.later(int(keys[i]), int(place[i]), int(runs[i]))
                flat.append(np.frombuffer(self.model.encode(distinct[of[i]], runs_of)[1], "<u4"))
                start[i], size[i] = at, len(flat[-1])
                at += len(flat[-1])
        return np.concatenate(flat)[spans(start, size)], size


def _distinct(signs: str, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct stretch each one is, and where each distinct one first stands: by hashes, compared sign by sign."""
    at = np.arange(len(points), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64)
    x = (points + (at << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, of = np.unique(np.add.reduceat(x ^ (x >> np.uint64(32)), start), return_index=True, return_inverse=True)
    same = start[first][of]
    if (length == length[first][of]).all() and (points == points[spans(same, length)]).all():
        return of, first
    numbers: dict[str, int] = {}
    of = np.fromiter((numbers.setdefault(signs[a:a + n], len(numbers)) for a, n in zip(start.tolist(), length.tolist(), strict=True)), np.int64)
    return of, np.unique(of, return_index=True)[1]


def _split(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    whole, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _encoder(*settings) -> Encoder:
    return held((Encoder, *settings), lambda: Encoder(*settings))


def encode(docs: DataFrame, model: str | None = None, dropout: float = 0.1, seed: int = 1, variants: int | None = None) -> DataFrame:
    """doc_id and ids of every whole text; a null or empty text has no ids.

    Repeated rows get equal ids.  A sign the model does not know is spelled in bytes, also the
    sign that stands for a space where a text holds it.  Extra columns are not read.
    """
    path = model or default_tokenizer("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = _encoder(path, dropout, seed, variants)
        doc_ids, texts = columns_of(batch, "doc_id", "text")
        coded = of.batch([t or "" for t in texts], doc_ids)
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), ids], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""
    path = model or default_tokenizer("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = _encoder(path, 0.0, 0, 1).model
        texts = [of.decode(ids or []) for ids in columns_of(batch, "ids")[0]]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def checked(docs: DataFrame, model: str | None = None, dropout: float = 0.1, seed: int = 1, variants: int | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether decoding gives the text again, without storing the ids."""
    path = model or default_tokenizer("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = _encoder(path, dropout, seed, variants)
        n, crc, same = [], [], []
        doc_ids, texts = columns_of(batch, "doc_id", "text")
        for coded, text in zip(of.batch([t or "" for t in texts], doc_ids), texts, strict=True):
            ids = struct.unpack(f"<{len(coded) // 4}I", coded)
            n.append(len(ids))
            crc.append(zlib.crc32(coded))
            same.append(of.model.decode(ids) == (text or ""))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)],
            ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
