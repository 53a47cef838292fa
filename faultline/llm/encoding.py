"""Exact token ids of whole texts, fast.

A byte-level or word-level vocabulary splits a text into pre-tokens before it merges
anything, and no merge crosses a pre-token.  A lone space between two visible characters
always ends a pre-token, whatever stands around it, so the stretches between such spaces
can be encoded one by one, and frequent stretches only once per worker.  What is not such
a lone space is left inside its stretch and goes to the library as it is, special strings
included.  Ids are kept as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
import struct

import numpy as np

from faultline.llm.common import held

#: Bytes of stretches and ids in a worker's memory, and as many in its old one.
MEMORY = 64 << 20
#: Longer stretches are encoded each time.
LONGEST = 48

#: White space other than the space and the line end, and signs some versions of a regular
#: expression library take for white space.  No cut is made beside them.
_ODD = "\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_HAS_ODD = re.compile(f"[{_ODD}]")
_LONE_SPACE = re.compile(f"(?<=[^\\s{_ODD}]) (?=[^\\s{_ODD}])")


def load(path: str):
    """The tokenizer of a file; one core per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts of Latin-1 signs, which lower-case one by one.
_LATIN = re.compile(r"[\x00-\xff]*")
#: A word of plain letters with plain signs behind it: two pre-tokens in every vocabulary here,
#: unchanged by composition, so the merges of the model apply to them directly.
_LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_BEHIND = ".,;:!?$%&*#|"


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in byte-level vocabularies (a fixed rule of theirs)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


SIGNS = _byte_signs()
#: The signs of all bytes, as a table for decoding.
_SHOWN = "".join(chr(SIGNS.get(b, b)) for b in range(256))


@functools.lru_cache(64)
def _layout(n: int) -> struct.Struct:
    return struct.Struct(f"<{n}I")


def _packed(ids: list[int]) -> bytes:
    return _layout(len(ids)).pack(*ids)


class Stretches(dict):
    """The ids of ``before + stretch``, encoded when first asked for.

    When the memory is full it becomes the old one, from which frequent stretches return.
    """

    def __init__(self, tokenizer, before: str = "", lower: bool = False):
        super().__init__()
        self.tokenizer, self.before, self.lower, self.old, self.size = tokenizer, before, lower, {}, 0
        # Asked of the tokenizer each time, the model would be wrapped anew for every word.
        self.model = tokenizer.model
        #: The ids of the one or two signs that stand behind words.
        self.behind: dict[str, bytes] = {}

    def merged(self, pretoken: str) -> bytes:
        signs = codecs.charmap_decode(pretoken.encode(), "strict", _SHOWN)[0]
        return _packed([t.id for t in self.model.tokenize(signs)])

    def encode(self, stretch: str) -> bytes:
        word = stretch.rstrip(_BEHIND)
        if word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)):
            if len(word) < len(stretch):
                signs = stretch[len(word):]
                ids = self.behind.get(signs)
                if ids is None:
                    ids = self.merged(signs)
                    if len(signs) <= 2:
                        self.behind[signs] = ids
                return self[word] + ids
            return self.merged(self.before + (word.lower() if self.lower else word))
        return _packed(self.tokenizer.encode(self.before + stretch, add_special_tokens=False).ids)

    def __missing__(self, stretch: str) -> bytes:
        packed = self.old.get(stretch)
        if packed is None:
            packed = self.encode(stretch)
        if len(stretch) <= LONGEST:
            # The sizes of the objects, roughly.
            self.size += 200 + len(stretch) + len(packed)
            if self.size > MEMORY:
                self.old, self.size = dict(self), 0
                self.clear()
            self[stretch] = packed
        return packed


class ByteLevel:
    """Byte-level vocabularies: a space belongs to the stretch behind it."""

    def __init__(self, path: str):
        tokenizer = load(path)
        self.first, self.later = Stretches(tokenizer), Stretches(tokenizer, " ")
        self.line_end = self.first["\n"]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        later = self.later.__getitem__
        if (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text
                or "\n " in text or _HAS_ODD.search(text)):
            head, *rest = _LONE_SPACE.split(text)
            return b"".join([self.first[head], *map(later, rest)])
        parts = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts.append(self.first[head])
            parts.extend(map(later, rest))
            parts.append(self.line_end)
        parts.pop()
        return b"".join(parts)


class WordLevel:
    """Vocabularies that drop white space: every space and line end cuts."""

    def __init__(self, path: str):
        self.stretch = Stretches(load(path), lower=True)

    def __call__(self, text: str) -> bytes:
        # Lowered at once where that is the same as sign by sign, so that more stretches are known.
        # Special strings are matched before lowering, so a text that may hold one is left alone.
        if "<|" not in text and (text.isascii() or _LATIN.fullmatch(text)):
            text = text.lower()
        return b"".join(map(self.stretch.__getitem__, text.replace("\n", " ").split(" ")))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each stretch ends in the text, and the ids up to there."""
        stretches = text.replace("\n", " ").split(" ")
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ids = np.fromiter(map(len, map(self.stretch.__getitem__, stretches)), np.int64, len(stretches))
        return np.cumsum(size + 1) - 1, np.cumsum(ids) // 4


def encoder(kind: type, path: str):
    """The worker's encoder of a file."""
    return held((kind, path), lambda: kind(path))
