"""A minimal acyclic transducer from words to the numbers of their ids, in arrays that are mapped into memory.

Sorted words are compiled into an automaton whose equal suffixes are one; every arc carries the number of
words that come before those behind it, so the sum along a word's path is its place among the words, and
that place names its ids.  Arcs lie in a double array: the arc of state ``s`` with byte ``b`` is the slot
``base[s] + b`` if that slot is owned by ``s``.  All words of a batch walk one byte at a time together.
"""

from __future__ import annotations

import numpy as np

#: Arrays of a file, one behind the other, each of little-endian 32-bit integers; their lengths stand first.
PARTS = ("base", "final", "owner", "target", "add", "id_start", "ids")


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of distinct words, sorted by their bytes, and the ids of each."""
    arcs, final = _minimal(words)
    counts = _word_counts(arcs, final)
    base, owner, target, add = _double_array(arcs, final, counts)
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [base, final, owner, target, add, starts, [i for row in ids for i in row]]
    packed = [np.asarray(a, "<i4") for a in arrays]
    return np.asarray([len(a) for a in packed], "<i8").tobytes() + b"".join(a.tobytes() for a in packed)


def _minimal(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool]]:
    """Arcs (byte, state) and endings of the states; state 0 is the first.

    Words come sorted, so only the path of the last word can still change; what leaves that path is
    replaced by an equal state known before, or becomes known.
    """
    arcs: list[list[tuple[int, int]]] = [[]]
    final = [False]
    known: dict[tuple, int] = {}
    spare: list[int] = []
    path, last = [0], b""
    for word in [*words, b""]:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            state = path.pop()
            same = known.setdefault((final[state], *arcs[state]), state)
            if same != state:
                byte, _ = arcs[path[-1]][-1]
                arcs[path[-1]][-1] = (byte, same)
                spare.append(state)
        for byte in word[shared:]:
            if spare:
                state = spare.pop()
                arcs[state], final[state] = [], False
            else:
                state = len(arcs)
                arcs.append([])
                final.append(False)
            arcs[path[-1]].append((byte, state))
            path.append(state)
        if word:
            final[path[-1]] = True
        last = word
    return arcs, final


def _word_counts(arcs: list[list[tuple[int, int]]], final: list[bool]) -> list[int]:
    """Words that end in or behind each state."""
    counts: list[int] = [-1] * len(arcs)
    todo = [0]
    while todo:
        state = todo[-1]
        open_states = [t for _, t in arcs[state] if counts[t] < 0]
        if open_states:
            todo += open_states
        else:
            counts[state] = final[state] + sum(counts[t] for _, t in arcs[state])
            todo.pop()
    return counts


#: Places that are tried for a state before the search moves on for good.
TRIES = 64


def _double_array(arcs, final, counts):
    """Places for the arcs of all states, those with many arcs first; single arcs fill the gaps."""
    used = bytearray(1024)
    base = [0] * len(arcs)
    slots: list[tuple[int, int, int, int]] = []
    search, gap = 0, 256
    for state in sorted((s for s in range(len(arcs)) if arcs[s] and counts[s] >= 0), key=lambda s: -len(arcs[s])):
        bytes_ = [b for b, _ in arcs[state]]
        if len(bytes_) > 1:
            at = search
            while any(used[at + b] for b in bytes_):
                at += 1
                if at + 512 > len(used):
                    used.extend(bytes(len(used)))
            if at - search > TRIES:
                search = at
        else:
            while used[gap]:
                gap += 1
                if gap + 512 > len(used):
                    used.extend(bytes(len(used)))
            at = gap - bytes_[0]
        base[state], before = at, int(final[state])
        for byte, other in arcs[state]:
            used[at + byte] = 1
            slots.append((at + byte, state, other, before))
            before += counts[other]
    # So that any base and any byte name a slot.
    size = max(base, default=0) + 256
    owner, target, add = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    if slots:
        place, *columns = np.asarray(slots, np.int64).T
        owner[place], target[place], add[place] = columns
    return base, owner, target, add


class Transducer:
    """The arrays of a file, mapped into memory and shared by all workers of a machine."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        sizes = np.frombuffer(whole[:8 * len(PARTS)], "<i8")
        at = 8 * len(PARTS)
        for name, size in zip(PARTS, sizes.tolist(), strict=True):
            setattr(self, name, np.frombuffer(whole[at:at + 4 * size], "<i4"))
            at += 4 * size

    def __len__(self) -> int:
        return len(self.id_start) - 1

    def places(self, signs: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place among the words of each piece ``signs[start:start + length]``, -1 for others."""
        place = np.full(len(start), -1, np.int64)
        row = np.flatnonzero(length > 0)
        at, left = start[row], length[row]
        state, total = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
        while len(row):
            slot = self.base[state] + signs[at]
            owned = self.owner[slot] == state
            if not owned.all():
                row, at, left, slot, total = row[owned], at[owned], left[owned], slot[owned], total[owned]
            state = self.target[slot]
            total = total + self.add[slot]
            at, left = at + 1, left - 1
            done = left == 0
            ended = done & (self.final[state] > 0)
            place[row[ended]] = total[ended]
            if done.any():
                on = ~done
                row, at, left, state, total = row[on], at[on], left[on], state[on], total[on]
        return place
