"""Toxicity scores from a lexicon matched with misspellings, and the words around each match.

The lexicon is learned from all labelled documents: words, and beginnings of words that share a stem,
whose share among toxic documents is far beyond chance.  Its terms are nodes of one trie.  A Levenshtein
automaton of every term walks the trie at once: its states are sets of (trie node, edits so far), made when
first reached and kept.  Each match is weighed by its surroundings: words of quotation or quotation marks
near it make it a mention, words of address make it abuse.  A logistic model over a handful of sums per
document gives the score; only its weights are fitted on a bounded sample.
"""

from __future__ import annotations

import collections
import functools
import itertools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, columns_of, cut, held, least_bin, reachable
from faultline.llm.jaccard import U, mix

#: Common English insults (plain words), for use without labels.
SEED_TERMS = ("bastard", "clown", "coward", "creep", "degenerate", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile",
              "jerk", "liar", "loser", "moron", "parasite", "pathetic", "pervert", "scum", "sleazy", "stupid", "trash", "vermin", "worthless")
#: Words that report what others said, and words of address, in the languages of the corpus.
REPORTING = frozenset("said says called calls wrote quote quoted quoting word words term terms definition dijo dice llamó sagte nannte"
                      " zitat wort dit appelé citation mot".split())
ADDRESS = frozenset("you you're youre your u ur du dein ihr tu toi vous tú usted".split())
QUOTES = "\"'“”«»„‘’`"
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”«»„‘’…"
LEET = str.maketrans("013457@$", "oieastas")
#: Words on each side of a match that are looked at.
AROUND = 4
#: Bytes of words that a worker remembers, and entries of automaton states.
MEMORY, ENTRIES = 24 << 20, 300_000
#: Signs of texts whose words are matched at once, and forms of words.
BLOCK, FORMS = 1 << 20, 1 << 17
#: Base of the hash of forms, and its inverse among 64-bit numbers.
BASE = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(BASE), -1, 1 << 64))
#: Marks of documents (12 bytes each) that are sent to every executor.
SENT_LABELS = 1_000_000
#: Letters of a stem, least and most, and most of a whole term.
STEM, LONGEST = (4, 24), 64
#: A term stands in three toxic documents at least, at a share that is this many times that in others, and the
#: likelihood ratio of its counts exceeds this value (about four standard deviations), whatever the size of the corpus.
LEAST_TOXIC, RATIO, BEYOND_CHANCE = 3, 4, 16.0
#: A node below another one is a term of its own if its log odds are higher by this much.
CLEARER = 1.0
#: Log odds of terms without counts.
GIVEN = 3.0
FEATURES = ("exact", "misspelled", "mentioned", "terms", "addressed", "evidence")
#: Means and precision of the prior of the weights, which carry what too few labels cannot teach.
PRIOR = np.array([-4.0, 0.8, 0.5, 0.0, 0.2, 0.3, 0.6])
STRENGTH = 1.0


def edits_for(term: str) -> int:
    """Edits allowed for a term: none for short ones, two for long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All terms with their misspellings, walked one sign at a time; stems match every word that begins with them.

    ``limits`` are the edits allowed for each term; stems are matched as they are.  Indices of stems go on
    behind those of the terms.
    """

    def __init__(self, terms: list[str], stems: list[str] = (), limits: list[int] | None = None):
        self.limits = [edits_for(t) for t in terms] if limits is None else limits
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.stems: list[int | None] = [None]
        self.allowed = [0]
        for index, (term, limit) in enumerate(zip(terms, self.limits, strict=True)):
            self.ends[self._path(term, limit)] = index
        for index, stem in enumerate(stems, len(terms)):
            self.stems[self._path(stem, 0)] = index
        self._forget()

    def _path(self, term: str, limit: int) -> int:
        node = 0
        self.allowed[0] = max(self.allowed[0], limit)
        for sign in term:
            if sign not in self.children[node]:
                self.children[node][sign] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.stems.append(None)
                self.allowed.append(0)
            node = self.children[node][sign]
            self.allowed[node] = max(self.allowed[node], limit)
        return node

    def _forget(self) -> None:
        """Begin without states."""
        self.entries = 0
        self.numbers: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.begun: list[int | None] = []
        self.first = self._number(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """Add what is reached by leaving out signs of a term."""
        todo = list(state)
        while todo:
            node = todo.pop()
            edits = state[node] + 1
            for child in self.children[node].values():
                if edits <= self.allowed[child] and edits < state.get(child, 99):
                    state[child] = edits
                    todo.append(child)
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.entries += 1 + len(state)
            hits = [(e, self.ends[n]) for n, e in state.items() if self.ends[n] is not None and e <= self.limits[self.ends[n]]]
            best = min(hits, default=None)
            self.found.append(None if best is None else (best[1], best[0]))
            self.begun.append(next((self.stems[n] for n, e in state.items() if not e and self.stems[n] is not None), None))
        return self.numbers[key]

    def _move(self, number: int, sign: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and edits < out.get(node, 99):
                out[node] = edits

        for node, edits in self.states[number].items():
            reach(node, edits + 1)
            for other, child in self.children[node].items():
                reach(child, edits if other == sign else edits + 1)
        self.moves[number][sign] = target = self._number(self._closed(out)) if out else -1
        return target

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term within its edits, and the edits; ties to the first term.

        A word that begins with a stem matches the longest such stem, unless a whole term matches as it is.
        """
        if self.entries > ENTRIES:
            self._forget()
        at, moves, begun = self.first, self.moves, self.begun
        stem = None
        for sign in word:
            after = moves[at].get(sign)
            at = self._move(at, sign) if after is None else after
            if at < 0:
                break
            if begun[at] is not None:
                stem = begun[at]
        found = self.found[at] if at >= 0 else None
        if stem is not None and (found is None or found[1]):
            return stem, 0
        return found


@functools.lru_cache(1024)
def left_out(length: int, edits: int) -> np.ndarray:
    """The ways to leave out ``edits`` of ``length`` signs: one column of places each, rising."""
    return np.array([*itertools.combinations(range(length), edits)], np.intp).reshape(math.comb(length, edits), edits).T


def forms(words: list[str], edits: int) -> Iterator[np.ndarray]:
    """Hashes of the words, and of what leaving out up to ``edits`` signs makes of them (way, word); all words have one length.

    The hash is a polynomial.  That of a shortened word is its own and one number for each sign left out, so
    the shortened words need not be made.
    """
    length = len(words[0])
    signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length).T
    power = np.cumprod(np.concatenate((np.ones(1, U), np.full(length, BASE))))[:length, None]
    sums = np.zeros((length + 1, len(words)), U)
    np.cumsum(mix(signs.astype(U) + U(1)) * power, axis=0, out=sums[1:])
    gaps = sums[:-1] - BACK * sums[1:]
    for left in range(min(edits, length) + 1):
        shift = [U(pow(int(BACK), n, 1 << 64)) for n in range(left + 1)]
        out = np.broadcast_to(shift[left] * sums[length], (left_out(length, left).shape[1], len(words)))
        for places, factor in zip(left_out(length, left), shift, strict=False):
            out = out + (factor * gaps)[places]
        yield out


def by_length(words: list[str], least: int, most: int) -> Iterator[tuple[int, list[int]]]:
    """The places of the words of each length between ``least`` and ``most``."""
    places = collections.defaultdict(list)
    for place, word in enumerate(words):
        if least <= len(word) <= most:
            places[len(word)].append(place)
    yield from places.items()


class Nearby:
    """The terms that share a shortened form with a word.

    Two words within k edits of each other become equal by leaving out up to k signs of each.  Kept are sorted
    hashes of the terms' forms, for each number of edits, and a field of bits that settles most questions.
    """

    def __init__(self, terms: list[str], limits: list[int]):
        self.fields = []
        for edits in sorted({n for n in limits if n}):
            of = np.flatnonzero(np.array(limits) == edits)
            names = [terms[i] for i in of]
            lengths = [*map(len, names)]
            hashes, owners = [], []
            for _, places in by_length(names, 0, max(lengths)):
                for made in forms([names[i] for i in places], edits):
                    hashes.append(made.ravel())
                    owners.append(np.tile(of[places], len(made)))
            known, owner = np.concatenate(hashes), np.concatenate(owners).astype(np.int32)
            order = np.argsort(known, kind="stable")
            bits = min(28, max(10, (256 * len(known)).bit_length()))
            place = known >> U(64 - bits)
            field = np.zeros(1 << bits - 3, np.uint8)
            np.bitwise_or.at(field, place >> U(3), np.left_shift(1, place & U(7), dtype=U).astype(np.uint8))
            self.fields.append((edits, min(lengths) - edits, max(lengths) + edits, U(64 - bits), field, known[order], owner[order]))

    def __call__(self, words: list[str]) -> dict[int, set[int]]:
        """For the place of each word near any term, those terms."""
        found: dict[int, set[int]] = collections.defaultdict(set)
        for edits, least, most, shift, field, known, owner in self.fields:
            for length, places in by_length(words, least, most):
                step = max(1, FORMS // sum(math.comb(length, n) for n in range(edits + 1)))
                for at in range(0, len(places), step):
                    part = places[at:at + step]
                    for made in forms([words[i] for i in part], edits):
                        place = made >> shift
                        bits = field[place >> U(3)] >> (place & U(7)).astype(np.uint8) & 1
                        way, word = np.nonzero(bits)
                        hashes = made[way, word]
                        first, behind = known.searchsorted(hashes), known.searchsorted(hashes, "right")
                        for n in np.flatnonzero(first < behind).tolist():
                            found[part[word[n]]].update(owner[first[n]:behind[n]].tolist())
        return found


class Matcher:
    """The matches of one automaton of all terms and stems, by smaller ones.

    The trie of all is walked without edits; a word that it does not match is asked of the automata of those
    terms only that share a shortened form with it, so that states stay few and small.
    """

    def __init__(self, terms: list[str], stems: list[str] = (), limits: list[int] | None = None):
        self.terms, self.limits = terms, [edits_for(t) for t in terms] if limits is None else limits
        self.plain = Automaton(terms, stems, [0] * len(terms))
        self.nearby = Nearby(terms, self.limits)
        self.whole, self.least = frozenset(terms), min(map(len, stems), default=0)
        self.starts = frozenset(s[:self.least] for s in stems)
        self.single: dict[int, Automaton] = {}
        self.entries = 0

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term within its edits, and the edits; ties to the first term; a stem before a term with edits."""
        return self.matches([word])[0]

    def matches(self, words: list[str]) -> list[tuple[int, int] | None]:
        """The match of each word; many at once take far less time each."""
        least, starts, whole = self.least, self.starts, self.whole
        best = [self.plain.match(w) if w[:least] in starts or w in whole else None for w in words]
        rest = [i for i, m in enumerate(best) if m is None]
        for place, terms in self.nearby([words[i] for i in rest]).items():
            best[rest[place]] = self._nearest(words[rest[place]], sorted(terms))
        return best

    def _nearest(self, word: str, terms: list[int]) -> tuple[int, int] | None:
        best = None
        for term in terms:
            if self.entries > ENTRIES:
                self.single.clear()
                self.entries = 0
            one = self.single.get(term)
            if one is None:
                one = self.single[term] = Automaton([self.terms[term]], (), [self.limits[term]])
                self.entries += one.entries
            before = one.entries
            found = one.match(word)
            self.entries += one.entries - before
            if found and (best is None or found[1] < best[1]):
                best = term, found[1]
        return best


class Counts(NamedTuple):
    """Documents of each label, and how often each term stands in them."""

    toxic: int
    others: int
    terms: tuple[tuple[int, int] | None, ...]

    def evidence(self, term: int, label: int | None = None) -> float:
        """Log odds of a term; ``label`` is that of the document it is asked for, which then does not count itself."""
        counts = self.terms[term]
        if counts is None:
            return GIVEN
        bad, good = counts
        toxic, others = self.toxic, self.others
        if label is not None:
            bad, toxic, good, others = (bad - label, toxic - label, good - (1 - label), others - (1 - label))
        return float(np.log((max(bad, 0) + 0.5) / (toxic + 1)) - np.log((max(good, 0) + 0.5) / (others + 1)))


class Lexicon(dict):
    """word -> (term, edits) or None, remembering words; ``ordinary`` are words that only look like terms."""

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset(), stems: list[str] = (), limits: list[int] | None = None,
                 counts: Counts | None = None):
        super().__init__()
        self.automaton, self.ordinary, self.size = Matcher(terms, stems, limits), ordinary, 0
        self.counts = counts or Counts(0, 0, (None,) * (len(terms) + len(stems)))

    def matches(self, words: Iterable[str]) -> dict[str, tuple[int, int]]:
        """Those of the (different) words that match, each with its term and edits."""
        found, unknown = {}, []
        for word in words:
            if word not in self:
                unknown.append(word)
            elif (match := self[word]) is not None:
                found[word] = match
        cores = [w.strip(EDGES) for w in unknown]
        new = self.automaton.matches(cores)
        odd = [i for i, m in enumerate(new) if m is None and not cores[i].isalpha()]
        for i, match in zip(odd, self.automaton.matches([cores[i].translate(LEET) for i in odd]), strict=True):
            new[i] = match and (match[0], max(1, match[1]))
        for word, core, match in zip(unknown, cores, new, strict=True):
            if match and (not core or match[1] and core in self.ordinary):
                match = None
            if match:
                found[word] = match
            # The sizes of the objects, roughly.
            size = 160 + 2 * len(word)
            if size < 1000:
                if self.size > MEMORY:
                    self.clear()
                    self.size = 0
                self.size += size
                self[word] = match
        return found


def mentioned(words: list[str], at: int) -> bool:
    """Whether the word is reported rather than said: in quotation marks, or near a reporting word."""
    if words[at][0] in QUOTES and words[at].rstrip(".,;:!?")[-1:] in QUOTES:
        return True
    near = [w.strip(EDGES) for w in words[max(0, at - AROUND):at]]
    return any(w in REPORTING for w in near) and not any(w in ADDRESS for w in near)


def features(text: str | None, lexicon: Lexicon, label: int | None = None) -> tuple[float, ...]:
    """The sums of FEATURES over a whole text; counts are damped by logarithms, the terms' log odds are added up."""
    return next(features_of([text], lexicon, [label]))


def features_of(texts: list[str | None], lexicon: Lexicon, labels: list[int | None]) -> Iterator[tuple[float, ...]]:
    """The features of each text.  The words of BLOCK signs of texts, or of one longer text, are matched at once."""
    size, block = 0, []
    for text, label in zip(texts, labels, strict=True):
        block.append(((text or "").lower().split(), label))
        size += len(text or "")
        if size >= BLOCK:
            yield from _sums(block, lexicon)
            size, block = 0, []
    yield from _sums(block, lexicon)


def _sums(block: list[tuple[list[str], int | None]], lexicon: Lexicon) -> Iterator[tuple[float, ...]]:
    found = lexicon.matches(set().union(*(words for words, _ in block)))
    for words, label in block:
        sums, terms = [0, 0, 0, 0, 0], set()
        for i, (term, edits) in [(i, found[w]) for i, w in enumerate(words) if w in found]:
            if mentioned(words, i):
                sums[2] += 1
                continue
            sums[1 if edits else 0] += 1
            terms.add(term)
            sums[4] += any(w.strip(EDGES) in ADDRESS for w in words[max(0, i - AROUND):i + AROUND + 1])
        sums[3] = len(terms)
        yield (*(float(np.log1p(x)) for x in sums), sum(lexicon.counts.evidence(t, label) for t in sorted(terms)))


def fit(rows: np.ndarray, labels: np.ndarray, shares: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Weights of the most likely logistic model under the prior, by Newton's method; rows count by their ``shares``."""
    x = np.column_stack((np.ones(len(rows)), rows)) if len(rows) else np.zeros((0, len(PRIOR)))
    shares = np.ones(len(rows)) if shares is None else shares
    weights = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (shares * (p - labels)) + STRENGTH * (weights - PRIOR)
        curve = (x * (shares * p * (1 - p))[:, None]).T @ x + STRENGTH * np.eye(len(PRIOR))
        move = np.linalg.solve(curve, slope)
        # Halved steps far from the goal keep the method from leaping past it.
        weights -= move * min(1.0, 2.0 / np.abs(move).max(initial=1e-30))
        if np.abs(move).max() < 1e-10:
            break
    return weights


class ToxicityModel(NamedTuple):
    terms: list[str]
    ordinary: frozenset[str]
    stems: list[str]
    limits: list[int]
    counts: Counts
    weights: np.ndarray

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.ordinary, self.stems, self.limits, self.counts)


def _held_lexicon(model: ToxicityModel) -> Callable[[], Lexicon]:
    """Gives each worker the lexicon of a model, made once for all its tasks."""
    name = uuid.uuid4().hex
    return lambda: held((Lexicon, name), model.lexicon)


def _features(docs: DataFrame, model: ToxicityModel, label: str | None = None) -> DataFrame:
    """The features of each text; with ``label``, those of a document that does not count itself, and its label."""
    kept = ["doc_id", *([label] if label else [])]
    lexicon = _held_lexicon(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = lexicon()
        (texts,) = columns_of(batch, "text")
        rows = features_of(texts, of, columns_of(batch, label)[0] if label else [None] * len(texts))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept),
                                          *(pa.array(c, pa.float64()) for c in zip(*rows, strict=True))], [*kept, *FEATURES])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"{n} double" for n in FEATURES]
    return arrow_map(docs.select(*kept, "text"), run, ", ".join(fields))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks, stored.

    Up to SENT_LABELS marks are sent to the texts; of more, the texts are sent to their marks, once.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    few = marks.count() <= SENT_LABELS
    return cut(docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, "doc_id"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, and the toxic (bad) and other (good) documents of ``rows`` that hold it."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), "\\s+"), lambda w: F.btrim(w, F.lit(EDGES))))
    return (rows.select("toxic", F.explode(words).alias("word")).filter("word <> ''").groupBy("word")
            .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))


def telling_nodes(counts: DataFrame, toxic: int, others: int, most: int) -> list:
    """Words and beginnings of words (node, whole, bad, good) that tell toxic documents from others, ``most`` at most.

    The counts of a beginning are those of the words that it begins.  Of more nodes than ``most`` those of the
    highest likelihood ratio are taken.
    """
    word, (least, longest) = F.col("word"), STEM
    begins = F.when(F.length(word) >= least, F.transform(
        F.sequence(F.lit(least), F.least(F.length(word), F.lit(longest))), lambda k: F.struct(word.substr(F.lit(1), k).alias("node"), F.lit(False).alias("whole"))))
    whole = F.array(F.struct(word.alias("node"), F.lit(True).alias("whole")))
    worded = counts.filter((F.length(word) <= LONGEST) & word.rlike("^\\p{L}{3,}$"))
    nodes = (worded.select("bad", "good", F.explode(F.concat(whole, F.coalesce(begins, F.array()))).alias("x")).groupBy("x.node", "x.whole")
             .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    bad, good, share = F.col("bad"), F.col("good"), toxic / max(1, toxic + others)

    def part(n, of: float):
        return F.when(n > 0, n * F.log(n / ((bad + good) * of))).otherwise(0.0)

    beyond = 2 * (part(bad, max(share, 1e-12)) + part(good, max(1 - share, 1e-12)))
    passed = nodes.filter((bad >= LEAST_TOXIC) & (bad * F.lit(others) >= F.lit(RATIO * toxic) * good)).withColumn("beyond", beyond)
    passed = cut(passed.filter(F.col("beyond") > BEYOND_CHANCE).withColumn("bin", F.floor(F.log2("beyond") * 16)))
    return passed.filter(F.col("bin") >= least_bin(passed, "bin", most)).select("node", "whole", "bad", "good").collect()


def chosen(nodes: list, toxic: int, others: int) -> tuple[dict[str, tuple[int, int]], dict[str, tuple[int, int]]]:
    """Terms and stems with their counts: of a chain of equal counts the longest, below a term only what is clearer."""
    counts = {(r["node"], r["whole"]): (r["bad"], r["good"]) for r in nodes}

    def odds(at: tuple[int, int]) -> float:
        return Counts(toxic, others, (at,)).evidence(0)

    by_parent = {(n if w else n[:-1], c) for (n, w), c in counts.items()}
    terms, stems = {}, {}
    for (node, whole), c in sorted(counts.items(), key=lambda x: (len(x[0][0]), x[0])):
        if not whole and (node, c) in by_parent:
            continue
        above = [odds(stems[node[:k]]) for k in range(STEM[0], len(node) + whole) if node[:k] in stems]
        if not above or odds(c) > max(above) + CLEARER:
            (terms if whole else stems)[node] = c
    return terms, stems


def train(labelled: DataFrame, most_rows: int = 4000, most_terms: int = 8000, most_ordinary: int = 20_000,
          seeds: tuple[str, ...] = SEED_TERMS) -> ToxicityModel:
    """A model from labelled rows (doc_id, text, toxic; read several times, so they should be stored): the lexicon from all, the weights from about ``most_rows``.

    Terms are the words and stems of :func:`telling_nodes` (``most_terms`` nodes at most) and ``seeds``.  Words that
    match a term only with edits but stand in other documents are ordinary: the ``most_ordinary`` most
    frequent are listed, and a term near any further one is matched with fewer edits.  Rows of the sample are
    chosen by a hash of the id, as many of each label, and weighed to stand for all.  Without labels the
    seeds and the prior alone decide.  Rows with a null label or id teach nothing.
    """
    reachable(labelled.sparkSession)
    rows = labelled.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("long").alias("toxic"))
    of_label = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, others = of_label.get(1, 0), of_label.get(0, 0)
    counts = cut(word_counts(rows))
    told, stems = chosen(telling_nodes(counts, toxic, others, most_terms) if toxic and others else [], toxic, others)
    terms = sorted({*told, *seeds})
    known = Counts(toxic, others, (*(told.get(t) for t in terms), *stems.values()))
    model = ToxicityModel(terms, frozenset(), list(stems), [edits_for(t) for t in terms], known, PRIOR)
    model = _without_ordinary(model, counts, most_ordinary)
    half = max(1, most_rows // 2)
    chance = F.pmod(F.xxhash64("doc_id"), F.when(F.col("toxic") == 1, max(toxic, 1)).otherwise(max(others, 1)))
    sample = _features(rows.filter(chance < half), model, "toxic").orderBy("doc_id", *FEATURES).toPandas()
    labels = sample["toxic"].to_numpy(float)
    kept = {1: max(1, (labels == 1).sum()), 0: max(1, (labels == 0).sum())}
    shares = np.where(labels == 1, toxic / kept[1], others / kept[0]) * (len(sample) / max(1, toxic + others))
    return model._replace(weights=fit(sample[list(FEATURES)].to_numpy(float), labels, shares))


def _without_ordinary(model: ToxicityModel, counts: DataFrame, most: int) -> ToxicityModel:
    """The model with its ordinary words, and with fewer edits for terms near ordinary words that are not listed."""
    lexicon = _held_lexicon(model)

    def resembling(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lookup = lexicon()
        words, bad, good = columns_of(batch, "word", "bad", "good")
        common = {w: g for w, b, g in zip(words, bad, good, strict=True) if b * model.counts.others < RATIO * g * model.counts.toxic}
        near = [(w, *m, common[w]) for w, m in lookup.matches(common).items() if m[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*near)) or [[]] * 4, NEAR.values(), strict=True)], list(NEAR))

    near = cut(arrow_map(counts, resembling, "word string, term int, edits int, good long").withColumn("bin", F.floor(F.log2("good") * 8)))
    least = least_bin(near, "bin", most)
    listed = frozenset(r["word"] for r in near.filter(F.col("bin") >= least).select("word").collect())
    limits = list(model.limits)
    for term, edits in near.filter(F.col("bin") < least).select("term", "edits").distinct().collect():
        limits[term] = min(limits[term], edits - 1)
    return model._replace(ordinary=listed - {*model.terms}, limits=limits)


NEAR = {"word": pa.string(), "term": pa.int32(), "edits": pa.int32(), "good": pa.int64()}


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.7 on) of every whole text.

    A null or empty text has no match and gets the score of the constant alone; equal texts get
    equal scores; extra columns are not read.
    """
    weights = model.weights.tolist()
    total = F.lit(weights[0])
    for name, weight in zip(FEATURES, weights[1:], strict=True):
        total = total + F.col(name) * weight
    scored = _features(docs, model).select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def held_out():
    """Documents whose labels training must not see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
