"""Surrogates for personal data: every entity is replaced by another of its type, format and script.

Entities are found by patterns.  Numbers are turned by a keyed permutation of all numbers of their length,
so different ones stay different; addresses, secrets and names are drawn by a keyed hash, letter for
letter of the same case and script, and names of the same gender.  An entity has one canonical form and so the
same surrogate everywhere.  A check over all entities of the corpus finds surrogates that two
entities share or that are themselves entities, and draws those again, longer each time, until there
are none; how often stays in a Spark table and is joined to the texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, columns_of, cut, unused

#: Given names by script and gender, and ends of drawn family names (plain lists).
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "f"): ("Alma", "Bianca", "Clara", "Diana", "Elena", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia", "Vera"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Павел"),
    ("cyrillic", "f"): ("Алла", "Вера", "Дарья", "Елена", "Инна", "Мария", "Нина", "Ольга"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "do", "fe", "gi", "ka", "lo", "mi", "na", "pe", "ro", "sa", "te", "ul", "vi", "wo", "ze"),
    "cyrillic": ("ба", "во", "ге", "ди", "жа", "зо", "ки", "ла", "мо", "не", "по", "ри", "са", "ту", "фо", "ше"),
    "greek": ("βα", "γο", "δε", "ζι", "θα", "κο", "λε", "μα", "νι", "πο", "ρα", "σε", "τι", "φο", "χα", "ψι"),
}
#: Forms of address that a name follows, by gender ("" says nothing about it).
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Mme", "Госпожа", "Κυρία"), "": ("Dr", "Prof")}
_TITLE = {t: g for g, titles in TITLES.items() for t in titles}

_SECRET = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)"
#: One pattern per type, tried in this order at each place; the group ``v`` is the entity.
PATTERNS = {
    # What no address follows is passed over as a whole, so the time is linear.
    "email": r"(?P<v>[\w.+%'-]++@[\w-]+(?:\.[\w-]+)+)|[\w.+%'-]++",
    "secret": rf"(?i:\b{_SECRET}\s*[:=]\s*[\"']?)(?P<v>[A-Za-z0-9_\-/+=.]{{6,}})",
    "key": r"(?<![A-Za-z0-9])(?P<v>[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)",
    "card": r"(?<![\w.-])(?P<v>\d(?:[ -]?\d){12,18})(?![\d-])",
    "phone": r"(?<![\w.])(?P<v>\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w|-\d)",
    "ssn": r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])",
    "name": rf"\b(?P<t>{'|'.join(sorted(_TITLE, key=len, reverse=True))})\b\.? (?P<v>[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*)?)",
}
_PATTERNS = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_DIGIT = re.compile("[0-9]")
FOUND = "text_hash long, kind string, canonical string"
DRAWN = "kind string, canonical string, surrogate string, attempt int"
#: Draws after which also numbers, which are permuted, get longer.
SAME_LENGTH = 4
#: Rows of texts with attempts up to which they are sent to every executor; beyond, shuffled.
SENT_TEXTS = 50_000


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, none overlapping: earlier kinds win."""
    numbers = _DIGIT.search(text) is not None
    # What a text must hold for an entity of a kind; numbers for those not named here.
    held = {"email": "@" in text, "secret": "=" in text or ":" in text, "name": any(t in text for t in _TITLE),
            "key": numbers or "AKIA" in text or "gh" in text and "_" in text or "sk-" in text or "xox" in text}
    taken: list[tuple[int, int, str, str]] = []  # in the order of places
    for kind, pattern in _PATTERNS.items():
        if not held.get(kind, numbers):
            continue
        for m in pattern.finditer(text):
            if m["v"] is None:
                continue
            start, end = m.span("v")
            value, gender = m["v"], ""
            if kind not in ("email", "name") and not value.isascii():
                continue
            if kind == "name":
                if not all(w[0].isupper() for w in value.split(" ")):
                    value = value.split(" ")[0]
                    end = start + len(value)
                if not value[0].isupper():
                    continue
                gender = _TITLE[m["t"]]
            if kind == "email":
                value = value.rstrip(".-")
                end = start + len(value)
            if not any(map(str.isalnum, value)):
                continue  # nothing to replace
            at = bisect_left(taken, (start,))
            if (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start):
                taken.insert(at, (start, end, kind, canonical(kind, value, gender)))
    return taken


def canonical(kind: str, value: str, gender: str = "") -> str:
    """The form that all spellings of one entity share."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if value[0] == "+" else "") + "".join(c for c in value if c.isdigit())
    if kind == "email":
        return value.lower()
    if kind == "iban":
        return value.replace(" ", "")
    return f"{gender}:{value}" if kind == "name" else value


class Stream:
    """Numbers drawn by a keyed hash of what they are for."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.left = key, "\0".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(b"%d:%s" % (self.block, self.seed), key=self.key).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return value % n


def permuted(number: int, left: int, right: int, key: bytes, *use: object) -> int:
    """A keyed permutation of the numbers below left * right (a Feistel network with changing halves)."""
    a, b = divmod(number, right)
    for turn in range(8):
        lot = hashlib.blake2b("\0".join(map(str, (*use, turn, b))).encode(), key=key, digest_size=8).digest()
        a, b, left, right = b, (a + int.from_bytes(lot, "little")) % left, right, left
    return a * right + b


def _digits(digits: str, key: bytes, kind: str, attempt: int) -> str:
    half = len(digits) // 2
    return str(permuted(int(digits), 10**half, 10 ** (len(digits) - half), key, kind, len(digits), attempt)).zfill(len(digits))


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    doubled = [int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(digits))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _letters(value: str, stream: Stream) -> str:
    """Every letter and digit replaced by one of its case and kind."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            letter = chr(97 + stream.below(26))
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def script_of(word: str) -> str:
    code = ord(word[0])
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else "latin"


def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate of a canonical form."""
    stream = Stream(key, kind, form, attempt)
    if kind in ("phone", "ssn"):
        more = "".join(str(stream.below(10)) for _ in range(attempt - SAME_LENGTH))
        return "+" * (form[0] == "+") + _digits(form.lstrip("+"), key, kind, attempt) + more
    if kind == "card":
        if luhn(form[:-1]) == int(form[-1]):
            body = _digits(form[:-1], key, "card with check", attempt)
            return body + str(luhn(body))
        value = _digits(form, key, kind, attempt)
        while luhn(value[:-1]) == int(value[-1]):  # stay among numbers without a right check digit
            value = _digits(value, key, kind, attempt)
        return value
    if kind == "ip":
        octets = [int(o) for o in form.split(".")]
        value, public = int.from_bytes(bytes(octets)), 0 < octets[0] < 224
        while True:
            value = permuted(value, 1 << 16, 1 << 16, key, kind, attempt)
            if (0 < value >> 24 < 224) == public:
                return ".".join(map(str, value.to_bytes(4)))
    if kind == "email":
        local, domain = form.split("@")
        labels = domain.split(".")
        of_domain = Stream(key, "domain", domain, attempt)
        return _letters(local + "x" * attempt, stream) + "@" + ".".join([*(_letters(x, of_domain) for x in labels[:-1]), labels[-1]])
    if kind in ("secret", "key"):
        if re.fullmatch("[0-9a-fA-F]+", form):
            case = str.upper if form.upper() == form else str.lower
            return case("".join("0123456789abcdef"[stream.below(16)] for _ in range(len(form) + attempt)))
        prefix = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-|", form)[0]
        return prefix + _letters(form[len(prefix):] + "x" * attempt, stream)
    if kind == "iban":
        return form[:2] + _letters(form[2:] + "0" * (attempt - SAME_LENGTH), stream)
    gender, name = form.split(":", 1)
    parts, out = name.split(" "), []
    for i, part in enumerate(parts):
        script = script_of(part)
        if i < len(parts) - 1:
            gender = gender or "mf"[stream.below(2)]
            out.append(GIVEN[script, gender][stream.below(len(GIVEN[script, gender]))])
        else:
            out.append("".join(SYLLABLES[script][stream.below(16)] for _ in range(4 + attempt)).capitalize())
    return f"{form.split(':', 1)[0]}:{' '.join(out)}"


def dressed(kind: str, form: str, like: str) -> str:
    """A canonical form in the format of the text it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(form.lstrip("+"))
        return "".join([*(next(signs) if c.isalnum() else c for c in like), *signs])
    if kind == "email":
        return "".join(c.upper() if like[i:i + 1].isupper() else c for i, c in enumerate(form)) if len(form) == len(like) else form
    return form.split(":", 1)[1] if kind == "name" else form


def found_in(docs: DataFrame) -> DataFrame:
    """The different entities of each text, by the text's hash."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(h, kind, form) for h, text in zip(*columns_of(batch, "text_hash", "text"), strict=True) if text
                for kind, form in sorted({(kind, form) for *_, kind, form in find(text)})]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.string(), pa.string()), strict=True)],
            ["text_hash", "kind", "canonical"])

    return arrow_map(docs.select(F.xxhash64("text").alias("text_hash"), "text"), run, FOUND)


def collisions(entities: DataFrame) -> DataFrame:
    """Entities whose surrogate another entity has too (all but one), or is an entity itself."""
    group = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical")
    shared = entities.withColumn("_n", F.row_number().over(group)).filter("_n > 1").select("kind", "canonical")
    real = entities.select("kind", F.col("canonical").alias("surrogate"))
    return shared.union(entities.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canonical")).distinct()


def drawn(found: DataFrame, key: bytes) -> DataFrame:
    """Every entity with its surrogate and the draws beyond the first it took, so that no two share one.

    Draws get longer with each attempt, so a free one is always to be had; all stays in Spark.
    """
    def draw(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kinds, forms, attempts = columns_of(batch, "kind", "canonical", "attempt")
        new = [surrogate(k, f, key, n) for k, f, n in zip(kinds, forms, attempts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((kinds, forms, new, attempts), (*[pa.string()] * 3, pa.int32()), strict=True)],
                                         ["kind", "canonical", "surrogate", "attempt"])

    entities = cut(arrow_map(found.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0)), draw, DRAWN))
    while (again := cut(collisions(entities))).count():
        marked = entities.join(again.withColumn("_again", F.lit(1)), ["kind", "canonical"], "left")
        moved = marked.filter("_again = 1").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        entities = cut(marked.filter("_again IS NULL").select("kind", "canonical", "surrogate", "attempt").union(arrow_map(moved, draw, DRAWN)))
    return entities


def attempts_needed(docs: DataFrame, key: bytes) -> dict[tuple[str, str], int]:
    """The attempts beyond the first, brought to the driver: for small tables only."""
    return {(r["kind"], r["canonical"]): r["attempt"] for r in drawn(found_in(docs), key).filter("attempt > 0").collect()}


def replacer(key: bytes, attempts: dict[tuple[str, str], int]) -> Callable[[str], tuple[str, int]]:
    def replace(text: str) -> tuple[str, int]:
        out, at, found = [], 0, find(text)
        for start, end, kind, form in found:
            new = surrogate(kind, form, key, attempts.get((kind, form), 0))
            out += [text[at:start], dressed(kind, new, text[start:end])]
            at = end
        return "".join([*out, text[at:]]) if found else text, len(found)

    return replace


def pseudonymised(docs: DataFrame, key: bytes = b"surrogates") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and their number per row in ``n_entities``.

    A null text stays null, texts without entities stay as they are, repeated rows get equal
    results, other columns are carried along (one named n_entities is replaced).
    """
    docs = docs.drop("n_entities")
    names = docs.columns
    place = names.index("text")
    schema = docs.withColumn("n_entities", F.lit(0).cast("long")).schema
    hash_name, drawn_again = unused("_text_hash", names), unused("_attempts", names)
    found = cut(found_in(docs))
    # One row per text with entities drawn again; two texts of one hash only get each other's too.
    again = cut(found.join(drawn(found, key).filter("attempt > 0"), ["kind", "canonical"])
                .groupBy("text_hash").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias(drawn_again)))
    n = again.count()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = columns_of(batch, "text")[0]
        known = columns_of(batch, drawn_again)[0] if n else [None] * len(texts)
        rows = [(None, 0) if t is None else replacer(key, {(a["kind"], a["canonical"]): a["attempt"] for a in of or ()})(t)
                for t, of in zip(texts, known, strict=True)]
        new = pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()) if i == place else batch.column(i) for i in range(len(names))], names)
        yield new.append_column("n_entities", pa.array([r[1] for r in rows], pa.int64()))

    if n:
        hashed = docs.withColumn(hash_name, F.xxhash64("text"))
        again = again.withColumnRenamed("text_hash", hash_name)
        joined = hashed.join(F.broadcast(again) if n <= SENT_TEXTS else again, hash_name, "left")
        docs = joined.select(*names, drawn_again)
    return arrow_map(docs, run, schema)
