"""Declared dependency versions as comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import WHITESPACE, blank_to_null

# Requirement line, npm range prefix, and comparable version forms.
REQUIREMENT = r"^([A-Za-z0-9_.\-]+)\s*(==|>=|<=|~=|>|<)?\s*([0-9][A-Za-z0-9_.\-]*)?"
NPM_PREFIX = r"^[~^>=<\s]+"
RELEASE = r"(?i)^v?\d+(\.\d+)*([._-]?(post|rev|r)[._-]?\d*|-\d+)?(\+[a-z0-9]+([._-][a-z0-9]+)*)?$"


def requirement_name(line: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(line, REQUIREMENT, 1)))


def requirement_version(line: Column) -> Column:
    """The version token whatever operator stands before it."""
    return blank_to_null(F.regexp_extract(line, REQUIREMENT, 3))


def npm_version(declared: Column) -> Column:
    return blank_to_null(F.regexp_replace(declared, NPM_PREFIX, ""))


def release_key(version: Column) -> Column:
    """Release numbers without trailing zeros, ordered as arrays.

    Null for pre-releases and for anything that is not a version, so that a
    comparison with it is never true.
    """
    plain = F.trim(version, F.lit(WHITESPACE))
    digits = F.regexp_extract(plain, r"^[vV]?(\d+(?:\.\d+)*)", 1)
    numbers = F.transform(F.split(digits, r"\."), lambda n: n.try_cast("decimal(38,0)"))
    shortened = F.split(F.regexp_replace(digits, r"(\.0+)+$", ""), r"\.")
    key = F.slice(numbers, 1, F.size(shortened))
    usable = plain.rlike(RELEASE) & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(usable, key)


def is_below(version: Column, bound: Column) -> Column:
    """Whether ``version`` is certainly lower than ``bound``."""
    return F.coalesce(release_key(version) < release_key(bound), F.lit(False))


# The public grammar of versions (epoch, release, pre-release, post-release, development
# release, local part) and of the clauses of a specifier.
VERSION = (
    r"(?i)^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$")
CLAUSE = r"(?s)^\s*(~=|===|==|!=|<=|>=|<|>)\s*(.+?)\s*$"

# All parts of a version in one pass; none of them holds the sign between them.
_PARTS = "/".join(f"${i}" for i in range(1, 11)) + "/"

_NUMBER = "decimal(38,0)"
# Ranks of what stands behind a release: a development release alone comes before any pre-release.
_BEFORE_PRE, _PRE_RANKS, _NO_PRE = 0, {"a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "rc": 3, "pre": 3, "preview": 3}, 4


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0).cast(_NUMBER)).otherwise(digits.try_cast(_NUMBER))


def _numbers(digits: Column) -> Column:
    return F.transform(F.split(digits, r"\."), lambda n: n.try_cast(_NUMBER))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def version_key(version: Column) -> Column:
    """A struct that orders versions of every form as they are meant; null for what is none.

    ``given`` are the release numbers as written; they come last and take no part in comparisons by :func:`order_of`.
    """
    return _once(F.trim(version, F.lit(WHITESPACE)), lambda plain: F.when(plain.rlike(VERSION), _once(
        F.split(F.regexp_replace(plain, VERSION, _PARTS), "/"), lambda parts: _once(_numbers(F.get(parts, F.lit(1))), lambda given: _key_of(parts, given)))))


def _key_of(parts: Column, given: Column) -> Column:
    """The key of a version from its parts and its release numbers; null if a number is too long."""
    def part(i: int) -> Column:
        return F.get(parts, F.lit(i - 1))

    pre = F.lower(part(3))
    has_post, has_dev = (part(5) != "") | (part(6) != ""), part(8) != ""
    stripped = F.slice(given, 1, F.size(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\.")))
    pre_rank = F.when((pre == "") & ~has_post & has_dev, _BEFORE_PRE).when(pre == "", _NO_PRE)
    for letters, rank in _PRE_RANKS.items():
        pre_rank = pre_rank.when(pre == letters, rank)
    local = F.transform(F.filter(F.split(F.lower(part(10)), "[-_.]"), lambda x: x != ""), lambda x: F.struct(
        x.rlike(r"^\d+$").cast("int").alias("counts"), F.when(x.rlike(r"^\d+$"), x.try_cast(_NUMBER)).otherwise(F.lit(0).cast(_NUMBER)).alias("number"),
        F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("letters")))
    key = F.struct(
        _number(part(1)).alias("epoch"), stripped.alias("release"), pre_rank.alias("pre"), _number(part(4)).alias("pre_number"),
        F.when(has_post, _number(F.concat(part(5), part(7)))).otherwise(F.lit(-1).cast(_NUMBER)).alias("post"),
        (~has_dev).cast("int").alias("final"), _number(part(9)).alias("dev_number"), local.alias("local"), given.alias("given"))
    numbers = F.concat(given, F.array(*[_number(part(i)) for i in (1, 4, 5, 7, 9)]))
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), key)


def order_of(key: Column, local: bool = True) -> Column:
    """What two keys are compared by, with or without the local part."""
    return key.dropFields("given") if local else key.dropFields("given", "local")


def _is_pre(key: Column) -> Column:
    return key["pre"].between(1, 3) | (key["final"] == 0)


def _same_base(a: Column, b: Column) -> Column:
    return (a["epoch"] == b["epoch"]) & (a["release"] == b["release"])


def _begins(key: Column, epoch: Column, numbers: Column) -> Column:
    """Whether the release numbers, with zeros behind them, begin with ``numbers``."""
    long = F.concat(key["given"], F.array_repeat(F.lit(0).cast(_NUMBER), F.size(numbers)))
    return (key["epoch"] == epoch) & (F.slice(long, 1, F.size(numbers)) == numbers)


def clauses(specifier: Column) -> Column:
    """The clauses of a specifier such as ``>=1.2,<2,!=1.5.*``; null if one of them is none, empty if there are none."""
    written = F.filter(F.split(specifier, ","), lambda c: F.trim(c, F.lit(WHITESPACE)) != "")

    def parsed(sign: Column, text: Column) -> Column:
        wild = sign.isin("==", "!=") & text.endswith(".*")
        return F.struct(sign.alias("sign"), text.alias("text"), wild.alias("wild"),
                        version_key(F.when(wild, F.regexp_replace(text, r"\.\*$", "")).otherwise(text)).alias("key"))

    found = F.transform(written, lambda clause: _once(
        F.struct(F.regexp_extract(clause, CLAUSE, 1).alias("sign"), F.regexp_extract(clause, CLAUSE, 2).alias("text")), lambda c: parsed(c["sign"], c["text"])))

    def usable(c: Column) -> Column:
        return (c["sign"] == "===") | c["key"].isNotNull() & (
            (c["sign"] != "~=") | (F.size(c["key"]["given"]) > 1)) & (~c["wild"] | (c["key"]["final"] == 1) & (F.size(c["key"]["local"]) == 0))

    return _once(found, lambda found: F.when(F.forall(found, usable), found))


def normal_text(key: Column) -> Column:
    """A version as it is written in its plainest form."""
    pre = F.concat(F.get(F.array(*map(F.lit, ("a", "b", "rc"))), key["pre"] - 1), key["pre_number"].cast("string"))
    local = F.transform(key["local"], lambda x: F.when(x["counts"] == 1, x["number"].cast("string")).otherwise(x["letters"]))
    return F.concat(
        F.when(key["epoch"] > 0, F.concat(key["epoch"].cast("string"), F.lit("!"))).otherwise(""),
        F.array_join(F.transform(key["given"], lambda n: n.cast("string")), "."), F.when(key["pre"].between(1, 3), pre).otherwise(""),
        F.when(key["post"] >= 0, F.concat(F.lit(".post"), key["post"].cast("string"))).otherwise(""),
        F.when(key["final"] == 0, F.concat(F.lit(".dev"), key["dev_number"].cast("string"))).otherwise(""),
        F.when(F.size(local) > 0, F.concat(F.lit("+"), F.array_join(local, "."))).otherwise(""))


def _fulfils(key: Column, clause: Column) -> Column:
    bound, sign = clause["key"], clause["sign"]
    public = order_of(key, local=False)
    at_least = public >= order_of(bound, local=False)
    # A clause without a local part does not look at one; a prefix may itself end in a pre- or post-release.
    plain_prefix = (bound["pre"] == _NO_PRE) & (bound["post"] == -1)
    equal = (
        F.when(clause["wild"] & plain_prefix, _begins(key, bound["epoch"], bound["given"]))
        .when(clause["wild"] | (F.size(bound["local"]) == 0), public == order_of(bound, local=False)).otherwise(order_of(key) == order_of(bound)))
    below = (order_of(key) < order_of(bound)) & ~(~_is_pre(bound) & _is_pre(key) & _same_base(key, bound))
    above = (order_of(key) > order_of(bound)) & ~(_same_base(key, bound) & (
        (bound["post"] == -1) & (key["post"] >= 0) | (F.size(key["local"]) > 0)))
    near = at_least & _begins(key, bound["epoch"], F.slice(bound["given"], 1, F.size(bound["given"]) - 1))
    return (
        F.when(sign == "===", normal_text(key) == F.lower(clause["text"])).when(sign == "==", equal).when(sign == "!=", ~equal)
        .when(sign == "<=", public <= order_of(bound, local=False)).when(sign == ">=", at_least)
        .when(sign == "<", below).when(sign == ">", above).otherwise(near))


def satisfies(key: Column, parsed: Column) -> Column:
    """Whether the version with this key fulfils all clauses; false for what is no version or no specifier.

    A pre-release does so only if a clause other than ``<``, ``>`` and ``!=`` names one.
    """
    def kept(key: Column, parsed: Column) -> Column:
        named = F.exists(parsed, lambda c: c["sign"].isin("==", "===", ">=", "<=", "~=") & F.coalesce(_is_pre(c["key"]), F.lit(False)))
        return key.isNotNull() & parsed.isNotNull() & (~_is_pre(key) | named) & F.forall(parsed, lambda c: _fulfils(key, c))

    return F.coalesce(_once(key, lambda key: _once(parsed, lambda parsed: kept(key, parsed))), F.lit(False))
