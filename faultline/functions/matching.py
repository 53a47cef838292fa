"""All matches of a regular expression with their line numbers, as one column.

Spark finds all matches of a pattern but not where they are.  Replacing every
match by a mark and itself puts the mark into the line where the match starts,
so the marked text split into lines tells both.  The mark contains a digest of
the text, so no text can contain its own mark.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.literals import owners_in
from faultline.functions.text import strip
from faultline.seeds import Rule

# What Python means by a blank and by a word character, for Java.
# The flag makes the dot stop at \n only.
DOT = "(?d)"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# a class of word characters, as written in a pattern
WORD_CLASS = r"\[(?:[A-Za-z0-9_](?:-[A-Za-z0-9])?)+\]"
# for a pattern with such classes inside brackets
UNICODE = "(?U)"
IGNORE_CASE = "(?iu)"
# letters that equal s or i when case is ignored but do not lower-case to them
ODD_CASES = ("\u017f", "\u0130", "\u0131")

HITS = "array<struct<rule_id:string,rule_ord:int,line:int,hits:int,snippet:string>>"


def java_regex(rule: Rule) -> str:
    """The rule's pattern so that Java matches what Python would.

    A word at the start is tried before its boundary, because Java looks for
    literal text much faster; a boundary next to word characters only has to
    look at its other side.
    """
    flags = DOT + (IGNORE_CASE if rule.ignore_case else "")
    if re.search(r"\[[^\]]*\\[bsw]", rule.regex):
        return flags + UNICODE + rule.regex
    regex = re.sub(
        rf"([A-Za-z0-9_]|{WORD_CLASS}(?:\{{\d+\}})?)\\b$", lambda end: f"{end[1]}(?!{WORD})", rule.regex)
    regex = re.sub(
        rf"^\\b([A-Za-z]+(?![*+?{{])|{WORD_CLASS}\{{\d+\}})",
        lambda start: f"{start[1]}(?<!{WORD}{start[1]})", regex)
    for short, full in ((r"\s", SPACE), (r"\w", WORD), (r"\b", BOUNDARY)):
        regex = regex.replace(short, full)
    return flags + regex


def rule_book(rules: Sequence[Rule]) -> Column:
    """All rules as one constant; a rule's place in it is its ordinal."""
    rows = [{"rule_id": r.rule_id, "rule_ord": i, "lang": r.lang, "regex": java_regex(r)} for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,rule_ord:int,lang:string,regex:string>>")


def worth_searching(text: Column, lowered: Column, rules: Mapping[int, Rule]) -> Column:
    """Ordinals of all rules but those the text cannot match.  ``lowered`` is the text in lower case.

    All hints are looked for in one pass over the text and one over its lower-cased form.
    """
    hinted = {False: defaultdict(list), True: defaultdict(list)}
    for i, rule in rules.items():
        for hint in rule.hints:
            hinted[rule.ignore_case][hint].append(i)
    always = [i for i, rule in rules.items() if not rule.hints]
    ordinals = [F.lit(always).cast("array<int>"), owners_in(text, hinted[False], "int")]
    if hinted[True]:
        odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ODD_CASES])
        every = F.lit(sorted({i for found in hinted[True].values() for i in found})).cast("array<int>")
        ordinals.append(F.when(odd, every).otherwise(owners_in(lowered, hinted[True], "int")))
    return F.array_distinct(F.concat(*ordinals))


def mark_of(text: Column) -> Column:
    """A string that the text does not contain."""
    return F.concat(F.lit("\uffff"), F.substring(F.sha2(text, 256), 1, 24))


def line_hits(text: Column, mark: Column, rules: Column) -> Column:
    """Lines in which matches of the ``rules`` (entries of the book) start, with their number and the stripped line.

    The work is linear in the text for each rule, whatever the number of matches, and
    only one marked copy of the text is held at a time.  ``mark`` should be a computed column,
    as every line looks at it.
    """
    def of_rule(rule: Column) -> Column:
        found = F.regexp_replace(text, rule["regex"], F.concat(mark, F.lit("$0")))
        return F.flatten(F.transform(F.array(found), lambda marked: F.when(
            F.contains(marked, mark), of_marked(rule, marked)).otherwise(F.array().cast(HITS))))

    def of_marked(rule: Column, marked: Column) -> Column:
        lines = F.transform(F.split(marked, "\n", -1), lambda line, i: F.struct(
            (i + 1).alias("line"), line.alias("text")))
        return F.transform(F.filter(lines, lambda x: F.contains(x["text"], mark)), lambda x: F.struct(
            rule["rule_id"].alias("rule_id"), rule["rule_ord"].alias("rule_ord"), x["line"].alias("line"),
            (F.size(F.split(x["text"], mark, -1)) - 1).alias("hits"),
            strip(F.replace(x["text"], mark, F.lit(""))).alias("snippet")))

    return F.flatten(F.transform(rules, of_rule))
