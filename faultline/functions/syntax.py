"""Two checks on Python source that look at statements rather than at words.

A text is cut into tokens by one expression; a fold over them carries strings, comments, brackets, indents
and the outline of the statement it stands in, and notes the statements that matter.  Nothing inside
comments and strings counts, and a text with an open string or bracket, which does not parse, has no hits.
An outline holds a statement's words and signs; strings are ``S`` or, with placed values, ``F``, and what
stands in brackets is left out, but for brackets around a whole value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.matching import HITS, WORD
from faultline.functions.text import strip
from faultline.seeds import SUPPRESSION_RULE, TAINT_RULE, Rule

TAINT, SUPPRESSION = TAINT_RULE, SUPPRESSION_RULE

# String prefixes and quotes, comments, joined lines, line ends with the indent behind them,
# words and numbers, assignments that are no plain ones, and any other sign.
_STRING = (
    r'(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""' r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"' r"|'(?:[^'\\\n]++|\\[\s\S])*+')")
TOKEN = rf"#[^\n]*+|\\\n|{_STRING}|\n[ \t\f]*+|{WORD}++|(?:\*\*|//|<<|>>|[-+*/%@&|^<>!=:])=|[^\s]"

# {name}, {name!r}, {name:>{width}}, {name=}
PLACED_NAME = rf"\{{\s*({WORD}+)\s*=?\s*(?:![rsa])?(?::(?:[^{{}}]|\{{[^{{}}]*\}})*)?\}}"

# Outlines: name = request.<part>.<call>(), any number of names; return of strings alone; what a colon ends.
REQUEST_VALUE = rf"^(?:{WORD}+ = )+(?:\( )*request \. (?:args|form|values|json) \. {WORD}+ \( \)(?: \))*$"
RETURNED_TEXT = r"^return (?:\( )*[SF](?: [SF])*(?: \))*$"
HEADER = r"^(?:if|elif|else|for|while|try|except|finally|with|def|class|async|match|case)(?: |$)"
#: A longer outline is none of these.
LONGEST = 4096

_NOTES = "array<struct<kind:string,line:int,names:array<string>>>"


def _tokens(text: Column) -> Column:
    """Kind, text and line ends of every token but comments; a line end is put at both ends of the text.

    Kinds: n line end, j joined line, s and f strings, ( and ) brackets of any form, e what opens a
    string that never ends, and w for the rest.
    """
    found = F.regexp_extract_all(F.concat(F.lit("\n"), text, F.lit("\n")), F.lit(TOKEN), F.lit(0))

    def described(t: Column) -> Column:
        quoted = (F.length(t) > 1) & F.right(t, F.lit(1)).isin("'", '"')
        kind = (
            F.when(t.startswith("\n"), "n").when(t == "\\\n", "j")
            .when(quoted, F.when(F.regexp_like(t, F.lit("^[rR]?[fF]")), "f").otherwise("s"))
            .when(t.isin("(", "[", "{"), "(").when(t.isin(")", "]", "}"), ")").when(t.isin("'", '"'), "e").otherwise("w"))
        return F.struct(kind.alias("kind"), t.alias("text"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("ends"))

    return F.transform(F.filter(found, lambda t: ~t.startswith("#")), described)


def _start() -> Column:
    """Before the first token: no line, no bracket, no statement, no open handler, nothing noted."""
    fields = {
        "line": F.lit(0), "depth": F.lit(0), "plain": F.lit(0), "sound": F.lit(True), "outline": F.lit(""), "at": F.lit(0),
        "indent": F.lit(0), "inline": F.lit(False), "texts": F.array().cast("array<string>"), "handler": F.lit(0),
        "handler_indent": F.lit(0), "passes": F.lit(False), "notes": F.array().cast(_NOTES)}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _step(state: Column, token: Column) -> Column:
    """The state after one more token.

    ``plain`` of the ``depth`` open brackets stand around a whole value.  ``handler`` is the line of a bare
    except whose body, so far of ``pass`` alone, may go on.
    """
    kind, text, outline, depth, plain = token["kind"], token["text"], state["outline"], state["depth"], state["plain"]
    top = depth == 0
    header = top & (kind == "w") & (text == ":") & F.regexp_like(outline, F.lit(HEADER))
    ends = (top & ((kind == "n") | (kind == "w") & (text == ";"))) | header
    done = ends & (outline != "")
    bare = header & (outline == "except")

    body = state["inline"] | (state["indent"] > state["handler_indent"])
    inside = done & (state["handler"] > 0) & body
    closed = done & (state["handler"] > 0) & ~body & state["passes"]

    around = (kind == "(") & (text == "(") & (depth == plain) & F.regexp_like(outline, F.lit(r"(?:^return|=)(?: \()*$"))
    shown = F.when(kind == "s", "S").when(kind == "f", "F").otherwise(text)
    grows = ~ends & kind.isin("w", "s", "f", "(", ")") & ((depth == plain) | (kind == ")") & (depth == plain + 1))
    # Strings behind each other are one.
    again = kind.isin("s", "f") & F.endswith(outline, F.concat(F.lit(" "), shown))
    grown = F.when(again | (F.length(outline) > LONGEST), outline).when(outline == "", shown).otherwise(F.concat(outline, F.lit(" "), shown))

    def note(name: str, line: Column, names: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("kind"), line.alias("line"), names.alias("names"))).cast(_NOTES)

    none = F.array().cast("array<string>")
    told = F.when(
        done & F.regexp_like(outline, F.lit(REQUEST_VALUE)),
        note("value", state["at"], F.regexp_extract_all(outline, F.lit(rf"({WORD}+) = "), F.lit(1)))).when(
        done & (F.size(state["texts"]) > 0) & F.regexp_like(outline, F.lit(RETURNED_TEXT)), note("returned", state["at"], state["texts"]))
    silent = F.when(closed, note("silent", state["handler"], none))
    notes = F.when(told.isNull() & silent.isNull(), state["notes"]).otherwise(
        F.concat(state["notes"], F.coalesce(silent, F.array().cast(_NOTES)), F.coalesce(told, F.array().cast(_NOTES))))

    line_end = (kind == "n") & top
    handler = F.when(bare, state["at"]).when(inside & (outline == "pass"), state["handler"]).when(done, 0).otherwise(state["handler"])
    fields = {
        "line": state["line"] + token["ends"],
        "depth": F.when(kind == "(", depth + 1).when(kind == ")", depth - 1).otherwise(depth),
        "plain": F.when(line_end, 0).when(around, plain + 1).when((kind == ")") & (depth == plain) & (plain > 0), plain - 1).otherwise(plain),
        "sound": state["sound"] & (kind != "e") & ~((kind == ")") & top),
        "outline": F.when(ends, "").when(grows, grown).otherwise(outline),
        "at": F.when(grows & (outline == ""), state["line"]).otherwise(state["at"]),
        "indent": F.when(line_end, F.length(text) - 1).otherwise(state["indent"]),
        "inline": F.when(line_end, False).when(bare, True).otherwise(state["inline"]),
        "texts": F.when(ends, none).when(grows & (kind == "f") & F.startswith(outline, F.lit("return")), F.concat(state["texts"], F.array(text)))
        .otherwise(state["texts"]),
        "handler": handler,
        "handler_indent": F.when(bare, state["indent"]).otherwise(state["handler_indent"]),
        "passes": F.when(bare, False).when(inside, outline == "pass").otherwise(state["passes"]),
        "notes": notes}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _finish(state: Column) -> Column:
    last = F.when((state["handler"] > 0) & state["passes"], F.array(F.struct(
        F.lit("silent").alias("kind"), state["handler"].alias("line"), F.array().cast("array<string>").alias("names"))).cast(_NOTES))
    return F.when(state["sound"] & (state["depth"] == 0), F.concat(state["notes"], F.coalesce(last, F.array().cast(_NOTES))))


def statements(text: Column) -> Column:
    """The statements of a text that the checks look at, with their lines; null where there are none to look at."""
    values = F.contains(text, F.lit("request")) & F.contains(text, F.lit("return"))
    handlers = F.regexp_like(text, F.lit(r"except[ \t]*:|except[ \t]*\\"))
    return F.when(values | handlers, F.aggregate(_tokens(text), _start(), _step, _finish))


def placed_names(literal: Column) -> Column:
    """Names that a formatted string places as they are."""
    # Doubled brackets are signs of the text, unless the second ends a width.
    return F.filter(F.regexp_extract_all(literal, F.lit(r"\{\{|" + PLACED_NAME + r"|\}\}"), F.lit(1)), lambda name: name != "")


def statement_hits(noted: Column, text: Column, rules: Sequence[Rule]) -> Column:
    """Hits of those of the two checks that are among ``rules``: returned request values, silent handlers."""
    values = F.flatten(F.transform(F.filter(noted, lambda s: s["kind"] == "value"), lambda s: s["names"]))
    lines = F.split(text, "\n", -1)
    kinds = {
        TAINT: lambda s: (s["kind"] == "returned") & F.exists(s["names"], lambda t: F.arrays_overlap(placed_names(t), values)),
        SUPPRESSION: lambda s: s["kind"] == "silent"}

    def rows(rule: Rule) -> Column:
        at = F.transform(F.filter(noted, kinds[rule]), lambda s: s["line"])
        return F.transform(F.array_sort(F.array_distinct(at)), lambda line: F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(list(rules).index(rule)).alias("rule_ord"), line.alias("line"),
            F.size(F.filter(at, lambda x: x == line)).alias("hits"), strip(F.get(lines, line - 1)).alias("snippet")))

    found = [rows(rule) for rule in kinds if rule in rules]
    return F.coalesce(F.when(F.size(noted) > 0, F.concat(*found).cast(HITS)), F.array().cast(HITS))
