"""Many literals looked for in one pass over a text.

The literals become one regular expression shaped like their tree of prefixes, tried at every
place of the text.  It yields the longest literal that stands there; the others that stand at
the same place are beginnings of it and known beforehand, so nothing is overlooked and the
size of the plan does not depend on the number of literals.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a literal that must stand alone may not touch.
JOINED = "[a-z0-9]"
ALONE_AFTER = f"(?!{JOINED})"
ALONE_BEFORE = f"(?<!{JOINED})"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in text)


def _branches(tree: dict, end: str) -> str:
    """The pattern of everything below a node, longer literals first."""
    found = []
    for first in sorted(c for c in tree if c):
        chain, node = first, tree[first]
        while len(node) == 1 and "" not in node:
            (char, node), = node.items()
            chain += char
        found.append(_quoted(chain) + _branches(node, end))
    if not found:
        return end
    if "" in tree:
        found.append(end)
    return f"(?:{'|'.join(found)})"


def pattern(literals: Iterable[str], alone: bool = False) -> str:
    """Matches nothing wherever a literal begins; the first group is the longest that does."""
    tree: dict = {}
    for literal in literals:
        if not literal:
            raise ValueError("an empty literal stands everywhere")
        node = tree
        for char in literal:
            node = node.setdefault(char, {})
        node[""] = {}
    firsts = "".join(_quoted(c) for c in sorted(tree))
    return f"{ALONE_BEFORE if alone else ''}(?=[{firsts}])(?=({_branches(tree, ALONE_AFTER if alone else '')}))"


def _with_beginnings(owners: Mapping[str, Iterable], alone: bool) -> dict[str, list]:
    """For each literal the owners of all literals that stand where it does."""
    def ends_well(literal: str, size: int) -> bool:
        return not alone or size == len(literal) or not re.match(JOINED, literal[size])

    return {literal: list(dict.fromkeys(
        owner for size in range(1, len(literal) + 1) if literal[:size] in owners and ends_well(literal, size)
        for owner in owners[literal[:size]])) for literal in owners}


def owners_in(text: Column, owners: Mapping[str, Iterable], kind: str = "string", alone: bool = False) -> Column:
    """The distinct owners of all literals that ``text`` holds; ``alone`` asks for no letter or digit next to them.

    A null text holds none.
    """
    none = F.array().cast(f"array<{kind}>")
    if not owners:
        return none
    table = F.from_json(F.lit(json.dumps(_with_beginnings(owners, alone))), f"map<string,array<{kind}>>")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern(owners, alone)), F.lit(1)))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(found, lambda literal: table[literal]))), none)
