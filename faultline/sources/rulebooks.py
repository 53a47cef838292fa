"""Rules, areas, adjacent areas and framework markers kept as tables.

Such tables are settings, not data: they are read on the driver, up to ``MOST_ROWS`` rows, and a
longer one is an error.  Whatever is given as a sequence already is taken as it is.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row

from faultline import seeds
from faultline.seeds import Area, Rule

MOST_ROWS = 100_000
LANGUAGES = ("py", "js", "any")


def _rows(table: DataFrame, what: str, *needed: str) -> list[dict]:
    if missing := [c for c in needed if c not in table.columns]:
        raise ValueError(f"a table of {what} needs the columns {', '.join(missing)}")
    rows: list[Row] = table.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no table of {what}")
    given = [row.asDict() for row in rows]
    for row in given:
        for c in needed:
            if row[c] is None or row[c] == "":
                raise ValueError(f"a row of a table of {what} has no {c}: {row}")
    return given


def rules_in(table: DataFrame | Sequence[Rule]) -> tuple[Rule, ...]:
    """Text rules from a table with the fields of :class:`Rule`; absent and null fields take its defaults.

    The rules stand in the order of a column ``position``, or of their ids: among findings
    of one line and category the first rule wins.  Rules for ``any`` language count as secrets.
    """
    if not isinstance(table, DataFrame):
        return tuple(table)
    rows = _rows(table, "rules", "rule_id", "lang", "regex", "title", "category", "severity", "confidence")
    rows.sort(key=lambda row: (row.get("position") is None, row.get("position") or 0, row["rule_id"]))
    rules = []
    for row in rows:
        fields = {f: row[f] for f in Rule._fields if row.get(f) is not None}
        rule = Rule(**fields | {"hints": tuple(h for h in fields.get("hints", ()) if h)})
        if rule.lang not in LANGUAGES:
            raise ValueError(f"rule {rule.rule_id}: no language {rule.lang}")
        if re.compile(rule.regex).search("") is not None:
            raise ValueError(f"rule {rule.rule_id} matches nothing at all")
        rules.append(rule)
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("rules need ids of their own")
    return tuple(rules)


def areas_in(table: DataFrame | Sequence[Area]) -> tuple[Area, ...]:
    """Areas from a table of ``area, kind, applies_to, pattern``; ``applies_to`` is path or text.

    Patterns are compared in lower case.
    """
    if not isinstance(table, DataFrame):
        return tuple(table)
    found: dict[tuple[str, str], dict[str, set]] = {}
    for row in _rows(table, "areas", "area", "kind", "applies_to", "pattern"):
        patterns = found.setdefault((row["area"], row["kind"]), {"path": set(), "text": set()})
        if row["applies_to"] not in patterns:
            raise ValueError(f"patterns apply to path or text, not to {row['applies_to']}")
        patterns[row["applies_to"]].add(row["pattern"].lower())
    if len({area for area, _ in found}) < len(found):
        raise ValueError("an area has one kind")
    return tuple(Area(*name, tuple(sorted(p["path"])), tuple(sorted(p["text"]))) for name, p in sorted(found.items()))


def adjacent_in(table: DataFrame | Sequence[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """Pairs of adjacent areas from a table of ``start, end``."""
    if not isinstance(table, DataFrame):
        return tuple(table)
    return tuple(sorted({(row["start"], row["end"]) for row in _rows(table, "adjacent areas", "start", "end")}))


def markers_in(table: DataFrame | None) -> dict[str, Mapping[str, str]]:
    """Framework markers from a table of ``manifest, marker, label``; ``manifest`` is python or npm."""
    if table is None:
        return {"python_markers": seeds.PYTHON_MARKERS, "npm_markers": seeds.NPM_MARKERS}
    found: dict[str, dict[str, str]] = {"python": {}, "npm": {}}
    for row in _rows(table, "markers", "manifest", "marker", "label"):
        if row["manifest"] not in found:
            raise ValueError(f"markers are of python or npm, not of {row['manifest']}")
        if found[row["manifest"]].setdefault(row["marker"], row["label"]) != row["label"]:
            raise ValueError(f"marker {row['marker']} has two labels")
    return {f"{name}_markers": markers for name, markers in found.items()}
