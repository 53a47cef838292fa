"""Security areas of a finding, as expressions."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions.literals import owners_in

# Separators that count as blanks, and the longest pattern that
# must stand alone instead of being contained.
SEPARATORS = r"[_\-/.\s]+"
SHORT = 4


def plain_words(text):
    return F.regexp_replace(text, SEPARATORS, " ") if isinstance(text, Column) else re.sub(SEPARATORS, " ", text)


def claimed_areas(areas: Sequence[seeds.Area] = seeds.AREAS) -> Column:
    """Names of the areas that claim a finding by category, title or path, in any number.

    Reads the lower-cased columns ``category``, ``title`` and ``path`` and the
    plain words of the first two, ``plain_category`` and ``plain_title``.  Short
    patterns must not touch a letter or digit; longer ones are looked for with
    separators read as blanks.
    """
    by_path, short, long = defaultdict(list), defaultdict(list), defaultdict(list)
    for area in areas:
        for p in area.path_patterns:
            by_path[p].append(area.name)
        for p in area.text_patterns:
            if len(p) <= SHORT:
                short[p].append(area.name)
            else:
                long[plain_words(p)].append(area.name)
    claims = [owners_in(F.col("path"), by_path)]
    for t in ("category", "title"):
        claims += [owners_in(F.col(t), short, alone=True), owners_in(F.col(f"plain_{t}"), long)]
    return F.array_distinct(F.concat(*claims))


def fallback_area(path: Column) -> Column:
    """Area by path ending, for findings nothing claims."""
    area = F.lit(seeds.FALLBACK_AREA)
    for regex, name in reversed(seeds.FALLBACK_AREAS):
        area = F.when(F.regexp_like(path, F.lit(regex)), name).otherwise(area)
    return area


def area_id(area: Column) -> Column:
    return F.lower(F.regexp_replace(area, r"\s+", "-"))


def file_id(parent: Column, path: Column) -> Column:
    return F.concat(parent, F.lit("-"), F.regexp_replace(path, "[^a-zA-Z0-9]", "-"))


def tenth(value: Column) -> Column:
    """Rounded to one decimal, halves up."""
    return F.floor(value * 10 + 0.5) / 10


def _turn(ordinal: Column, count: Column) -> Column:
    return F.lit(2) * F.pi() * ordinal / count


def area_position(ordinal: Column, count: Column) -> tuple[Column, Column]:
    """Place of an area on the ellipse; one or two areas are centred."""
    (cx, cy), (rx, ry), (left, right) = seeds.LAYOUT_CENTRE, seeds.LAYOUT_RADII, seeds.LAYOUT_PAIR_X
    angle = _turn(ordinal, count) - F.pi() / 2
    x = (F.when(count == 1, cx).when(count == 2, F.when(ordinal == 0, left).otherwise(right))
         .otherwise(tenth(F.lit(cx) + F.lit(rx) * F.cos(angle))))
    y = F.when(count <= 2, cy).otherwise(tenth(F.lit(cy) + F.lit(ry) * F.sin(angle)))
    return x, y


def file_position(x: Column, y: Column, ordinal: Column, count: Column) -> tuple[Column, Column]:
    """Place of a file on the circle around its area; the circle grows with the crowd."""
    radius = F.lit(seeds.CHILD_RADIUS) + F.greatest(F.lit(0), count - seeds.CHILD_CROWD)
    angle = _turn(ordinal, count)
    return tenth(x + radius * F.cos(angle)), tenth(y + radius * F.sin(angle))
