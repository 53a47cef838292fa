"""Security areas, files and their connections, derived from findings.

Every step aggregates before it shuffles, and the only rows brought together
per project are its areas, of which there are as many as the area table has.
Lists of members can be of any length, so they are relations of their own and
come as pages of a bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import areas as a
from faultline.functions import paths, severity
from faultline.operators.ordered import ordinals
from faultline.session import cut
from faultline.sources.rulebooks import adjacent_in, areas_in

SERIOUS = ("CRITICAL", "HIGH")


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _with_claims(findings: DataFrame, kept: dict[str, Column], area_table: Sequence[seeds.Area] | DataFrame) -> DataFrame:
    """Findings with the areas that claim them and the area their path would give them."""
    def lowered(column: str) -> Column:
        return F.lower(F.coalesce(F.col(column), F.lit("")))

    words = findings.select(
        *[c.alias(f"kept_{n}") for n, c in kept.items()],
        lowered("category").alias("category"), lowered("title").alias("title"),
        paths.slashes(lowered("file_path")).alias("path"))
    plain = words.select(
        "*", *[a.plain_words(F.col(t)).alias(f"plain_{t}") for t in ("category", "title")])
    return plain.select(
        *[F.col(f"kept_{n}").alias(n) for n in kept], a.claimed_areas(areas_in(area_table)).alias("claimed"),
        a.fallback_area(F.col("path")).alias("otherwise"))


def classified(findings: DataFrame, area_table: Sequence[seeds.Area] | DataFrame = seeds.AREAS,
               marker: str = paths.WORK_MARKER) -> DataFrame:
    """One row per finding and area it belongs to."""
    has_path = F.coalesce(F.col("file_path"), F.lit("")) != ""
    kept = {
        "project_id": F.col("project_id"), "finding_id": F.col("finding_id"),
        "title": F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
        .otherwise("Unknown vulnerability"),
        "severity": F.col("severity"),
        "line": F.when(F.col("line_number") != 0, F.col("line_number")),
        "full_path": F.when(has_path, paths.graph_path(F.col("file_path"), marker)),
    }
    return _with_claims(findings, kept, area_table).select(
        *kept, F.explode(F.when(F.size("claimed") > 0, F.col("claimed")).otherwise(F.array("otherwise")))
        .alias("area"))


def unclaimed(findings: DataFrame, area_table: Sequence[seeds.Area] | DataFrame = seeds.AREAS) -> DataFrame:
    """Findings that no area claims, with the area their path ending gives them."""
    kept = {c: F.col(c) for c in ("project_id", "finding_id", "file_path")}
    return _with_claims(findings, kept, area_table).filter(F.size("claimed") == 0).select(
        *kept, F.col("otherwise").alias("area"))


def file_groups(members: DataFrame) -> DataFrame:
    """Findings and worst severity per project, area and file.

    Among severities of one rank (unknown ones) the alphabetically last is named,
    so that the order of rows does not matter.
    """
    name = F.upper("severity")
    return members.groupBy("project_id", "area", "full_path").agg(
        F.count("*").alias("finding_count"),
        F.max(F.struct(severity.graph_rank(name).alias("rank"), name.alias("name"))).alias("worst"))


def placed_areas(groups: DataFrame, area_table: Sequence[seeds.Area] = seeds.AREAS) -> DataFrame:
    """Areas of each project in alphabetical order, with their place on the ellipse."""
    per_area = groups.groupBy("project_id", "area").agg(
        F.sum("finding_count").alias("finding_count"), F.max("worst").alias("worst"),
        F.count("full_path").alias("file_count"))
    listed = per_area.groupBy("project_id").agg(F.array_sort(F.collect_list(
        F.struct("area", "finding_count", "worst", "file_count"))).alias("areas"))
    each = listed.select("project_id", F.size("areas").alias("area_count"),
                         F.posexplode("areas").alias("ordinal", "found"))
    x, y = a.area_position(F.col("ordinal"), F.col("area_count"))
    kinds = {area.name: area.kind for area in area_table}
    area = F.col("found.area")
    return each.select(
        "project_id", a.area_id(area).alias("node_id"), area.alias("area"),
        severity.lookup(kinds, area).alias("kind"), "ordinal", "area_count",
        x.cast("double").alias("x"), y.cast("double").alias("y"), F.col("found.finding_count").alias("finding_count"),
        F.col("found.worst.name").alias("highest_severity"), F.col("found.file_count").alias("file_count"))


def placed_files(groups: DataFrame, areas: DataFrame, collation: str | None = None) -> DataFrame:
    """Files of each area by path, with their place on the circle around the area.

    Paths are ordered by their bytes, or by the named collation.
    """
    numbered = ordinals(
        groups.filter(F.col("full_path").isNotNull()), ["project_id", "area"], "full_path",
        "ordinal", collation)
    parents = areas.select(
        "project_id", "area", F.col("node_id").alias("parent_id"), F.col("x").alias("area_x"),
        F.col("y").alias("area_y"), "file_count")
    x, y = a.file_position(F.col("area_x"), F.col("area_y"), F.col("ordinal"), F.col("file_count"))
    return numbered.join(parents, ["project_id", "area"]).select(
        "project_id", a.file_id(F.col("parent_id"), F.col("full_path")).alias("node_id"),
        "parent_id", "area", "full_path", paths.basename(F.col("full_path")).alias("label"),
        "ordinal", x.alias("x"), y.alias("y"), "finding_count",
        F.col("worst.name").alias("highest_severity"))


def area_edges(areas: DataFrame, adjacent: Sequence[tuple[str, str]] | DataFrame = seeds.ADJACENT_AREAS) -> DataFrame:
    """Edges between adjacent areas of which both are present."""
    pairs = F.from_json(F.lit(json.dumps([{"start": p, "end": q} for p, q in adjacent_in(adjacent)])),
                        "array<struct<start:string,end:string>>")
    present = areas.groupBy("project_id").agg(F.map_from_entries(F.collect_list(
        F.struct("area", "highest_severity"))).alias("worst"))
    worst = F.col("worst")
    linked = present.select("project_id", "worst", F.explode(F.filter(
        pairs, lambda p: F.map_contains_key(worst, p["start"]) & F.map_contains_key(worst, p["end"])))
        .alias("pair"))

    def serious(side: str) -> Column:
        return F.coalesce(F.try_element_at(worst, F.col(f"pair.{side}")).isin(*SERIOUS), F.lit(False))

    return linked.select(
        "project_id", a.area_id(F.col("pair.start")).alias("from_id"),
        a.area_id(F.col("pair.end")).alias("to_id"),
        (serious("start") | serious("end")).alias("active"), F.lit(False).alias("is_hierarchy"))


def file_edges(files: DataFrame) -> DataFrame:
    """Edges from each area to its files."""
    return files.select(
        "project_id", F.col("parent_id").alias("from_id"), F.col("node_id").alias("to_id"),
        F.coalesce(F.col("highest_severity").isin(*SERIOUS), F.lit(False)).alias("active"),
        F.lit(True).alias("is_hierarchy"))


def security_graph(findings: DataFrame, area_table: Sequence[seeds.Area] | DataFrame = seeds.AREAS,
                   collation: str | None = None,
                   adjacent: Sequence[tuple[str, str]] | DataFrame = seeds.ADJACENT_AREAS) -> Graph:
    """Nodes and edges of all projects.

    Areas and their adjacency may be tables (:mod:`faultline.sources.rulebooks`).
    The findings are classified once; everything else derives from the stored
    counts per area and file.
    """
    area_table = areas_in(area_table)
    groups = cut(file_groups(classified(findings, area_table)))
    areas = placed_areas(groups, area_table)
    files = placed_files(groups, areas, collation)
    none = F.lit(None).cast("string")
    area_nodes = areas.select(
        "project_id", "node_id", F.lit("area").alias("node_type"), F.col("area").alias("label"),
        "kind", "x", "y", "finding_count", "highest_severity", none.alias("parent_id"),
        none.alias("full_path"))
    file_nodes = files.select(
        "project_id", "node_id", F.lit("file").alias("node_type"), "label",
        F.lit("FILE").alias("kind"), "x", "y", "finding_count", "highest_severity", "parent_id",
        "full_path")
    return Graph(area_nodes.unionByName(file_nodes), file_edges(files).unionByName(area_edges(areas, adjacent)))


def member_pages(members: DataFrame, keys: Sequence[str] = ("project_id", "area"),
                 page_size: int = 10_000) -> DataFrame:
    """Findings of each node as sorted arrays.

    A node with up to ``page_size`` findings has one page, a larger one as
    many pages of about that size as it needs; no finding is left out.
    """
    large = members.groupBy(*keys).agg(F.count("*").alias("members")).filter(
        F.col("members") > page_size).select(*keys, F.ceil(F.col("members") / page_size).alias("wanted"))
    # Equality that treats missing paths as equal; null keys form a group of their own.
    matched = members.alias("m").join(
        large.alias("l"), [F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], "left")
    pages = F.coalesce(F.col("l.wanted"), F.lit(1).cast("long"))
    detail = F.struct(*[F.col(f"m.{c}").alias(c) for c in ("finding_id", "title", "severity", "line")])
    return (
        matched.select(*[F.col(f"m.{k}").alias(k) for k in keys],
                       F.pmod(F.xxhash64("m.finding_id"), pages).alias("page"), detail.alias("detail"))
        .groupBy(*keys, "page").agg(F.array_sort(F.collect_list("detail")).alias("findings")))
