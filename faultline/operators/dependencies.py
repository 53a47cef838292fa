"""Advisory matching and framework detection."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import paths, versions
from faultline.functions.literals import owners_in
from faultline.session import dimension
from faultline.sources import manifests


def advisory_table(spark: SparkSession, advisories: Sequence[seeds.Advisory] = seeds.ADVISORIES) -> DataFrame:
    return dimension(spark, {
        field: [getattr(a, field) for a in advisories] for field in seeds.Advisory._fields})


def affected_packages(packages: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Declared packages whose version an advisory's specifier covers.

    An advisory has a ``specifier`` of any clauses, or a ``bound`` below which versions are affected; the
    bound is taken where there is no specifier.  Clauses are parsed once per advisory and versions once per
    package.  The join carries no hint: the built-in table is a local relation and is broadcast, a table of any
    size is joined by its measured size.
    """
    if advisories is None:
        advisories = advisory_table(packages.sparkSession)
    below = F.concat(F.lit("<"), F.col("bound")) if "bound" in advisories.columns else F.lit(None).cast("string")
    specifier = F.coalesce(F.col("specifier"), below) if "specifier" in advisories.columns else below
    known = advisories.withColumn("clauses", versions.clauses(specifier)).filter(F.col("clauses").isNotNull())
    usable = packages.withColumn("version_key", versions.version_key(F.col("version"))).filter(
        F.col("version_key").isNotNull())
    return (
        usable.join(known, "package")
        .filter(versions.satisfies(F.col("version_key"), F.col("clauses")))
        .drop("version_key", "clauses"))


def dependency_findings(packages: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Raw findings for affected packages."""
    package, version, summary = F.col("package"), F.col("version"), F.col("summary")
    return affected_packages(packages, advisories).select(
        "project_id", F.lit(seeds.DEPENDENCY_PATH).alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        F.lit(seeds.DEPENDENCY_CATEGORY).alias("category"), "severity",
        F.lit(seeds.DEPENDENCY_CONFIDENCE).alias("confidence"), "source_rank",
        F.col("manifest_path").alias("origin"), F.col("position").alias("rule_ord"),
        F.lit(0).alias("match_ord"), F.lit(None).cast("string").alias("rule_id"),
        F.concat(F.lit("Vulnerable dependency: "), package).alias("title"),
        F.concat(package, F.lit(" "), version, F.lit(" is listed in "), F.col("advisory_id"),
                 F.lit(". "), summary).alias("description"),
        F.concat(F.lit("What can happen where it is used: "), F.lower(summary)).alias("impact"),
        F.concat(F.lit("Move "), package, F.lit(" to "), F.col("fixed_version"),
                 F.lit(" or newer.")).alias("recommendation"),
        F.lit(None).cast("string").alias("example_fix"),
        F.lit("dependency-advisory").alias("source_tool"),
        F.concat(package, F.lit("=="), version).alias("code_snippet"),
        F.array().cast("array<string>").alias("attack_path"))


def framework_labels(files: DataFrame, python_markers: Mapping[str, str] = seeds.PYTHON_MARKERS,
                     npm_markers: Mapping[str, str] = seeds.NPM_MARKERS) -> DataFrame:
    """One row per project and framework found in its manifests.

    Python markers are looked for anywhere in the lower-cased text, npm markers
    among the declared names as they are written.
    """
    name = paths.basename(F.col("file_path"))
    read = manifests.manifest_files(files).select(
        "project_id", F.lower("content").alias("lowered"), (name == manifests.PACKAGE_JSON).alias("is_npm"),
        F.when(name == manifests.PACKAGE_JSON, manifests.npm_maps(F.col("content"))).alias("maps"))

    none = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(F.map_keys(f"maps.{m}"), none) for m in ("dependencies", "devDependencies")])
    label_of = F.from_json(F.lit(json.dumps(dict(npm_markers))), "map<string,string>")
    declared = F.array_compact(F.transform(names, lambda name: label_of[name]))
    in_text = owners_in(F.col("lowered"), {marker: [label] for marker, label in python_markers.items()})
    labels = F.when(F.col("is_npm"), declared).otherwise(in_text)
    return read.select("project_id", F.explode(labels).alias("label")).distinct()


def detected_frameworks(files: DataFrame, **markers) -> DataFrame:
    """Sorted labels per project; as many as there are markers at most."""
    return framework_labels(files, **markers).groupBy("project_id").agg(
        F.array_sort(F.collect_list("label")).alias("detected_frameworks"))
