"""Declared dependencies from manifest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import paths, versions
from faultline.functions.text import strip
from faultline.operators.rules import SOURCE_RANKS

# Manifests that are read, by base name.
REQUIREMENTS, PYPROJECT, PACKAGE_JSON = "requirements.txt", "pyproject.toml", "package.json"


def manifest_files(files: DataFrame) -> DataFrame:
    """Manifests of all kinds; npm manifests of installed modules are left out."""
    path = F.col("file_path")
    name = paths.basename(path)
    return files.filter(
        name.isin(REQUIREMENTS, PYPROJECT)
        | ((name == PACKAGE_JSON) & ~F.array_contains(F.split(path, "/"), "node_modules")))


def npm_maps(content: Column) -> Column:
    """``dependencies`` and ``devDependencies``; null when the text is not JSON."""
    return F.from_json(content, schema.PACKAGE_JSON)


def declared_packages(files: DataFrame) -> DataFrame:
    """One row per requirement line and per npm dependency, in one pass over the manifests.

    An npm manifest that cannot be read gives no row; a package named in both
    of its maps gives two.
    """
    entry = "array<struct<key:string,value:string>>"
    name = paths.basename(F.col("file_path"))
    lines = F.transform(F.split("content", "\n"), lambda line: F.struct(
        strip(line).alias("key"), F.lit(None).cast("string").alias("value")))
    maps = npm_maps(F.col("content"))
    packages = F.concat(*[
        F.coalesce(F.map_entries(maps[m]), F.array().cast(entry)).cast(entry)
        for m in ("dependencies", "devDependencies")])
    entries = F.when(name == REQUIREMENTS, lines.cast(entry)).when(name == PACKAGE_JSON, packages)
    key, value = F.col("entry.key"), F.col("entry.value")
    is_npm = F.col("name") == PACKAGE_JSON
    kept = is_npm | ((key != "") & ~key.rlike("^[#-]") & versions.requirement_name(key).isNotNull())
    return (
        manifest_files(files)
        .select("project_id", F.col("file_path").alias("manifest_path"), name.alias("name"),
                F.posexplode(entries).alias("position", "entry"))
        .filter(kept)
        .select("project_id", "manifest_path",
                F.when(is_npm, SOURCE_RANKS["npm"]).otherwise(SOURCE_RANKS["requirements"])
                .alias("source_rank"), "position",
                F.when(is_npm, F.lower(key)).otherwise(versions.requirement_name(key)).alias("package"),
                F.when(is_npm, key).otherwise(F.regexp_extract(key, versions.REQUIREMENT, 1))
                .alias("declared_name"),
                F.when(is_npm, versions.npm_version(value)).otherwise(versions.requirement_version(key))
                .alias("version")))


def requirements(files: DataFrame) -> DataFrame:
    return declared_packages(files.filter(paths.basename(F.col("file_path")) == REQUIREMENTS))


def npm_packages(files: DataFrame) -> DataFrame:
    return declared_packages(files.filter(paths.basename(F.col("file_path")) == PACKAGE_JSON))
