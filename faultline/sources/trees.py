"""Source trees from a file system."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import paths
from faultline.functions.text import decode_text


def name_glob() -> str:
    """Glob of every admitted file name, so that other files are not even opened."""
    def either_case(text: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)

    endings = [f"*{either_case(s)}" for s in seeds.ALLOWED_SUFFIXES]
    return "{" + ",".join(endings + [n for n in seeds.ALLOWED_NAMES if "*" not in n]) + "}"


def roots_of(spark: SparkSession, root: str) -> list[str]:
    """The whole names of a root of any form - relative, with a scheme, or with a pattern - as its file system gives them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(system.makeQualified(place))
    names = [status.getPath().toString() for status in found or ()]
    if not names:
        raise FileNotFoundError(f"no folder matches {root}")
    if len({name.count("/") for name in names}) > 1:
        raise ValueError(f"{root} matches folders of different depths, so projects cannot be told from their parents")
    return names


def read_trees(spark: SparkSession, root: str, max_file_bytes: int | None = None) -> DataFrame:
    """``project_id, file_path, size, content`` of all projects below ``root``.

    Every directory directly below ``root``, or below what its pattern matches, is one project; files directly
    there are the project ``.``.  Names are pruned while listing; blocked directories are left out by
    path.  Files have any size unless ``max_file_bytes`` is given, which the reader applies before it opens a file.
    """
    roots = roots_of(spark, root)
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob())
        .load(roots))
    if max_file_bytes is not None:
        raw = raw.filter(F.col("length") <= max_file_bytes)
    # Whatever stands before it, a file's path has as many parts above its project as its root has.
    plain = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", roots[0]).strip("/")
    above = len(plain.split("/")) if plain else 0
    parts = F.split(F.regexp_replace("path", "^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*", ""), "/")
    below = raw.select("length", "content", F.slice(parts, above + 1, F.size(parts)).alias("below"))
    inner = F.size("below") > 1
    named = below.select(
        F.when(inner, F.get("below", 0)).otherwise(".").alias("project_id"),
        F.array_join(F.when(inner, F.slice("below", 2, F.size("below"))).otherwise(F.col("below")), "/").alias("file_path"),
        F.col("length").alias("size"), "content")
    path = F.col("file_path")
    return (
        named.filter((path != "") & paths.is_allowed(path) & ~paths.in_blocked_dir(path))
        .select("project_id", "file_path", "size", decode_text(F.col("content")).alias("content")))
