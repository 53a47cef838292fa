"""Inline submissions: one JSON document per line and project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Submissions stored one per line; malformed lines become empty submissions.

    Files are read by lines, so many tasks share a large one.  ``landed_as`` says in which file a
    submission stands, ``landed_at`` when that was written and ``content_hash`` what it says.
    """
    return submissions_in(spark.read.text(path, lineSep="\n"))


def submissions_in(lines: DataFrame) -> DataFrame:
    """The submissions of the lines of files; blank lines are none."""
    line = F.rtrim(F.col("value"), F.lit("\r"))
    given = lines.select(
        F.col("_metadata.file_path").alias("landed_as"), F.col("_metadata.file_modification_time").alias("landed_at"),
        line.alias("line")).filter("trim(line) <> ''")
    return given.select(
        F.from_json("line", schema.PAYLOAD).alias("given"), "landed_as", F.sha2("line", 256).alias("content_hash"), "landed_at",
    ).select("given.project_name", "given.files", "landed_as", "content_hash", "landed_at")
