"""Risk score and file counters per project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import paths, severity

COUNTS = {name: f"{name.lower()}_count" for name in seeds.SEVERITIES}


def severity_counts(findings: DataFrame, key: str = "project_id") -> DataFrame:
    """Counts, worst severity and penalty sum per project that has findings."""
    scored = severity.scored_severity(F.col("severity"))
    return findings.groupBy(key).agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(scored == name).alias(column) for name, column in COUNTS.items()],
        F.min(severity.severity_rank(scored)).alias("worst_rank"),
        F.sum(severity.penalty_units(F.col("severity"), F.col("confidence"), F.col("category")))
        .alias("penalty_units"))


def scores(findings: DataFrame, projects: DataFrame | None = None, key: str = "project_id") -> DataFrame:
    """Score, posture and counts per project; projects without findings score 100."""
    counted = severity_counts(findings, key)
    if projects is not None:
        counted = projects.select(key).join(counted, key, "left")
    zero = F.lit(0).cast("long")
    score = severity.score_from_units(F.coalesce("penalty_units", zero), F.col("worst_rank"))
    ranks = dict(enumerate(seeds.SEVERITIES))
    return counted.select(
        key, score.alias("overall_score"), severity.posture(score).alias("security_posture"),
        F.coalesce("total_findings", zero).alias("total_findings"),
        *[F.coalesce(c, zero).alias(c) for c in COUNTS.values()],
        severity.lookup(ranks, F.col("worst_rank")).alias("worst_severity"),
        F.coalesce("penalty_units", zero).alias("penalty_units"))


def file_counters(files: DataFrame) -> DataFrame:
    """Files per project in total, by counted language, and configuration files."""
    path = F.col("file_path")
    return files.groupBy("project_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(paths.counted_language(path) == "py").alias("python_files"),
        F.count_if(paths.counted_language(path) == "js").alias("javascript_files"),
        F.count_if(paths.is_config(path)).alias("config_files"))
