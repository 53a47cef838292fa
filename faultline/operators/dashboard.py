"""Rows the dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions.severity import banded, lookup

DETECTED_FORMAT = "M/d/yyyy, h:mm:ss a"


def vulnerability_rows(findings: DataFrame) -> DataFrame:
    """One display row per finding."""
    sev = F.lower("severity")
    line = F.when(F.col("line_number") != 0, F.concat(F.lit(":"), F.col("line_number").cast("string")))
    return findings.select(
        "project_id", "finding_id", F.upper("category").alias("cve"), "title",
        F.concat("file_path", F.coalesce(line, F.lit(""))).alias("asset"), sev.alias("severity"),
        F.coalesce(lookup(seeds.CVSS, sev), F.lit(seeds.CVSS_DEFAULT)).alias("cvss"),
        F.col("category").alias("vector"),
        F.date_format("created_at", DETECTED_FORMAT).alias("detected"),
        F.when(F.col("status").isin("FIXED", "FALSE_POSITIVE"), "contained")
        .when(F.col("status") == "IGNORED", "investigating").otherwise("active").alias("status"),
        F.coalesce("description", F.lit("No description provided.")).alias("description"))


def risk_rows(reports: DataFrame, key: str = "project_id") -> DataFrame:
    """Risk index of each report with its band."""
    risk = F.lit(100) - F.coalesce("overall_score", F.lit(100))
    return reports.select(
        key, risk.alias("risk_index"), banded(risk, seeds.RISK_BANDS, 1).alias("risk_severity"),
        banded(risk, seeds.RISK_BANDS, 2).alias("risk_label"))


def metric_rows(reports: DataFrame, metadata: DataFrame, key: str = "scan_id") -> DataFrame:
    """Headline numbers of each report."""
    return reports.join(metadata, key, "left").select(
        key, F.col("total_findings").alias("findings"), F.col("security_posture").alias("posture"),
        F.coalesce("total_files", F.lit(0)).alias("files_analyzed"),
        F.col("critical_count").alias("critical"), F.col("high_count").alias("high"),
        F.concat(F.regexp_replace(
            F.coalesce(F.col("scan_duration"), F.lit(0.0)).cast("string"), "\\.0$", ""), F.lit("s")).alias("duration"))


def recounted(findings: DataFrame, key: str = "project_id") -> DataFrame:
    """Critical and high counts from display rows, for projects without a report."""
    return findings.groupBy(key).agg(
        F.count_if(F.lower("severity") == "critical").alias("critical"),
        F.count_if(F.lower("severity") == "high").alias("high"))
