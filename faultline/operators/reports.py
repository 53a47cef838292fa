"""Reads over stored reports, findings, metadata and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions.severity import severity_rank


def newest_first(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.col("scan_date").desc(), "scan_id")


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report of all; Spark keeps one row per task for it."""
    return newest_first(reports).limit(1)


def latest_per_project(reports: DataFrame) -> DataFrame:
    """The newest report of every project, reduced before the shuffle."""
    best = reports.groupBy("project_name").agg(
        F.max_by(F.struct(*reports.columns), F.struct("scan_date", "scan_id")).alias("latest"))
    return best.select("latest.*")


def report_by_id(reports: DataFrame, scan_id) -> DataFrame:
    """The report with an id; empty when there is none."""
    return reports.filter(F.col("scan_id") == scan_id)


def report_findings(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of existing reports, worst first within each report."""
    return findings.join(reports.select("scan_id"), "scan_id", "left_semi").orderBy(
        "scan_id", severity_rank(F.col("severity")), "finding_id")


def report_detail(reports: DataFrame, findings: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per report and finding, with the scan's metadata beside it.

    A report without findings has one row without a finding.  The findings
    stay rows, since a report can have any number of them.
    """
    shown = findings.drop("project_id", "scan_day")
    return (
        reports.drop("scan_day")
        .join(metadata.drop("scan_day"), "scan_id", "left")
        .join(shown, "scan_id", "left"))


def current_status(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings with the status of their last change, ``OPEN`` when never changed.

    Changes are ``finding_id, status, changed_at, change_id``; the id settles
    changes of the same moment.  Unknown states are ignored.
    """
    last = (
        changes.filter(F.col("status").isin(*seeds.FINDING_STATES))
        .groupBy("finding_id")
        .agg(F.max_by("status", F.struct("changed_at", "change_id")).alias("new_status")))
    kept = [c for c in findings.columns if c != "status"]
    old = F.col("status") if "status" in findings.columns else F.lit(seeds.FINDING_STATES[0])
    return findings.join(last, "finding_id", "left").select(
        *kept, F.coalesce("new_status", old).alias("status"))


def within_limits(findings: DataFrame) -> DataFrame:
    """Mark findings whose texts fit the stored widths and whose numbers are in range."""
    # Widths of the stored columns.
    widths = {"title": 255, "category": 64, "file_path": 1024, "source_tool": 64}
    fits = F.col("confidence").between(0, 100)
    for column, width in widths.items():
        fits = fits & (F.length(column) <= width)
    return findings.withColumn("fits", F.coalesce(fits, F.lit(False)))
