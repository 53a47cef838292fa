"""Reads a client makes: report list, report detail, dashboard, graph of the latest report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import dashboard, graph, reports
from faultline.sources.tables import read_table, scan_places


class Stored(NamedTuple):
    """The stored tables as DataFrames."""

    reports: DataFrame
    findings: DataFrame
    scan_metadata: DataFrame
    status_changes: DataFrame
    database: str = "default"


def stored(spark: SparkSession, database: str = "default", days: tuple | None = None) -> Stored:
    tables = [read_table(spark, t, database, days if t != "status_changes" else None) for t in Stored._fields[:-1]]
    return Stored(*tables, database)


def list_reports(tables: Stored) -> DataFrame:
    return reports.newest_first(tables.reports)


def _of(report: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the given report; joining on the day too leaves only its partition to read."""
    return rows.join(report.select("scan_id", "scan_day"), ["scan_id", "scan_day"], "left_semi")


def _report(tables: Stored, scan_id: str) -> DataFrame:
    """One report; the scan index names its day, so that other days are not read."""
    place = scan_places(tables.reports.sparkSession, scan_id, tables.database)
    return tables.reports.filter(F.col("scan_id") == scan_id).join(place, ["scan_id", "scan_day"], "left_semi")


def _detail(tables: Stored, report: DataFrame) -> DataFrame:
    return reports.report_detail(
        report, _of(report, tables.findings), _of(report, tables.scan_metadata))


def get_report(tables: Stored, scan_id: str) -> DataFrame:
    """Report, metadata and findings of one scan; empty when it does not exist."""
    return _detail(tables, _report(tables, scan_id))


def get_findings(tables: Stored, scan_id: str) -> DataFrame:
    """Findings of one existing scan with their present status, worst first."""
    report = _report(tables, scan_id)
    current = reports.current_status(_of(report, tables.findings), tables.status_changes)
    return reports.report_findings(report, current)


def latest_detail(tables: Stored) -> DataFrame:
    """Detail of the newest report."""
    return _detail(tables, reports.latest_report(tables.reports))


def latest_graph(tables: Stored) -> graph.Graph:
    return graph.security_graph(_of(reports.latest_report(tables.reports), tables.findings))


def latest_dashboard(tables: Stored) -> DataFrame:
    found = _of(reports.latest_report(tables.reports), tables.findings)
    return dashboard.vulnerability_rows(reports.current_status(found, tables.status_changes))
