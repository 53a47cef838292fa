"""The stored tables: reports, findings, scan metadata, refusals and status changes, and what was committed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.plans.scan import ScanResult
from faultline.session import cut

#: Tables filled by ``append_scan``; their rows carry the commit they came with.
SCANNED = {
    "findings": schema.FINDINGS, "scan_metadata": schema.SCAN_METADATA,
    "reports": schema.REPORTS, "refusals": schema.REFUSALS,
}
#: Parts of the scan index, by the hash of the id, so that a lookup reads one of them.
INDEX_PARTS = 32
#: Status changes that one task writes.
ROWS_PER_TASK = 100_000


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables that do not exist yet; existing ones stay untouched."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def create(table: str, layout: str, partition: str = "") -> None:
        by = f"PARTITIONED BY ({partition.split()[0]})" if partition else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({', '.join(x for x in (layout, partition) if x)}) USING parquet {by}")

    for table, layout in SCANNED.items():
        create(table, f"{layout}, commit_id string", "scan_day date")
    create("status_changes", schema.STATUS_CHANGES, "changed_day date")
    create("scan_index", schema.SCAN_INDEX, "part int")
    create("commits", schema.COMMITS)


def _dated(rows: DataFrame, what: str, date: str = "scan_date") -> DataFrame:
    """Rows with their day; every row must have one."""
    rows = rows.withColumn("scan_day", F.to_date(date))
    undated = rows.filter(F.col("scan_day").isNull()).count()
    if undated:
        raise ValueError(f"{undated} rows of a {what} without a date cannot be stored")
    return rows


def index_part(scan_id: Column) -> Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(INDEX_PARTS)).cast("int")


def committed(rows: DataFrame, database: str = "default") -> DataFrame:
    """Rows of appends that came to their end; what a broken one left behind is not seen.

    There is one narrow row per append, so Spark sends these to the readers while they are few.
    """
    return rows.join(rows.sparkSession.read.table(f"{database}.commits").select("commit_id"), "commit_id", "left_semi")


def _insert(rows: DataFrame, table: str) -> None:
    rows.select(*rows.sparkSession.read.table(table).columns).write.mode("append").insertInto(table)


def append_scan(result: ScanResult, database: str = "default") -> None:
    """Append the scans and refusals that are not stored yet, all of them together or none.

    Every append has a commit of its own.  Its rows go to their tables and its ids to the scan
    index; one row in ``commits``, written last, makes all of them visible at once.  An append that broke
    off is repeated as a whole, under another commit.  Appends to one database come one after
    the other.  Scans and refusals without a date belong to no day: that is an error.
    """
    spark = result.reports.sparkSession
    reports = _dated(result.reports, "scan")
    refusals = None if result.refusals is None else _dated(result.refusals, "refusal")
    ids = reports.select("scan_id", "scan_day", F.lit(False).alias("refused"))
    if refusals is not None:
        ids = ids.unionByName(refusals.select(F.col("submission").alias("scan_id"), "scan_day", F.lit(True).alias("refused")))
    known = committed(spark.read.table(f"{database}.scan_index"), database).select("scan_id", "scan_day")
    fresh = cut(ids.distinct().join(known, ["scan_id", "scan_day"], "left_anti"))
    total = fresh.agg(F.count_if(~F.col("refused")).alias("scans"), F.count_if("refused").alias("refusals")).first()
    if not total["scans"] + total["refusals"]:
        return
    commit_id = uuid.uuid4().hex
    marked = F.lit(commit_id).alias("commit_id")
    scans = fresh.filter(~F.col("refused")).select("scan_id", "scan_day")
    if total["scans"]:
        findings = result.findings.withColumn("scan_day", F.to_date("created_at"))
        _insert(findings.join(scans, ["scan_id", "scan_day"], "left_semi").select("*", marked), f"{database}.findings")
        _insert(result.scan_metadata.join(scans, "scan_id").select("*", marked), f"{database}.scan_metadata")
        _insert(reports.join(scans, ["scan_id", "scan_day"], "left_semi").select("*", marked), f"{database}.reports")
    if total["refusals"]:
        new = fresh.filter("refused").select(F.col("scan_id").alias("submission"), "scan_day")
        _insert(refusals.join(new, ["submission", "scan_day"], "left_semi").select("*", marked), f"{database}.refusals")
    _insert(fresh.select("scan_id", "scan_day", marked, index_part(F.col("scan_id")).alias("part")).repartition("part"),
            f"{database}.scan_index")
    done = [(commit_id, total["scans"], total["refusals"])]
    _insert(spark.createDataFrame(done, schema.COMMITS).coalesce(1), f"{database}.commits")


def scan_places(spark: SparkSession, scan_id: str, database: str = "default") -> DataFrame:
    """The day and the commit of one stored scan, from one part of the index."""
    index = spark.read.table(f"{database}.scan_index")
    return committed(index.filter((F.col("part") == index_part(F.lit(scan_id))) & (F.col("scan_id") == scan_id)),
                     database).select("scan_id", "scan_day")


def append_status_changes(changes: DataFrame, database: str = "default") -> None:
    """Log status changes; findings themselves are never rewritten or deleted.

    Rows are dealt out by ranges of day and id, so that there are about as many files as days, or more where
    a day has many rows, whatever parts the changes come in.  The changes, which may come from a stream, are computed once.
    """
    table = f"{database}.status_changes"
    stored = changes.sparkSession.read.table(table)
    rows = changes.withColumn("changed_day", F.to_date("changed_at")).select(*stored.columns).persist()
    try:
        parts = -(-rows.count() // ROWS_PER_TASK)
        if parts:
            rows.repartitionByRange(parts, "changed_day", "change_id").write.mode("append").insertInto(table)
    finally:
        rows.unpersist()


def read_table(spark: SparkSession, table: str, database: str = "default", days: tuple | None = None) -> DataFrame:
    """A stored table, with only the partitions of the days from ``days[0]`` to ``days[1]``."""
    rows = spark.read.table(f"{database}.{table}")
    if days is not None:
        column = "changed_day" if table == "status_changes" else "scan_day"
        rows = rows.filter(F.col(column).between(*[F.lit(d).cast("date") for d in days]))
    return committed(rows, database).drop("commit_id") if table in SCANNED else rows
