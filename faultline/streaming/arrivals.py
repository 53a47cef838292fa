"""Work that arrives over time: submissions and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.plans.scan import scan_payloads
from faultline.sources.payloads import submissions_in
from faultline.sources.tables import append_scan, append_status_changes


def submissions(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Submissions as their files land; the landing time of the file dates the scan."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, lineSep="\n")
    return submissions_in(files)


def scan_batch(batch: DataFrame, database: str) -> None:
    """Scan the submissions of one batch and append the results and the refusals.

    Every submission is a scan of its own, named by its file, what it says and which of its
    equals it is, so a batch that is run again adds nothing and equal submissions stay apart.
    """
    append_scan(scan_payloads(batch, keep=True), database)


def scan_arrivals(spark: SparkSession, folder: str, progress: str, database: str = "default",
                  once: bool = False) -> StreamingQuery:
    """Scan submissions as they land in ``folder``; ``progress`` remembers what was done."""
    writer = (
        submissions(spark, folder).writeStream.option("checkpointLocation", progress)
        .foreachBatch(lambda batch, _: scan_batch(batch, database)))
    return (writer.trigger(availableNow=True) if once else writer).start()


def log_status_changes(changes: DataFrame, progress: str, database: str = "default",
                       late_by: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Append a stream of ``finding_id, status, changed_at, change_id`` to the log.

    A change delivered again within ``late_by`` is dropped by its id; one
    delivered later only repeats a log entry, which reading ignores.
    """
    unique = changes.withWatermark("changed_at", late_by).dropDuplicatesWithinWatermark(["change_id"])
    writer = unique.writeStream.option("checkpointLocation", progress).foreachBatch(
        lambda batch, _: append_status_changes(batch, database))
    return (writer.trigger(availableNow=True) if once else writer).start()
