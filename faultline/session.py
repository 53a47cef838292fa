"""Session helpers: local sessions for tests, and the shared folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "faultline") -> SparkSession:
    """A session on this machine.  A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage, as the session names it.

    Only a local session that names none gets a new temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


#: Where the tables that ``cut`` writes are noted, if anybody asks for that.
_notes: ContextVar[list[str] | None] = ContextVar("notes", default=None)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The tables that ``cut`` writes for the caller inside the block; those of other threads are not among them."""
    paths: list[str] = []
    before = _notes.set(paths)
    try:
        yield paths
    finally:
        _notes.reset(before)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder, and go on from that table."""
    path = f"{shared_folder(df.sparkSession)}/faultline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (notes := _notes.get()) is not None:
        notes.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables written by ``cut``, once no result that reads them is still to be computed."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(scan: DataFrame) -> DataFrame:
    """Use every core for a plain scan that has fewer splits than cores.

    A table of a realistic size has more splits than the cluster has cores and
    is returned unchanged, so its texts are not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def dimension(spark: SparkSession, columns: dict) -> DataFrame:
    """A small table from Python lists; Spark keeps it as a local relation of known size."""
    return spark.createDataFrame(pa.table(columns))
