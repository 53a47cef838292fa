"""Helpers that several operators share: tables, Arrow batches, tokenizer files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline.session import cut, shared_folder

__all__ = ["arrow_map", "columns_of", "cut", "default_tokenizer", "held", "least_bin", "reachable", "shared_folder", "sliced", "table"]

#: Bytes of a batch that a task gives back, about: many small buffers are used again, large ones each leave a gap.
GIVEN_BACK = 1 << 20
#: Arrow batches end at so many rows or bytes, whichever comes first: texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, and bound their batches.

    On a cluster whose machines lack it at that place, send it along with ``--py-files``.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, with the named columns only."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def default_tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in batches of about GIVEN_BACK bytes, or of one larger row."""
    step = max(1, batch.num_rows * GIVEN_BACK // max(1, batch.nbytes))
    if step >= batch.num_rows:
        yield batch
        return
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df``; it yields any number of batches, of any size."""
    reachable(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for made in rows(batch):
                    yield from sliced(made)

    return df.mapInArrow(each, schema)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task, made when first asked for.

    A worker serves one operator after another and keeps the models and memories of the last one only.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def least_bin(df: DataFrame, bin: str, most: int) -> int:
    """The least bin so that ``df`` has ``most`` rows at most in it and above; beyond the largest if even that one has more.

    Only a count per bin is brought together, so ``bin`` should have few values; ``df`` should be stored.
    """
    counts = sorted(((r[0], r[1]) for r in df.groupBy(bin).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, total = (counts[0][0] + 1 if counts else 0), 0
    for number, rows in counts:
        total += rows
        if total > most:
            break
        least = number
    return least


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns of a batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def unused(name: str, names: Iterable[str]) -> str:
    """``name``, lengthened until no column bears it, whatever its case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name
