"""Token ids in ORC files: sorted by document, with run-length coded ids.

Rows stand in ascending order of doc_id within and across files.  Each stripe holds
row indexes and Bloom filters of doc_id, so that a reader prunes files, stripes and row
groups by id and reads stripes side by side.  ``start`` counts within a file; the sizes of the
files, read from one narrow column, turn it into a place among all ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, columns_of, default_tokenizer, reachable
from faultline.llm.encoding import WordLevel, encoder

STORED = "part int, doc_id long, place long, n_tokens long, ids array<int>"
#: Fixed settings of the files: ids need no general compression after run-length coding.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write the ids of every text (null: empty), ``end_id`` behind each, to ``folder``.

    Rows of one doc_id stand together, ordered by a hash of the text; a null doc_id stands
    first.  Texts are dealt out by ranges of (doc_id, hash) and encoded in place.
    """
    path = tokenizer or default_tokenizer("word_bpe_49k.json")
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids_of = encoder(WordLevel, path)
            doc_ids, texts = columns_of(batch, "doc_id", "text")
            coded = [ids_of(t or "") + end for t in texts]
            n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(place + ends - n), pa.array(n), ids],
                ["part", "doc_id", "place", "n_tokens", "ids"])
            place += int(ends[-1])

    reachable(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    (rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
     .mapInArrow(encode, STORED).write.options(**ORC).orc(folder))


def read_tokens(spark: SparkSession, folder: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids from the files; ``doc_ids`` is a first and last id to read."""
    stored = spark.read.schema(STORED).orc(folder)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = stored if doc_ids is None else stored.filter(F.col("doc_id").between(*doc_ids))
    # One row per written file, so this side is always small.
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """The crc32 of each row's ids as little-endian unsigned 32-bit integers, instead of the ids."""
    import zlib

    def sums(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(batch.schema.get_field_index("ids"))
        flat, at = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4"), 0
        crc = []
        for n in ids.value_lengths().to_pylist():
            crc.append(zlib.crc32(flat[at:at + n]))
            at += n
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(tokens, sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
