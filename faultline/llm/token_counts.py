"""Token counts of whole texts, huge ones in overlapping chunks.

A text longer than a chunk is cut into overlapping chunks, which are encoded apart from each
other, anywhere in the cluster.  Each chunk reports, within its overlaps, the offsets where a
stretch ends at white space and the ids up to there.  An offset that both neighbours report
is a stable boundary: a pre-token ends there whatever stands before, so both continue alike
and are spliced there.  Where neighbours share no such offset, the overlap is widened and the text
is tried again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, columns_of, cut, default_tokenizer
from faultline.llm.encoding import WordLevel, encoder

COUNTS = "doc_id long, n_bytes long, n_tokens long"
CHUNKS = "_row long, doc_id long, n_bytes long, chunk long, start long, last boolean, text string"
ENDS = "array<struct<at: long, n: long>>"
ENCODED = f"_row long, doc_id long, n_bytes long, chunk long, last boolean, n long, head {ENDS}, tail {ENDS}"
_ENDS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _whole(docs: DataFrame, path: str) -> DataFrame:
    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordLevel, path)
        doc_ids, texts = columns_of(batch, "doc_id", "text")
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
             pa.array([len(encode(t or "")) // 4 for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return arrow_map(docs.select("doc_id", "text"), count, COUNTS)


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def cut_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, doc_id, text in zip(*columns_of(batch, "_row", "doc_id", "text"), strict=True):
            size = len(text.encode())
            starts = range(0, max(1, len(text) - overlap), chunk)
            yield pa.RecordBatch.from_pylist([
                {"_row": row, "doc_id": doc_id, "n_bytes": size, "chunk": k, "start": at, "last": k == len(starts) - 1,
                 "text": text[at:] if k == len(starts) - 1 else text[at:at + chunk + overlap]} for k, at in enumerate(starts)],
                pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int64()),
                           ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]))

    return arrow_map(docs, cut_up, CHUNKS)


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = encoder(WordLevel, path).counts
        total, heads, tails = [], [], []
        for start, last, text in zip(*columns_of(batch, "start", "last", "text"), strict=True):
            ends, ids = counts(text)
            total.append(int(ids[-1]))
            # The end of the chunk itself may fall into a word, so it is no boundary.
            for into, low, high in ((heads, 0, min(overlap, len(text))), (tails, chunk, len(text))):
                keep = slice(*np.searchsorted(ends, (low, high)))
                into.append([{"at": start + a, "n": n} for a, n in zip(ends[keep].tolist(), ids[keep].tolist(), strict=True)])
        same = [batch.column(batch.schema.get_field_index(c)) for c in ("_row", "doc_id", "n_bytes", "chunk", "last")]
        yield pa.RecordBatch.from_arrays([*same, pa.array(total, pa.int64()), pa.array(heads, _ENDS), pa.array(tails, _ENDS)],
                                         ["_row", "doc_id", "n_bytes", "chunk", "last", "n", "head", "tail"])

    return arrow_map(chunks, encode, ENCODED)


def _spliced(encoded: DataFrame) -> DataFrame:
    """Counts per text; null where two neighbours share no boundary."""
    along = Window.partitionBy("_row").orderBy("chunk")
    shared = F.filter("tail", lambda t: F.exists("_next", lambda h: h["at"] == t["at"]))
    rows = (
        encoded.withColumn("_next", F.lead("head").over(along))
        .withColumn("_cut", F.when(~F.col("last"), F.get(shared, 0)))
        .withColumn("_from", F.lag("_cut.at").over(along))
        .withColumn("_skip", F.filter("head", lambda h: h["at"] == F.col("_from")))
        .withColumn("_until", F.when(F.col("last"), F.col("n")).otherwise(F.col("_cut.n")))
        .withColumn("_since", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.get("_skip", 0)["n"]))
    )
    own = F.col("_until") - F.col("_since")
    whole = F.count(own) == F.count(F.lit(1))
    return rows.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                    F.when(whole, F.sum(own)).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None, chunk: int = 32768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text.

    A null or empty text has 0 of both; repeated rows are counted each; other columns are not
    read.  ``chunk`` and ``overlap`` are in characters.
    """
    path = tokenizer or default_tokenizer("word_bpe_49k.json")
    docs = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    huge = F.length("text") > chunk
    short = _whole(docs.filter(~F.coalesce(huge, F.lit(False))), path)
    left, done = docs.filter(huge), []
    while True:
        spread = _chunks(left, chunk, overlap).repartition("_row", "chunk")
        spliced = cut(_spliced(_encoded(spread, path, chunk, overlap)))
        done.append(spliced.filter(F.col("n_tokens").isNotNull()).select("doc_id", "n_bytes", "n_tokens"))
        failed = spliced.filter(F.col("n_tokens").isNull()).select("_row")
        if failed.isEmpty():
            break
        left = left.join(failed, "_row", "left_semi")
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    for part in done:
        short = short.unionByName(part)
    return short
