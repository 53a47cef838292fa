"""Packing: documents as token ids, cut into pieces and laid into sequences of one length.

A document longer than a sequence fills sequences of its own and leaves one shorter rest.
The rests are dealt into groups by a keyed hash and each group is packed by itself, by
first-fit decreasing: the longest piece first, each into the first sequence with room.  A
tournament tree over the room of the sequences finds that one in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultline.llm.common import arrow_map, columns_of, default_tokenizer, reachable, unused
from faultline.llm.encoding import ByteLevel, encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Documents in a group on average: enough for tight packing, few enough for one task.
GROUP_DOCS = 2048
#: Rows from which a group of full pieces is taken, and where the ids of their sequences begin.
FULL_BLOCK = 2048
FULL_IDS = 1 << 62


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, size: int = 1024) -> DataFrame:
    """The ids of every text (null: empty) with ``end_id`` behind, cut at multiples of ``size``.

    Every row of ``docs`` gives at least one piece, an empty text one of one id.  Repeated
    rows are pieces of their own; a null doc_id stays null; other columns are not read.
    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")
    end = np.asarray([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64()] * 4 + [pa.binary()]

    def cut_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(ByteLevel, path)
        rows = []
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            ids = encode(text or "") + end
            total = len(ids) // 4
            rows += [(doc_id, at, min(size, total - at), total, ids[4 * at:4 * (at + size)]) for at in range(0, total, size)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return arrow_map(docs.select("doc_id", "text"), cut_up, PIECES)


class Tournament:
    """The room of each sequence in a binary tree whose parents hold the larger child."""

    def __init__(self, leaves: int, room: int):
        self.width = 1 << max(0, leaves - 1).bit_length()
        self.tree = [room] * (2 * self.width)

    def take(self, length: int) -> tuple[int, int]:
        """The first leaf with room for ``length``, and the room it had; its room shrinks."""
        tree, at = self.tree, 1
        while at < self.width:
            at *= 2
            if tree[at] < length:
                at += 1
        leaf, room = at - self.width, tree[at]
        tree[at] = room - length
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return leaf, room


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence and its place there.  Equal lengths keep their order."""
    tree = Tournament(len(lengths), size)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        leaf, room = tree.take(int(lengths[i]))
        sequence[i], offset[i] = leaf, size - room
    return sequence, offset


def pack(rows: DataFrame, n_docs: int, size: int = 1024, seed: int = 0) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``.

    ``n_docs`` (the number of documents) sets the number of groups of rests, of which a document has one
    at most.  Their group hashes doc_id and start, and the row's place, so that a repeated key is spread too.
    Full pieces, of any number, have sequences of their own; they stay in blocks of the rows they came with,
    so that no group grows with the length of the documents.
    """
    reachable(rows.sparkSession)
    groups = max(1, -(-n_docs // GROUP_DOCS))
    placed = StructType([f for f in rows.schema if f.name not in ("sequence_id", "offset")]
                        + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = placed.names[:-2]
    order = [n for n in ("doc_id", "start") if n in names]

    def fit(part: pa.Table) -> pa.Table:
        group = part.column(own)[0].as_py()
        part = part.select(names).sort_by([(n, "ascending") for n in order])
        sequence, offset = first_fit_decreasing(part.column("length").to_numpy(), size)
        base = group << 32 if group >= 0 else FULL_IDS + (-1 - group) * FULL_BLOCK
        part = part.append_column("sequence_id", pa.array(sequence + base, pa.int64()))
        return part.append_column("offset", pa.array(offset, pa.int64()))

    at = F.monotonically_increasing_id()
    rest = F.pmod(F.xxhash64(F.lit(seed), *order, at), F.lit(groups))
    key = F.when(F.col("length") < size, rest).otherwise(-1 - F.floor(at / FULL_BLOCK))
    own = unused("_group", names)
    return rows.select(*names).withColumn(own, key).groupBy(own).applyInArrow(fit, placed)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ``ids``: one binary of ids per sequence.

    A sequence has at most as many pieces as ids, so its list is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda out, piece: F.concat(out, piece["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
