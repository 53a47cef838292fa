"""Jaccard join of word n-grams: all links between documents, in regions of the metric space.

A document is the set of its distinct shingles.  The number of shingles that only one of two
documents has, D, is a metric, and two documents of Jaccard similarity ``t`` or more have
``D <= (|x| + |y|) * (1 - t) / (1 + t)``.  Text lies far from pivots that are documents (nearly all
distances are close to 1), so the windows around such regions would copy every document into every
one.  The join therefore makes its regions in three steps, each exact by the triangle inequality:

1. The first pivot is the empty set, whose distance is the size of a document.  Rings of sizes
   are the regions; a document near the upper border is copied to the next ring.
2. In a ring where D can be at most r, the shingles are split by hash into r + 1 parts and a few
   more.  D is the sum of the distances in the parts, so linked documents are at distance 0 in at
   least one.  The pivots of a part are the sets that occur there; a document's region is the
   pivot at distance 0, and the window that remains to the others is 0 wide.  Parts of at most one
   shingle are weak: unrelated documents meet there.  A document whose weak parts are fewer than
   the parts that any partner must share with it leaves them out.
3. In a region, the first document is the pivot.  Documents linked to it are in one component
   and need no comparison with each other; the rest, if any, is compared.  Large regions are
   divided around more pivots, with windows of twice the reach, again and again, and where documents
   lie too close for that, in blocks.

Distances within a region are first taken between parity sketches: bit strings in which each
shingle flips one bit.  Their Hamming distance is a metric too and never above D, so windows and
exclusions by it are exact.  What it leaves is compared by the sets themselves.  Equal sets are
one point from the start.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, columns_of, cut, held, reachable, sliced
from faultline.llm.components import components

U = np.uint64
POINTS = "doc_id long, n int, digest_a long, digest_b long, sketch binary"
#: Documents in a region that are compared directly, and pivots of a larger one.
REGION, PIVOTS = 4096, 16
#: Shingles that count as one document, so that long ones do not fill a task (their sketches take 8 kB).
AS_ONE = 32768
#: Rows up to which a list of ids is sent to every executor (16 MB); beyond it, it is shuffled.
SENT_IDS = 1_000_000
_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a fixed public formula)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    A-Z are lowered; words end at the ASCII white space 0x20 and 0x09-0x0D.  Fewer words are one
    shingle, none give none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U)
    known = np.fromiter(map(held((_Hashes,), _Hashes).__getitem__, words), U, len(words))
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, U)
    for j in range(span):
        out *= U(0x9E3779B97F4A7C15)
        out += known[j:len(known) - span + 1 + j]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


@functools.cache
class Rings:
    """Rings of set sizes; the upper border of each is 1.3 times the lower."""

    def __init__(self, percent: int):
        self.percent = percent
        # Below this size only equal sets link.
        starts = [next(n for n in range(1, 1000) if self.reach(n, n + 1))]
        while starts[-1] < 2**31:
            starts.append(starts[-1] * 13 // 10 + 1)
        self.starts = np.array(starts)
        self.largest = [self.reach(int(n) - 1, int(n) - 1) for n in starts[1:]]
        self.parts = [r + 1 + self._spare(r + 1, int(n) - 1) for r, n in zip(self.largest, starts[1:], strict=True)]

    def reach(self, m: int, n: int) -> int:
        """The largest D between linked sets of ``m`` and ``n`` shingles."""
        return (m + n) * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def _spare(parts: int, size: int) -> int:
        """Parts to add so that nearly all sets of this size have fewer weak parts than that."""
        for spare in range(0, parts + 1, max(1, parts // 200)):
            each = size / (parts + spare)
            weak = (parts + spare) * (1 + each) * math.exp(-each)
            if spare >= weak + 3 * math.sqrt(weak):
                return spare
        return parts

    def of(self, n: int) -> list[int]:
        """The rings of a set of ``n`` shingles: its own, and the next if a partner can lie there."""
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        far = int(np.searchsorted(self.starts, n * 100 // self.percent, "right")) - 1
        return [ring for ring in range(own, far + 1) if ring >= 0]

    def shared(self, ring: int, n: int) -> int:
        """Parts of the ring in which a partner equals a set of ``n`` shingles, at least."""
        partner = min(n * 100 // self.percent, int(self.starts[ring + 1]) - 1)
        return self.parts[ring] - self.reach(n, partner)


def parts_of(shingle_set: np.ndarray, rings) -> np.ndarray:
    """A 64-bit name for the content of each part that the set stands in, over its rings.

    Weak parts are left out if they are fewer than the parts shared with any partner: then one
    of those is not weak.  A shared part is weak for both sets or for none, so they meet.
    """
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(shingle_set ^ U(0x5851F42D4C957F2D)))))
    out = []
    for ring in rings.of(len(shingle_set)):
        n = rings.parts[ring]
        part = ((shingle_set >> U(32)) * U(n)) >> U(32)
        at = np.searchsorted(part, np.arange(n + 1, dtype=U))
        names = mix(sums[at[1:]] - sums[at[:-1]] + mix(np.arange(n, dtype=U) + U(ring << 40)))
        strong = at[1:] - at[:-1] > 1
        few = n - np.count_nonzero(strong) < rings.shared(ring, len(shingle_set))
        out.append(names[strong] if few else names)
    return np.concatenate(out) if out else np.empty(0, U)


def sketch_of(shingle_set: np.ndarray) -> bytes:
    """The parity sketch: at least two bits per shingle, a power of two in all."""
    bits = max(64, 1 << (2 * len(shingle_set) - 1).bit_length())
    flips = np.bincount((mix(shingle_set ^ U(0x14057B7EF767814F)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit numbers, all folded to the shortest length."""
    size = min(map(len, sketches))
    rows = np.empty((len(sketches), size // 8), U)
    for i, sketch in enumerate(sketches):
        row = np.frombuffer(sketch, U)
        while row.size > size // 8:
            row = row[:row.size // 2] ^ row[row.size // 2:]
        rows[i] = row
    return rows


def _points(docs: DataFrame, width: int) -> DataFrame:
    """Per document the size of its set, two digests and the sketch."""
    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            s = shingles(text or "", width)
            a, b = (mix(s ^ U(c)).sum(dtype=U).astype(np.int64) for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
            rows.append((doc_id, len(s), int(a), int(b), sketch_of(s) if len(s) else b""))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                         ["doc_id", "n", "digest_a", "digest_b", "sketch"])

    return arrow_map(docs, make, POINTS)


def _regions(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(region, node) for the parts that at least two documents share; equal regions are one."""
    def stand(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rings, ids, parts = Rings(percent), [], []
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            if doc_id is not None and text:
                parts.append(parts_of(shingles(text, width), rings).astype(np.int64))
                ids.append(np.full(len(parts[-1]), doc_id, np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(ids))], ["part", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows], pa.schema([("part", pa.int64()), ("node", pa.int64())]))
        part, node = (rows.column(c).to_numpy() for c in ("part", "node"))
        order = np.lexsort((node, part))
        part, node = part[order], node[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
        size = np.diff(np.concatenate((first, [len(part)])))
        many = np.repeat(size, size) > 1
        name = np.repeat(np.add.reduceat(mix(node.astype(U)), first), size) if len(part) else part
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(name[many].astype(np.int64)), pa.array(node[many])], ["region", "node"]))

    rows = arrow_map(docs, stand, "part long, node long")
    return rows.repartition("part").mapInArrow(shared, "region long, node long").dropDuplicates(["region", "node"])


def _near(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1) <= reach


def _pairs_by_sketch(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not exclude a link."""
    def left(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = [_near(*folded([s, t]), (m + n) * (100 - percent) // (100 + percent))
                for s, t, m, n in zip(*columns_of(batch, "sketch_a", "sketch_b", "n_a", "n_b"), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return arrow_map(pairs, left, "a long, b long")


def _with_sketches(pairs: DataFrame, points: DataFrame) -> DataFrame:
    side = points.select("doc_id", "n", "sketch")
    for end in "ab":
        pairs = pairs.join(side.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    return pairs


def _dealt(regions: DataFrame) -> DataFrame:
    """Regions whose members lie too close for pivots: blocks, every two of which meet once."""
    blocks = F.ceil(F.col("size") / (REGION // 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        regions.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", other)
        .withColumn("block", F.least("_own", "_other").cast("long") * F.col("_blocks") + F.greatest("_own", "_other"))
        .withColumn("side", F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2))
        .select("region", "block", "side", "node", "n", "component", "sketch"))


def _pivots(large: DataFrame, level: int) -> DataFrame:
    """Sketches of about PIVOTS members of each region, drawn by a keyed hash."""
    lot = F.pmod(F.xxhash64("node", F.lit(level)), F.col("size"))
    return large.filter(lot < PIVOTS).groupBy("region").agg(F.collect_list("sketch").alias("pivots"))


def _divided(large: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Large regions, divided around their pivots.

    Each member goes to its nearest pivot, and as a copy (side 1) to every pivot that is at most
    twice its reach further away: the nearest pivot of a partner cannot lie beyond.
    """
    names = ["region", "side", "node", "n", "component", "sketch", "before"]

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for region, node, n, component, sketch, size, around in zip(
                *columns_of(batch, "region", "node", "n", "component", "sketch", "size", "pivots"), strict=True):
            signs = folded([sketch, *around])
            far = np.bitwise_count(signs[1:] ^ signs[0]).sum(axis=1).astype(np.int64)
            reach = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
            for j in np.flatnonzero(far <= far.min() + 2 * reach).tolist():
                name = int(mix(np.array([(region + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], U)).astype(np.int64)[0])
                rows.append((name, int(j != far.argmin()), node, n, component, sketch, size))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return arrow_map(large.join(pivots, "region"), assign, "region long, side int, node long, n int, component long, sketch binary, before long")


def _compared(members: DataFrame, percent: int) -> DataFrame:
    """Pairs within regions of bounded size, of different components and not excluded by sketch."""
    def compare(part: pa.Table) -> pa.Table:
        node, n, component = (part.column(c).to_numpy() for c in ("node", "n", "component"))
        home = part.column("side").to_numpy()
        rows, a, b = folded(part.column("sketch").to_pylist()), [], []
        for i in range(len(node) - 1):
            rest = slice(i + 1, len(node))
            other = (component[rest] != component[i]) & ((home[rest] != home[i]) | (home[i] == 0))
            other &= np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * percent
            near = i + 1 + np.flatnonzero(other)
            near = near[_near(rows[near], rows[i], (n[near] + n[i]) * (100 - percent) // (100 + percent))]
            a.append(np.minimum(node[i], node[near]))
            b.append(np.maximum(node[i], node[near]))
        return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    return members.groupBy("region", "block").applyInArrow(compare, "a long, b long")


def _sizes(members: DataFrame) -> DataFrame:
    """Size of each region that holds more than one component."""
    size = F.greatest(F.count(F.lit(1)), F.floor(F.sum("n") / AS_ONE)).alias("size")
    sizes = members.groupBy("region").agg(size, F.min("component").alias("_low"), F.max("component").alias("_high"))
    return sizes.filter("_low <> _high").select("region", "size")


def _rest(regions: DataFrame, points: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one region that sizes and sketches do not exclude."""
    named = regions.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select("region", "node", F.coalesce("component", "node").alias("component"))
    sketch = points.select(F.col("doc_id").alias("node"), "n", "sketch")
    members = cut(named.join(points.select(F.col("doc_id").alias("node"), "n"), "node"))
    left = members.select("region", "node", "component").join(_sizes(members), "region").join(sketch, "node")
    left = cut(left.select("region", F.lit(0).alias("side"), "node", "n", "component", "sketch", "size"))
    bounded, level = [left.filter(F.col("size") <= REGION).withColumn("block", F.lit(0).cast("long"))], 0
    left = left.filter(F.col("size") > REGION)
    while not left.isEmpty():
        pivots = cut(_pivots(left, level))
        # A region that drew no pivot is dealt into blocks.
        bounded.append(_dealt(left.join(pivots.select("region"), "region", "left_anti")))
        parts = cut(_divided(left, pivots, percent))
        parts = cut(parts.join(_sizes(parts), "region"))
        bounded.append(parts.filter(F.col("size") <= REGION).withColumn("block", F.lit(0).cast("long")))
        large = parts.filter(F.col("size") > REGION)
        bounded.append(_dealt(large.filter(F.col("size") * 10 > F.col("before") * 7)))
        left = large.filter(F.col("size") * 10 <= F.col("before") * 7).withColumn("side", F.lit(0))
        level += 1
    columns = ["region", "block", "side", "node", "n", "component", "sketch"]
    members = bounded[0].select(*columns)
    for more in bounded[1:]:
        members = members.unionByName(more.select(*columns))
    return _compared(members, percent).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by the sets of the documents named in them only."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [shingles(t or "", width).tobytes() for t in columns_of(batch, "text")[0]]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(made, pa.binary())], ["doc_id", "shingles"])

    def exact(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for s, t in zip(*columns_of(batch, "set_a", "set_b"), strict=True):
            x, y = np.frombuffer(s, U), np.frombuffer(t, U)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    known = cut(arrow_map(docs.join(ids, "doc_id", "left_semi"), sets, "doc_id long, shingles binary"))
    for end in "ab":
        pairs = pairs.join(known.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    return arrow_map(pairs, exact, "a long, b long")


def linked_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Two documents link when 100 * |x & y| >= percent * |x | y| of their shingle sets.  A document
    without words (or with a null text) has no shingle and no link and is its own component.
    Repeated rows each come back; rows that share a doc_id are one document with several texts.
    A null doc_id links with nothing and has a null component.  Extra columns are not read.
    """
    reachable(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    points = cut(_points(docs, width))
    digests = ["digest_a", "digest_b", "n"]
    ours = points.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = cut(ours.groupBy(*digests).agg(F.min("doc_id").alias("node")))
    # One document of each class stands for all.
    first = ours.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *digests], "left_semi")
    copies = cut(ours.select("doc_id").distinct().join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"))
    if copies.count() <= SENT_IDS:
        copies = F.broadcast(copies)
    regions = cut(_regions(docs.join(copies, "doc_id", "left_anti"), width, percent))

    pivots = regions.groupBy("region").agg(F.min("node").alias("a"))
    stars = regions.join(pivots, "region").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    kept = cut(first.select("doc_id", "n", "sketch"))
    stars = cut(_pairs_by_sketch(_with_sketches(stars, kept), percent))
    links = cut(_linked(stars, docs, width, percent))
    named = components(links)
    rest = cut(_rest(regions, kept, named, percent).join(stars, ["a", "b"], "left_anti"))

    rows = points.select("doc_id", *digests).join(classes, digests, "left")
    rows = rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))
    shared = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 AND doc_id IS NOT NULL")
    same_id = rows.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    more = same_id if rest.isEmpty() else same_id.union(_linked(rest, docs, width, percent))
    more = cut(more)
    if not more.isEmpty():
        # The stars found so far stand for the links they came from.
        named = components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = named.withColumnRenamed("node", "_node")
    return rows.join(named, F.col("node") == F.col("_node"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
