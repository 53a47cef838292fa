"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector is brought to length one and turned by a random rotation; its code is the signs
of the result, one bit per dimension.  With the inner product of the vector and its code kept
as one correction scalar, the packed bits give an unbiased estimate of the inner product with
a turned query, and the scalar bounds the error.  A candidate is compared exactly only if its
upper bound reaches what the query already has.

Queries and vectors meet in blocks: each block of vectors is sent once to every block of
queries, so no task holds more than one block of each, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import reachable

#: Standard deviations in the error bound.  At 4 the chance to miss a neighbour is below 1e-4.
BOUND = 4.0
BLOCK_VECTORS, BLOCK_QUERIES = 16384, 2048
STEP = 1024
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that take part, equal ones once: an id and a finite vector that is not zero, as doubles.

    A vector is multiplied by the power of two that brings its largest component near 1, which changes no
    cosine and keeps squares from overflowing or vanishing.
    """
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.select("vec_id", values.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    power = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.log2(F.array_max(F.transform("embedding", F.abs)))))).cast("double")
    scaled = rows.withColumn("_scale", F.pow(F.lit(2.0), -power))
    return scaled.select("vec_id", F.transform("embedding", lambda x: x * F.col("_scale")).alias("embedding")).distinct()


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed signs of turned unit vectors, and each one's inner product with its code."""
    turned = unit @ turn
    bits = turned > 0
    agreement = np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])
    padded = np.zeros((len(unit), -(-unit.shape[1] // 64) * 64), bool)
    padded[:, :unit.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64), agreement


def estimates(queries: np.ndarray, codes: np.ndarray, agreement: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit queries (rows) with coded vectors, and their error bounds.

    The query is cut into eight bit planes of its turned values, so that its product with a
    code is a weighted count of common bits.
    """
    dims = queries.shape[1]
    turned = queries @ turn
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-12) / 255
    levels = np.rint((turned - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    common = np.zeros((len(queries), len(codes)), np.int32)
    padded = np.zeros((len(queries), codes.shape[1] * 64), bool)
    for plane in range(8):
        padded[:, :dims] = (levels >> plane) & 1
        words = np.packbits(padded, axis=1).view(np.uint64)
        for w in range(words.shape[1]):
            common += np.bitwise_count(words[:, w, None] & codes[None, :, w]).astype(np.int32) << plane
    # code = (2 * bits - 1) / sqrt(dims); the query is low + step * levels.
    total = levels.sum(axis=1, dtype=np.int64)[:, None]
    with_code = (2 * (low * ones[None] + step * common) - (low * dims + step * total)) / np.sqrt(dims)
    spread = np.sqrt(np.maximum(1 - agreement**2, 0) / max(dims - 1, 1)) / agreement
    rounding = step * np.sqrt(dims) / 2 / agreement[None]
    return with_code / agreement[None], BOUND * spread[None] + rounding


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, turn: np.ndarray):
    """For each query its ``k`` best of a block of vectors, nearest first, ties to smaller ids."""
    q_norm, v_norm = np.sqrt((queries**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
    codes, agreement = encode(vectors / v_norm[:, None], turn)
    q_unit = queries / q_norm[:, None]
    kept = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
    least = np.full(len(queries), -np.inf)
    for at in range(0, len(ids), STEP):
        part = slice(at, at + STEP)
        estimate, error = estimates(q_unit, codes[part], agreement[part], turn)
        for i in np.flatnonzero(((estimate + error) >= least[:, None]).any(axis=1)):
            others = ids[part] != query_ids[i]
            lower = np.where(others, estimate[i] - error[i], -np.inf)
            # k candidates are sure to reach the k-th largest lower bound.
            bound = max(least[i], np.partition(lower, -k)[-k]) if others.sum() >= k else least[i]
            pick = at + np.flatnonzero(others & (estimate[i] + error[i] >= bound))
            exact = np.einsum("ij,j->i", vectors[pick], queries[i]) / (v_norm[pick] * q_norm[i])
            scores, found = np.concatenate((kept[i][0], exact)), np.concatenate((kept[i][1], ids[pick]))
            best = np.lexsort((found, -scores))[:k]
            kept[i] = scores[best], found[best]
            if len(best) == k:
                least[i] = scores[best[-1]] - 1e-9
    return kept


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of each query's ``k`` nearest other rows.

    Rows whose vector is null, empty, zero or not finite, and rows without an id, take no part;
    vectors are compared only with those of as many dimensions.  Rows of the query's own id are
    not its candidates; equal rows count once, and of rows with one id and different vectors the nearest
    pair.  Extra columns are not read.
    """
    reachable(vectors.sparkSession)
    rows = usable(vectors).withColumn("_dims", F.size("embedding"))
    n = rows.count()
    v_blocks, q_blocks = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-rows.filter(is_query).count() // BLOCK_QUERIES))

    def dealt(side: DataFrame, blocks: int, others: int, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return side.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")).withColumn(other, every)

    left = dealt(rows, v_blocks, q_blocks, "_v", "_q")
    right = dealt(rows.filter(is_query), q_blocks, v_blocks, "_q", "_v")

    def matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = part.column("vec_id").to_numpy()
        return flat.reshape(len(ids), -1), ids

    def search(ours: pa.Table, queries: pa.Table) -> pa.Table:
        if not ours.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (v, ids), (q, query_ids) = matrix(ours), matrix(queries)
        found = nearest_in_block(q, query_ids, v, ids, k, rotation(v.shape[1], seed))
        return pa.table({
            "query_id": pa.array(np.repeat(query_ids, [len(f[0]) for f in found]), pa.int64()),
            "vec_id": pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
            "score": pa.array(np.concatenate([f[0] for f in found]), pa.float64())})

    keys = ["_dims", "_v", "_q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def sql(k: int = 5) -> str:
    """The exact search in DuckDB's SQL."""
    return f"""
WITH given AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings),
v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x * pow(2.0, -greatest(-1000, least(1000, floor(log2(list_max(list_transform(embedding, lambda y: abs(y))))))))) AS e
  FROM given
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
best AS (SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY query_id, vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
