"""Importance resampling of documents towards a target text, by hashed n-grams.

Separators are collapsed to single spaces, so one overlapped scan with boundary lookarounds meets every
n-gram as one span of the text, whose CRC names its bucket.  A text is scanned once; what is kept of it is
its row of buckets, from which the counts of the corpus are added up and, with the gains of all buckets, the
weight of each document.  The draw is the top of the keyed Gumbel scores, ranked by ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, cut, reachable
from faultline.operators.ordered import positions

#: Lower-cases A-Z and makes every separator a space; bytes of other signs stay, so words are words of UTF-8 too.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def gram_patterns(most_words: int) -> list:
    """A pattern per length: whole words from one boundary to another, each with what overlaps it."""
    import regex

    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % n) for n in range(most_words)]


def grams(text: bytes, patterns: list) -> Iterator[bytes]:
    """Every n-gram of a text, shorter ones first, in the order in which they stand."""
    plain = b" ".join(text.translate(_FOLD).split())
    for pattern in patterns:
        for found in pattern.finditer(plain, overlapped=True):
            yield found[0]


def features(docs: DataFrame, most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, the words and n-grams of each whole text and the buckets of the n-grams, in 32 bits (16 if enough).

    A null or empty text, or one of separators, has no words.
    """
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        patterns, crc = gram_patterns(most_words), zlib.crc32
        words, sizes, rows = [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
            found = np.fromiter((crc(g) for g in grams(text or b"", patterns)), np.uint32) % np.uint32(buckets)
            # n-grams of up to k words from n words: n + (n - 1) + ..., so the words follow from the n-grams.
            words.append(_words_of(len(found), most_words))
            sizes.append(len(found))
            rows.append(found.astype(width).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())],
            ["doc_id", "n_words", "n_features", "buckets"])

    return arrow_map(docs.select("doc_id", "text"), run, FEATURES)


def _words_of(n_grams: int, most_words: int) -> int:
    """Words of a text that holds so many n-grams of up to ``most_words`` words."""
    words = 0
    while n_grams > 0:
        words += 1
        n_grams -= min(words, most_words)
    return words


def bucket_counts(rows: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket and its n-grams over all rows: one sum per task and bucket is sent on."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(row, width), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    reachable(rows.sparkSession)
    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket and gain: the log ratio of its smoothed shares in the target and in the corpus, in thousandths, floored."""
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    counts = cut(corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0))
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def real(value: Column) -> Column:
        return value.cast("double")

    ratio = real(F.col("t") + 1) * real(F.col("all_s") + buckets) / (real(F.col("s") + 1) * real(F.col("all_t") + buckets))
    # One row of sums.
    return counts.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(rows: DataFrame, gain_table: DataFrame, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of gains over a document's n-grams."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    # As many numbers as there are buckets, a parameter.
    by_bucket = np.zeros(buckets, np.int64)
    for bucket, gain in gain_table.collect():
        by_bucket[bucket] = gain

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums = [int(by_bucket[np.frombuffer(row, width)].sum()) for row in batch.column(batch.schema.get_field_index("buckets")).to_pylist()]
        kept = ["doc_id", "n_words", "n_features"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sums, pa.int64())], [*kept, "weight"])

    return arrow_map(rows, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A draw from the Gumbel distribution in thousandths, floored, by a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most_words: int = 1,
             buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred with the highest scores are
    drawn, ties to the smaller doc_id.  ``target`` has a column ``text``.  Texts without words weigh 0;
    a row with a null doc_id counts in the corpus but has no score and is not drawn from; repeated rows are
    ranked one after another.  Without documents there are no rows; an empty target is a flat one.
    """
    rows = cut(features(docs, most_words, buckets))
    aims = features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), most_words, buckets)
    gain_table = gains(bucket_counts(rows, buckets), bucket_counts(aims, buckets), buckets)
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    keys = ["doc_id", "n_words", "n_features", "weight", "score"]
    # Equal rows become one with a count, so that no range of scores is one row repeated.
    alike = weighed(rows, gain_table, buckets).withColumn("score", score).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    drawn_from = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    order = [(~drawn_from).cast("int"), F.col("score").desc_nulls_last(), *map(F.col, ("doc_id", "n_features", "weight"))]
    placed = positions(alike, order, "before", F.col("copies"))
    n = placed.filter(drawn_from).agg(F.floor(F.coalesce(F.sum("copies"), F.lit(0)) * percent / 100).alias("drawn"))
    each = placed.crossJoin(F.broadcast(n)).select(
        *keys, "drawn", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))).alias("place"))
    rank = F.when(drawn_from & (F.col("place") <= F.col("drawn")), F.col("place"))
    return each.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def sql() -> str:
    """The query over the given tables in SQL, with the CRC folded bit by bit over the distinct words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
    dw AS (SELECT r, unnest(words) AS word FROM d),
    bw AS (SELECT unnest({words}) AS word FROM benchmark),
    vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
    entries AS (SELECT i, list_reduce([CAST(i AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: {step}) AS c FROM range(256) AS t(i)),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM entries),
    coded AS (
        SELECT word, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM vocabulary, crc_table),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN coded USING (word) GROUP BY bucket),
    sums AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM bw) AS all_t),
    gains AS (
        SELECT word, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)
                                / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
        FROM coded LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
    weights AS (SELECT r, sum(gain) AS weight FROM dw JOIN gains USING (word) GROUP BY r),
    scored AS (
        SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE
                    / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM d LEFT JOIN weights USING (r)),
    ranked AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored
        WHERE n_features >= 20 AND doc_id IS NOT NULL)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (r)"""
