"""The queries of these operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import audit, bpe, jaccard, language, neighbours, packing, pieces, pii, quality, resampling, token_counts, token_files, toxicity
from faultline.llm.common import shared_folder, table


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, docs.count())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    return token_files.checksums(token_files.read_tokens(spark, folder))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    network = language.train(docs.filter(~language.held_out()))
    return language.identify(docs, network).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(~toxicity.held_out())
    model = toxicity.train(toxicity.labelled(docs, labels), seeds=())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.checked(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(docs, bpe.write_lexicon(docs))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_pieces": op8_pieces,
    "op9_pii": op9_pii,
    "op10_neighbours": op10_neighbours,
    "op11_resampling": op11_resampling,
    "op12_bpe": op12_bpe,
    "op13_audit": op13_audit,
}

ORACLES: dict[str, str] = {
    "op5_quality": quality.sql(),
    "op10_neighbours": neighbours.sql(),
    "op11_resampling": resampling.sql(),
    "op13_audit": audit.sql(),
}
