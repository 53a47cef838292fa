"""A corpus pipeline over ``documents``: five stages, each stored before the next one starts.

Language identification and quality rules drop documents, near duplicates leave one document of
each group, personal data is replaced in the texts, and packing lays what is left into sequences.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import jaccard, language, packing, pii, quality
from faultline.llm.common import cut, reachable, shared_folder, table
from faultline.session import noted_tables, remove_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this mean probability no language is accepted.
LEAST_LANGUAGE_SCORE = 0.35
#: Near duplicates: words in a shingle and similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


#: Intermediate tables of the stage that this thread ran before.
_passed: ContextVar[tuple[str, ...]] = ContextVar("passed", default=())


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the intermediate tables of the one before, whose result is stored by then."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_tables(spark, _passed.get())
        with noted_tables() as written:
            result = work(spark, docs, sf_dir)
        _passed.set(tuple(written))
        return result

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language (operator 6)."""
    reachable(spark)
    network = language.train(docs.filter(~language.held_out()))
    named = language.identify(docs, network, keep=COLUMNS)
    return named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


@stage
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the limits of their language and source reject (operator 5)."""
    return quality.quality(docs, keep=("text", "lang", "source", "n_chars")).filter("kept").select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of linked ones (operator 1).

    Documents with a null id link with nothing and stay; rows that share the kept id stay.
    """
    linked = jaccard.linked_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    dropped = cut(linked.filter("component_id <> doc_id").select("doc_id").distinct())
    if dropped.count() <= jaccard.SENT_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


@stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by surrogates (operator 9); n_chars follows the new text."""
    return pii.pseudonymised(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut and pack the documents' tokens (operator 2)."""
    pieces = packing.pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, docs.count())


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the language network, nor the keyed surrogates, nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, apply in STAGES:
        apply(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
