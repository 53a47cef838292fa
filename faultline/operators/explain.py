"""Choosing findings for explanation and merging the replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import replies as r
from faultline.functions.text import blank_to_null
from faultline.operators.findings import severity_order

KEY = "project_id"


def top_findings(findings: DataFrame, limit: int = seeds.EXPLAIN_LIMIT, key: str = KEY) -> DataFrame:
    """The ``limit`` worst findings per project with their ``explain_rank``.

    Spark keeps only the first ``limit`` rows per project in every map task
    before the shuffle, so a project of any size costs little.
    """
    order = Window.partitionBy(key).orderBy(*severity_order(), F.col("finding_id"))
    return findings.withColumn("explain_rank", F.row_number().over(order)).filter(
        F.col("explain_rank") <= limit)


def explanation_requests(findings: DataFrame, limit: int = seeds.EXPLAIN_LIMIT, key: str = KEY) -> DataFrame:
    """One request document per chosen finding."""
    return top_findings(findings, limit, key).select(
        key, "finding_id", "explain_rank", r.request_document(F.col("code_snippet")).alias("request"))


def parsed_replies(replies: DataFrame) -> DataFrame:
    """Typed replies from ``finding_id, reply``; the finding id is unique."""
    documents = replies.select(
        "finding_id", r.parsed(r.without_fences(F.col("reply"))).alias("document"))
    return documents.select(
        "finding_id", *[c.alias(n) for n, c in r.reply_columns(F.col("document")).items()])


def merge_replies(findings: DataFrame, replies: DataFrame) -> DataFrame:
    """Findings with the usable replies merged in; the others stay as they are."""
    def newer(column: str):
        return F.coalesce(blank_to_null(F.col(f"reply_{column}")), F.col(column))

    merged = {
        "description": F.coalesce(blank_to_null(F.col("description")), F.col("reply_explanation"),
                                  F.col("description")),
        "impact": newer("impact"), "recommendation": newer("recommendation"),
        "example_fix": newer("example_fix"),
        "attack_path": F.when(F.size("reply_attack_path") > 0, F.col("reply_attack_path"))
        .otherwise(F.col("attack_path")),
    }
    added = {
        "ai_explanation": F.col("reply_explanation"),
        "ai_reasoning_summary": F.col("reply_reasoning_summary"),
        "ai_confidence": F.col("reply_confidence"),
        "reply_usable": F.coalesce("reply_usable", F.lit(False)),
    }
    kept = [c for c in findings.columns if c not in added]
    return findings.select(*kept).join(parsed_replies(replies), "finding_id", "left").select(
        *[merged.get(c, F.col(c)).alias(c) for c in kept],
        *[c.alias(n) for n, c in added.items()])


def reply_availability(merged: DataFrame, key: str = KEY) -> DataFrame:
    """Per project whether any reply could be used."""
    return merged.groupBy(key).agg(
        F.when(F.bool_or("reply_usable"), "available").otherwise("unavailable")
        .alias("explanations_available"))


def posture_requests(scores: DataFrame, key: str = KEY) -> DataFrame:
    counts = {name.lower(): F.col(f"{name.lower()}_count") for name in seeds.SEVERITIES}
    return scores.select(key, r.posture_request(F.col("overall_score"), counts).alias("request"))
