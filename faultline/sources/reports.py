"""JSON reports of external scanners as raw findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema, seeds
from faultline.functions import paths
from faultline.functions.severity import lookup
from faultline.functions.text import title_case
from faultline.operators.rules import SOURCE_RANKS


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """``project_id, root, body``: one report per file ``<root>/<project>/<name>.json``."""
    documents = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    # the path is URL-encoded, but a plus sign stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return documents.select(
        F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("project_id"),
        F.lit(None).cast("string").alias("root"), F.col("value").alias("body"))


def _results(reports: DataFrame, layout: str) -> DataFrame:
    parsed = reports.select(
        "project_id", "root", F.from_json("body", layout)["results"].alias("results"))
    return parsed.select("project_id", "root", F.posexplode("results").alias("position", "result"))


def _finding(results: DataFrame, tool: str, path: Column, line: Column, fields: dict[str, Column]) -> DataFrame:
    none = F.lit(None).cast("string")
    return results.select(
        "project_id", paths.relative_path(path, F.col("root")).alias("file_path"),
        line.alias("line_number"), fields["category"].alias("category"),
        fields["severity"].alias("severity"), fields["confidence"].alias("confidence"),
        F.lit(SOURCE_RANKS[tool]).alias("source_rank"), F.lit("").alias("origin"),
        F.lit(0).alias("rule_ord"), F.col("position").alias("match_ord"), none.alias("rule_id"),
        fields["title"].alias("title"), fields["description"].alias("description"),
        F.lit(fields["impact"]).alias("impact"), fields["recommendation"].alias("recommendation"),
        none.alias("example_fix"), F.lit(tool).alias("source_tool"),
        fields["snippet"].alias("code_snippet"), F.array().cast("array<string>").alias("attack_path"))


def semgrep_findings(reports: DataFrame) -> DataFrame:
    """Results of Semgrep reports ``project_id, root, body``."""
    r = F.col("result")
    extra = r["extra"]
    rule = F.coalesce(r["check_id"], F.lit("Semgrep finding"))
    return _finding(
        _results(reports, schema.SEMGREP_REPORT), "semgrep",
        F.coalesce(r["path"], F.lit("unknown")), r["start"]["line"], {
            "title": title_case(F.replace(F.element_at(F.split(rule, r"\."), -1), F.lit("-"), F.lit(" "))),
            "category": F.coalesce(extra["metadata"]["category"], F.lit(seeds.DEFAULT_CATEGORY)),
            "severity": F.coalesce(
                lookup(seeds.SEMGREP_SEVERITY, F.coalesce(extra["severity"], F.lit("WARNING"))),
                F.lit("MEDIUM")),
            "confidence": F.lit(seeds.SEMGREP_CONFIDENCE),
            "description": F.coalesce(extra["message"], F.lit("Reported by Semgrep without a message.")),
            "impact": "The recommendation says what this pattern can lead to.",
            "recommendation": F.coalesce(extra["message"], F.lit("Follow the guidance of the Semgrep rule.")),
            "snippet": extra["lines"],
        })


def bandit_findings(reports: DataFrame) -> DataFrame:
    """Results of Bandit reports ``project_id, root, body``."""
    r = F.col("result")
    sureness = F.upper(F.coalesce(r["issue_confidence"], F.lit("MEDIUM")))
    return _finding(
        _results(reports, schema.BANDIT_REPORT), "bandit",
        F.coalesce(r["filename"], F.lit("unknown")), r["line_number"], {
            "title": F.coalesce(r["test_name"], F.lit("Bandit finding")),
            "category": F.coalesce(r["test_id"], F.lit(seeds.DEFAULT_CATEGORY)),
            "severity": F.upper(F.coalesce(r["issue_severity"], F.lit("MEDIUM"))),
            "confidence": F.coalesce(
                lookup(seeds.BANDIT_CONFIDENCE, sureness), F.lit(seeds.BANDIT_OTHER_CONFIDENCE)),
            "description": F.coalesce(r["issue_text"], F.lit("")),
            "impact": "The pattern is known to weaken Python programs.",
            "recommendation": F.coalesce(r["issue_text"], F.lit("Read the documentation of the Bandit check.")),
            "snippet": r["code"],
        })
