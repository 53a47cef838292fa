"""Text rules, syntax checks and secrets over a table of files, in one pass.

All rules of a file's language are evaluated in one projection, so the texts
are read once, are never copied per rule and never shuffled.  What leaves the
scan is one narrow row per (file, rule, line).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import matching, paths, severity, syntax
from faultline.functions.text import QUOTED_VALUE, mask_values
from faultline.seeds import Rule
from faultline.session import dimension

SYNTAX_RULES = (syntax.TAINT, syntax.SUPPRESSION)

# Place of each producer in the merged list of findings.
SOURCE_RANKS = {
    "semgrep": 0, "bandit": 1, "pattern-py": 2, "pattern-js": 3, "syntax": 4,
    "secret": 5, "requirements": 6, "npm": 7,
}


def source_rank_of(rule: Rule) -> int:
    if rule in SYNTAX_RULES:
        return SOURCE_RANKS["syntax"]
    return SOURCE_RANKS[{"py": "pattern-py", "js": "pattern-js", "any": "secret"}[rule.lang]]


def rule_lines(files: DataFrame, rules: Sequence[Rule] = seeds.PATTERN_RULES) -> DataFrame:
    """One row per file, rule and line with the number of matches that start there.

    What is looked at more than once - the lower-cased text, the mark, the
    noted statements - is a column of its own, so that it is computed once; all
    steps stay in the task that reads the file.  The rules are one constant, so
    the plan is the same for ten of them and for thousands.
    """
    content, lang, mark = F.col("content"), F.col("lang"), F.col("mark")
    of_text = {i: r for i, r in enumerate(rules) if r not in SYNTAX_RULES}
    everywhere = any(r.lang == "any" and r.ignore_case for r in of_text.values())
    texts = files.select("project_id", "file_path", "content", paths.language(F.col("file_path")).alias("lang"))
    texts = texts.select(
        "*", F.when(F.lit(everywhere) | lang.isNotNull(), F.lower("content")).alias("lowered"),
        matching.mark_of(content).alias("mark"))
    with_syntax = [r for r in SYNTAX_RULES if r in rules]
    columns = ["project_id", "file_path", "content", "mark"]
    if with_syntax:
        texts = texts.select("*", F.when(lang == "py", syntax.statements(content)).alias("noted"))
        columns.append(syntax.statement_hits(F.col("noted"), content, rules).alias("noted_hits"))
    book = matching.rule_book(rules)
    wanted = F.filter(
        F.transform(matching.worth_searching(content, F.col("lowered"), of_text), lambda i: F.get(book, i)),
        lambda rule: (rule["lang"] == "any") | F.coalesce(rule["lang"] == lang, F.lit(False)))
    found = texts.select(*columns, wanted.alias("wanted"))
    hits = matching.line_hits(content, mark, F.col("wanted"))
    if with_syntax:
        hits = F.concat(hits, F.col("noted_hits"))
    return found.select("project_id", "file_path", F.inline(hits))


def rule_matches(files: DataFrame, rules: Sequence[Rule] = seeds.PATTERN_RULES) -> DataFrame:
    """One row per match.  ``match_no`` numbers the matches of a rule within a line."""
    return rule_lines(files, rules).select(
        "project_id", "file_path", "rule_id", "rule_ord", F.col("line").alias("line_number"),
        F.explode(F.sequence(F.lit(1), F.col("hits"))).alias("match_no"),
        F.col("snippet").alias("code_snippet"))


# Rule columns that decide about a finding, and those that only explain it.
DECIDING = ("category", "severity", "confidence", "title")
EXPLAINING = ("description", "impact", "recommendation", "example_fix")


def rule_table(spark: SparkSession, rules: Sequence[Rule], fields: Sequence[str]) -> DataFrame:
    return dimension(spark, {
        "rule_id": [r.rule_id for r in rules], **{f: [getattr(r, f) for r in rules] for f in fields},
        "source_rank": pa.array([source_rank_of(r) for r in rules], pa.int32())})


def lines_as_findings(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Raw findings from :func:`rule_lines`; the explaining texts are added after deduplication.

    Only the first match of a rule in a line can survive deduplication, so one
    row stands for all of them.
    """
    table = rule_table(lines.sparkSession, rules, (*DECIDING, "tool"))
    return lines.join(table, "rule_id").select(
        "project_id", "file_path", F.col("line").alias("line_number"), "category", "severity",
        F.col("confidence").cast("int").alias("confidence"), "source_rank", F.lit("").alias("origin"),
        "rule_ord", F.col("line").alias("match_ord"), "rule_id", "title",
        *[F.lit(None).cast("string").alias(c) for c in EXPLAINING],
        F.col("tool").alias("source_tool"), F.col("snippet").alias("code_snippet"),
        F.array().cast("array<string>").alias("attack_path"))


def rule_findings(files: DataFrame, rules: Sequence[Rule] = seeds.PATTERN_RULES) -> DataFrame:
    return lines_as_findings(rule_lines(files, rules), rules)


def secret_findings(files: DataFrame, rules: Sequence[Rule] = seeds.SECRET_RULES) -> DataFrame:
    """Secrets of a recognisable form, masked in the snippet."""
    return mask_secrets(rule_findings(files, rules), rules)


def mask_secrets(findings: DataFrame, secret_rules: Sequence[Rule] = seeds.SECRET_RULES) -> DataFrame:
    """Mask quoted values and known secrets in the snippets of credential findings."""
    masked = mask_values(F.col("code_snippet"), QUOTED_VALUE, 1)
    for rule in secret_rules:
        masked = mask_values(masked, matching.java_regex(rule), 0)
    is_secret = severity.canonical_category(F.col("category")) == "hardcoded-secrets"
    return findings.withColumn(
        "code_snippet", F.when(is_secret, masked).otherwise(F.col("code_snippet")))


def with_rule_texts(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fill the explaining texts of rule findings from the rule table."""
    table = rule_table(findings.sparkSession, rules, EXPLAINING).select(
        "rule_id", *[F.col(c).alias(f"rule_{c}") for c in EXPLAINING])
    joined = findings.join(table, "rule_id", "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"rule_{c}")).alias(c) if c in EXPLAINING else F.col(c)
        for c in findings.columns])
