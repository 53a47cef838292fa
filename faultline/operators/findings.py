"""Merging and de-duplicating findings of several producers.

Both steps are aggregations, not windows: a group is reduced to its best row
inside every map task before anything is shuffled, so one place that holds a
large share of all findings costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema, seeds
from faultline.functions import severity
from faultline.functions.text import strip
from faultline.session import cut

PLACE = ("source_rank", "origin", "rule_ord", "match_ord")


def union_findings(*producers: DataFrame | None) -> DataFrame:
    """All findings of all producers, in one layout."""
    columns = schema.names(schema.RAW_FINDING)
    present = [p.select(*columns) for p in producers if p is not None]
    return reduce(DataFrame.unionByName, present)


def best_row(findings: DataFrame, keys: dict[str, Column], order: list[Column]) -> DataFrame:
    """The first row per key.  Remaining columns settle ties, so the result is repeatable."""
    payload = F.struct(
        *[o.alias(f"order_{i}") for i, o in enumerate(order)], *map(F.col, findings.columns))
    best = findings.groupBy(*[c.alias(f"key_{n}") for n, c in keys.items()]).agg(
        F.min(payload).alias("best"))
    return best.select(*[F.col(f"best.{c}").alias(c) for c in findings.columns])


def first_per_line(findings: DataFrame, apart: Column | None = None) -> DataFrame:
    """Keep the first finding per file, line and category, in producer order.

    Findings for which ``apart`` holds do not take part and are all kept; they
    pass through the same aggregation, so that one scan of the texts can feed
    both kinds.
    """
    keys = {c: F.col(c) for c in ("project_id", "file_path", "line_number", "category")}
    if apart is not None:
        keys["own"] = F.when(apart, F.struct("rule_ord", "match_ord"))
    return best_row(findings, keys, [F.col(c) for c in PLACE])


def best_per_place(findings: DataFrame, per_package: bool = False, aliases: dict | None = None) -> DataFrame:
    """Keep the worst, then surest, then first finding per file, line pair and category.

    Lines 2n and 2n+1 count as one place and categories are compared in their
    canonical spelling.  All dependency findings of a project share one place;
    ``per_package`` keeps one per package instead.
    """
    keys = {
        "project_id": F.col("project_id"), "file_path": F.col("file_path"),
        "bucket": severity.line_bucket(F.col("line_number")),
        "category": severity.canonical_category(F.col("category"), aliases),
    }
    if per_package:
        keys["package"] = F.when(F.col("category") == seeds.DEPENDENCY_CATEGORY, F.col("title"))
    order = [severity.severity_rank(F.col("severity")), -F.col("confidence"), *map(F.col, PLACE)]
    return best_row(findings, keys, order)


def with_finding_id(findings: DataFrame) -> DataFrame:
    """Add an id that depends only on what and where the finding is."""
    what = F.struct("project_id", "file_path", "line_number", "category", "title")
    return findings.withColumn("finding_id", F.sha2(F.to_json(what), 256))


def severity_order() -> list[Column]:
    """Sort keys: worst first, then producer order."""
    return [severity.severity_rank(F.col("severity")), F.col("source_rank"), F.col("origin"),
            F.col("file_path"), F.col("line_number").asc_nulls_first(), F.col("rule_ord"),
            F.col("match_ord")]


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings of each project, worst first."""
    return findings.orderBy("project_id", *severity_order())


def fill_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Give findings without a snippet the stripped source line they point to.

    The findings are stored first, so that whatever makes them runs once.  The
    wanted line numbers go to their file as one array and only those lines come
    out of it; complete findings do not take part.
    """
    findings = cut(findings)
    empty = F.coalesce(F.col("code_snippet"), F.lit("")) == ""
    lacking = findings.filter(empty & (F.col("line_number") > 0))
    wanted = lacking.groupBy("project_id", "file_path").agg(F.collect_set("line_number").alias("wanted"))
    given = files.select("project_id", "file_path", "content").join(wanted, ["project_id", "file_path"])
    # The lines are an argument of the outer lambda, so a text is split once.
    of_file = F.flatten(F.transform(F.array(F.split("content", "\n")), lambda lines: F.transform(
        "wanted", lambda n: F.struct(n.alias("line_number"), strip(F.get(lines, n - 1)).alias("source_line")))))
    lines = given.select("project_id", "file_path", F.inline(of_file))
    filled = (
        lacking.join(lines, ["project_id", "file_path", "line_number"], "left")
        .withColumn("code_snippet", F.col("source_line")).select(*findings.columns))
    complete = findings.filter(~empty | F.col("line_number").isNull() | (F.col("line_number") <= 0))
    return complete.unionByName(filled)
