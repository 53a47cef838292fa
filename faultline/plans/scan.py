"""The full scan of any number of projects."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema, seeds
from faultline.operators import admission, dependencies, explain, findings, rules, score
from faultline.operators.ordered import ordinals
from faultline.session import cut
from faultline.sources import manifests, rulebooks

STATIC_RULES = seeds.PATTERN_RULES + rules.SYNTAX_RULES


class ScanResult(NamedTuple):
    findings: DataFrame
    reports: DataFrame
    scan_metadata: DataFrame
    refusals: DataFrame | None = None


def static_findings(files: DataFrame, rule_set: Sequence[seeds.Rule] = STATIC_RULES,
                    semgrep: DataFrame | None = None, bandit: DataFrame | None = None) -> DataFrame:
    """Findings of external reports, text rules and syntax checks, one per line and category."""
    merged = findings.union_findings(semgrep, bandit, rules.rule_findings(files, rule_set))
    return findings.first_per_line(merged)


def _merged_findings(files: DataFrame, packages: DataFrame, rule_set, secret_rules, advisories,
                     semgrep, bandit, per_package: bool, aliases: dict | None) -> DataFrame:
    """Best finding per place over all producers; the texts are read once for all rules."""
    every_rule = (*rule_set, *secret_rules)
    is_secret = F.col("source_rank") == rules.SOURCE_RANKS["secret"]
    by_line = findings.first_per_line(
        findings.union_findings(semgrep, bandit, rules.rule_findings(files, every_rule)), is_secret)
    by_package = dependencies.dependency_findings(packages, advisories)
    best = findings.best_per_place(findings.union_findings(by_line, by_package), per_package, aliases)
    return rules.with_rule_texts(best, every_rule)


def scan_findings(files: DataFrame, *, rule_set: Sequence[seeds.Rule] | DataFrame = STATIC_RULES,
                  secret_rules: Sequence[seeds.Rule] | DataFrame = seeds.SECRET_RULES,
                  advisories: DataFrame | None = None, semgrep: DataFrame | None = None,
                  bandit: DataFrame | None = None, roots: DataFrame | None = None,
                  replies: DataFrame | None = None, explain_limit: int | None = None,
                  per_package: bool = False, aliases: dict | None = None,
                  manifest_files: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Merged findings of all producers over all projects of ``files``.

    Files that admission refuses by their path take no part.  ``roots`` are wrapper
    directories to take off finding paths, so that texts need not be joined with
    them.  ``replies`` are merged for the findings they name; ``explain_limit``
    restricts that to so many top findings of each project.  Rules may be tables
    (:mod:`faultline.sources.rulebooks`); the checks of statements go on beside a table.
    """
    files = admission.admit_files(files)
    if isinstance(rule_set, DataFrame):
        rule_set = (*rulebooks.rules_in(rule_set), *rules.SYNTAX_RULES)
    secret_rules = rulebooks.rules_in(secret_rules)
    manifest_files = manifests.manifest_files(files) if manifest_files is None else manifest_files
    best = _merged_findings(
        files, manifests.declared_packages(manifest_files), rule_set, secret_rules, advisories,
        semgrep, bandit, per_package, aliases)
    if roots is not None:
        best = best.join(roots, "project_id", "left").withColumn(
            "file_path", admission.below_root(F.col("file_path"), F.col("root"))).drop("root")
    best = findings.with_finding_id(rules.mask_secrets(best, secret_rules))
    if replies is not None:
        return explained(cut(best) if keep else best, replies, explain_limit)
    return best.select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("ai_explanation", "ai_reasoning_summary")],
        F.lit(None).cast("int").alias("ai_confidence"), F.lit(False).alias("reply_usable"))


def scan(files: DataFrame, projects: DataFrame | None = None, *, scan_date=None,
         duration: float | None = None, keep: bool = False, markers: DataFrame | None = None, **options) -> ScanResult:
    """Scan all projects of ``files`` and describe them as three tables.

    ``projects`` (``project_id`` and optionally ``project_name``, ``scan_date``)
    names projects that may have no file; by default every project of ``files``
    is scanned.  A date must be given, there or as ``scan_date``: it tells one scan
    of a project from the next.  ``keep`` stores the manifests and the findings in the shared
    folder first: the texts are then read twice in all, once for the manifests
    and once for all rules, whatever is derived.  ``markers`` is a table of framework
    markers instead of the known ones.  The other options are those
    of :func:`scan_findings`.
    """
    if projects is None:
        projects = files.select("project_id").distinct()
    if scan_date is None and "scan_date" not in projects.columns:
        raise ValueError("a scan needs a date: pass scan_date, or projects with a scan_date")
    files = admission.admit_files(files)
    when = F.col("scan_date") if "scan_date" in projects.columns else F.lit(scan_date)
    named = F.col("project_name") if "project_name" in projects.columns else F.col("project_id")
    projects = projects.select(
        "project_id", named.alias("project_name"), when.cast("timestamp_ntz").alias("scan_date"))
    projects = projects.withColumn("scan_id", F.sha2(
        F.concat_ws("|", F.col("project_id"), F.col("scan_date").cast("string")), 256))

    manifest_files = manifests.manifest_files(files)
    if keep:
        manifest_files = cut(manifest_files)
    best = scan_findings(files, manifest_files=manifest_files, keep=keep, **options)
    if keep:
        best = cut(best)
    return ScanResult(
        dated_findings(best, projects), report_rows(best, projects),
        metadata_rows(files, manifest_files, projects, duration, markers))


def dated_findings(best: DataFrame, projects: DataFrame) -> DataFrame:
    """Findings of one scan each; their ids are those of the place within this scan."""
    own_id = F.sha2(F.to_json(F.struct("scan_id", "fingerprint")), 256)
    return best.withColumnRenamed("finding_id", "fingerprint").join(projects, "project_id").select(
        "*", own_id.alias("finding_id"), F.lit(seeds.FINDING_STATES[0]).alias("status"), F.col("scan_date").alias("created_at"),
    ).select(*schema.names(schema.FINDINGS))


def report_rows(best: DataFrame, projects: DataFrame) -> DataFrame:
    used = explain.reply_availability(best)
    return (
        projects.join(score.scores(best, projects), "project_id").join(used, "project_id", "left")
        .withColumn("explanations_available",
                    F.coalesce("explanations_available", F.lit("unavailable")))
        .select(*schema.names(schema.REPORTS)))


def metadata_rows(files: DataFrame, manifest_files: DataFrame, projects: DataFrame,
                  duration: float | None = None, markers: DataFrame | None = None) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (
        projects.join(score.file_counters(files), "project_id", "left")
        .join(dependencies.detected_frameworks(manifest_files, **rulebooks.markers_in(markers)), "project_id", "left")
        .select("scan_id",
                *[F.coalesce(c, zero).alias(c) for c in
                  ("total_files", "python_files", "javascript_files", "config_files")],
                F.coalesce("detected_frameworks", F.array().cast("array<string>")).alias("detected_frameworks"),
                F.lit(duration).cast("double").alias("scan_duration")))


def explained(best: DataFrame, replies: DataFrame, limit: int | None = None) -> DataFrame:
    """Merge the replies, or only those for the ``limit`` top findings of each project."""
    if limit is None:
        return explain.merge_replies(best, replies)
    chosen = explain.top_findings(best, limit).select("finding_id")
    return explain.merge_replies(best, replies.join(chosen, "finding_id", "left_semi"))


def _apart(judged: DataFrame) -> DataFrame:
    """Equal submissions under names of their own: the n-th of them bears n in its name.

    Only names travel; the submissions themselves meet the numbers of those that have equals.
    Which of them gets which number does not matter, as they are equal.
    """
    equals = judged.groupBy("submission").agg(F.count("*").alias("n")).filter("n > 1").select("submission")
    if equals.isEmpty():
        return judged
    tagged = cut(judged.withColumn("_tag", F.monotonically_increasing_id()))
    numbered = ordinals(
        tagged.select("submission", "_tag").join(equals, "submission", "left_semi"), ["submission"], "_tag", "_nth")
    nth = F.when(F.col("_nth") > 0, F.sha2(F.concat_ws("#", "submission", F.col("_nth").cast("string")), 256))
    named = tagged.join(numbered.select("_tag", "_nth"), "_tag", "left")
    return cut(named.withColumn("submission", F.coalesce(nth, F.col("submission"))).drop("_tag", "_nth"))


def judged_submissions(payloads: DataFrame, scan_date=None) -> DataFrame:
    """Submissions under names of their own, dated and judged, stored once.

    A submission is named by ``landed_as`` (where it stood, if given), what it says (``content_hash``, or
    its name and files) and which of its equals it is, however the rows are dealt out;
    ``landed_at``, its own ``scan_date``, or the ``scan_date`` given dates it, without which there is an error.
    """
    dates = [F.col(c).cast("timestamp_ntz") for c in ("landed_at", "scan_date") if c in payloads.columns]
    if not dates and scan_date is None:
        raise ValueError("a scan needs a date: pass scan_date, or submissions with landed_at or scan_date")
    content = "content_hash" if "content_hash" in payloads.columns else F.sha2(F.to_json(F.struct("project_name", "files")), 256)
    when = F.coalesce(*dates, F.lit(scan_date).cast("timestamp_ntz"))
    place = F.col("landed_as") if "landed_as" in payloads.columns else when
    alike = F.sha2(F.to_json(F.struct(place.alias("place"), F.coalesce(content, F.lit("")).alias("content"))), 256)
    named = payloads.select(
        "*", alike.alias("submission"), when.alias("dated")).drop("scan_date").withColumnRenamed("dated", "scan_date")
    return _apart(cut(admission.judged_payloads(named)))


def scan_payloads(payloads: DataFrame, *, scan_date=None, **options) -> ScanResult:
    """Scan inline submissions, each as a project of its own; refused ones are returned with their reason.

    How they are named and dated, see :func:`judged_submissions`.
    """
    judged = judged_submissions(payloads, scan_date)
    accepted = judged.filter(F.col("reason").isNull()).select(
        F.col("submission").alias("project_id"), "project_name", "scan_date")
    refused = judged.filter(F.col("reason").isNotNull()).select(*schema.names(schema.REFUSALS))
    return scan(admission.payload_files(judged), accepted, **options)._replace(refusals=refused)
