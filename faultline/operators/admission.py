"""Which files, archives and submissions are taken in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import paths
from faultline.functions.text import strip
from faultline.operators.ordered import running_totals


def admit_files(files: DataFrame) -> DataFrame:
    """Files with an allowed name outside blocked directories; looks at paths only."""
    path = F.col("file_path")
    return files.filter(paths.is_allowed(path) & ~paths.in_blocked_dir(path))


# ---------------------------------------------------------------------------
# Archives
# ---------------------------------------------------------------------------


class Admission(NamedTuple):
    """Entries of accepted projects, and one row per rejected project."""

    admitted: DataFrame
    rejected: DataFrame


def judged_entries(entries: DataFrame, max_file_bytes: int = seeds.MAX_FILE_BYTES) -> DataFrame:
    """Mark file entries as ``unsafe`` and as ``wanted``; directory entries are left out."""
    path = F.col("entry_path")
    unsafe = paths.is_unsafe_entry(path)
    wanted = (~unsafe & ~paths.in_blocked_dir(path) & paths.is_allowed(path)
              & (F.col("size") <= max_file_bytes))
    return entries.filter(~F.col("is_dir")).select("*", unsafe.alias("unsafe"), wanted.alias("wanted"))


def entry_totals(judged: DataFrame, slice_width: int = 100_000) -> DataFrame:
    """Bytes and number of wanted entries up to and with each wanted entry."""
    return running_totals(
        judged.filter("wanted"), "project_id", "entry_ord",
        {"total_bytes": F.col("size"), "total_files": F.lit(1)}, slice_width)


def broken_limits(judged: DataFrame, max_total_bytes: int = seeds.MAX_TOTAL_BYTES,
                  max_files: int = seeds.MAX_FILES) -> DataFrame:
    """Reason and entry for every project that must be rejected.

    An archive is judged in entry order: the first entry that is unsafe or
    breaks a limit decides.  Projects within both totals need no running sums,
    so these are computed only for the projects over a limit.
    """
    totals = judged.groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(F.col("wanted"), F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if("wanted").alias("files"),
        F.min(F.when(F.col("unsafe"), F.struct("entry_ord", "entry_path"))).alias("first_unsafe"))
    over = totals.filter((F.col("bytes") > max_total_bytes) | (F.col("files") > max_files))
    first_over = (
        entry_totals(judged.join(over.select("project_id"), "project_id", "left_semi"))
        .filter((F.col("total_bytes") > max_total_bytes) | (F.col("total_files") > max_files))
        .groupBy("project_id")
        .agg(F.min(F.struct(
            "entry_ord", "entry_path",
            F.when(F.col("total_bytes") > max_total_bytes, "too many bytes")
            .otherwise("too many files").alias("reason"))).alias("first_over")))
    unsafe, limit = F.col("first_unsafe"), F.col("first_over")
    unsafe_first = unsafe.isNotNull() & (
        limit.isNull() | (unsafe["entry_ord"] < limit["entry_ord"]))
    reason = (
        F.when(unsafe_first, "unsafe path").when(limit.isNotNull(), limit["reason"])
        .when(F.col("files") == 0, "no source files"))
    return totals.join(first_over, "project_id", "left").select(
        "project_id", reason.alias("reason"),
        F.when(unsafe_first, unsafe["entry_ord"]).otherwise(limit["entry_ord"]).alias("entry_ord"),
        F.when(unsafe_first, unsafe["entry_path"]).otherwise(limit["entry_path"]).alias("entry_path"),
    ).filter(F.col("reason").isNotNull())


def admit_archives(entries: DataFrame, max_total_bytes: int = seeds.MAX_TOTAL_BYTES,
                   max_files: int = seeds.MAX_FILES, max_file_bytes: int = seeds.MAX_FILE_BYTES) -> Admission:
    """Apply the archive rules to ``project_id, entry_ord, entry_path, is_dir, size``."""
    judged = judged_entries(entries, max_file_bytes)
    rejected = broken_limits(judged, max_total_bytes, max_files)
    admitted = judged.filter("wanted").drop("unsafe", "wanted").join(
        rejected.select("project_id"), "project_id", "left_anti")
    return Admission(admitted, rejected)


def archive_totals(entries: DataFrame, max_file_bytes: int = seeds.MAX_FILE_BYTES) -> DataFrame:
    """Number and declared bytes of wanted entries per project."""
    return judged_entries(entries, max_file_bytes).groupBy("project_id").agg(
        F.count_if("wanted").alias("admitted_files"),
        F.coalesce(F.sum(F.when(F.col("wanted"), F.col("size"))), F.lit(0)).alias("admitted_bytes"))


def project_roots(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Wrapper directory per project: the only top-level directory, when no file lies beside it.

    ``root`` is null where the project has no wrapper.
    """
    steps = paths.parts(F.col(path))
    top = F.element_at(steps, 1)
    tops = files.select("project_id", top.alias("top"), (F.size(steps) == 1).alias("is_file"))
    return (
        tops.groupBy("project_id")
        .agg(F.min("top").alias("first_top"), F.max("top").alias("last_top"),
             F.bool_or("is_file").alias("has_file"))
        .select("project_id", F.when(
            (F.col("first_top") == F.col("last_top")) & ~F.col("has_file"), F.col("first_top"),
        ).alias("root")))


def below_root(path: Column, root: Column) -> Column:
    """``path`` without its wrapper directory."""
    inside = root.isNotNull() & path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).otherwise(path)


# ---------------------------------------------------------------------------
# Inline submissions
# ---------------------------------------------------------------------------


def judged_payloads(payloads: DataFrame, max_bytes: int = seeds.MAX_UPLOAD_BYTES) -> DataFrame:
    """Clean and judge submissions ``project_name, files`` inside their own rows.

    Adds ``admitted`` (array of file path and text), ``reason`` (null when
    accepted) and ``root``; ``submission`` and ``scan_date`` are carried along.  Nothing is exploded or shuffled for it.
    """
    cleaned = payloads.select(
        "*", strip(F.col("project_name")).alias("name"),
        F.transform("files", lambda f: F.struct(
            paths.inline_name(f["filename"]).alias("file_path"),
            F.coalesce(f["source_code"], F.lit("")).alias("content"))).alias("given"))
    admitted = F.filter("given", lambda f: (
        ~paths.in_blocked_dir(f["file_path"]) & paths.is_allowed(f["file_path"])
        & f["content"].rlike(r"(?U)\S")))
    kept = cleaned.withColumn("admitted", admitted)
    size = F.aggregate("admitted", F.lit(0).cast("long"),
                       lambda total, f: total + F.octet_length(f["content"]))
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "project name missing")
        .when(F.coalesce(F.size("given"), F.lit(0)) <= 0, "no files given")
        .when(F.exists("given", lambda f: paths.is_unsafe_inline(f["file_path"])), "unsafe path")
        .when(size > max_bytes, "upload too large"))
    tops = F.array_distinct(F.transform("admitted", lambda f: F.element_at(F.split(f["file_path"], "/"), 1)))
    root = F.when(
        (F.size(tops) == 1) & F.forall("admitted", lambda f: F.contains(f["file_path"], F.lit("/"))),
        F.element_at(tops, 1))
    carried = [c for c in ("submission", "scan_date") if c in payloads.columns]
    return kept.select(
        *carried, F.col("name").alias("project_name"), "admitted", size.alias("admitted_bytes"),
        reason.alias("reason"), root.alias("root"))


def payload_files(judged: DataFrame) -> DataFrame:
    """Files of accepted submissions, without the wrapper directory.

    A path submitted twice keeps its last text, as on disk.  The project is the
    ``submission`` where there is one, else the project name.
    """
    project = F.col("submission" if "submission" in judged.columns else "project_name")
    return (
        judged.filter(F.col("reason").isNull())
        .select(project.alias("project_id"), "root", F.posexplode(last_texts(F.col("admitted"))).alias("position", "file"))
        .select("project_id", below_root(F.col("file.file_path"), F.col("root")).alias("file_path"),
                F.col("file.content").alias("content")))


def last_texts(files: Column) -> Column:
    """Files of one submission, sorted by path, with only the last of equal paths."""
    ranked = F.array_sort(F.transform(files, lambda f, i: F.struct(
        f["file_path"].alias("file_path"), i.alias("at"), f["content"].alias("content"))))

    def last_of_each(ordered: Column) -> Column:
        return F.filter(ordered, lambda f, i: ~f["file_path"].eqNullSafe(
            F.get(ordered, i + 1)["file_path"]))

    # the sorted files are bound once by wrapping them in an array of one element
    return F.flatten(F.transform(F.array(ranked), last_of_each))
