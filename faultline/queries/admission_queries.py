"""Queries over file and archive admission, submissions and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultline import schema, seeds
from faultline.functions import paths
from faultline.functions.severity import canonical_category
from faultline.operators import admission
from faultline.plans.scan import scan_payloads
from faultline.queries import fixtures, oracle
from faultline.session import shared_folder
from faultline.sources import tables
from faultline.sources.payloads import read_payloads
from faultline.streaming import arrivals

# Limits low enough for the small tables to break them.
TOTAL_BYTES, FILE_COUNT, FILE_BYTES = 25_000_000, 6, 5_000_000

UNSAFE = ("(starts_with(entry_path, '/') OR list_contains(string_split(entry_path, '/'), '..') "
          "OR regexp_matches(replace(entry_path, chr(92), '/'), '^.:'))")


def judged_cte(file_bytes=FILE_BYTES) -> str:
    return f"""{fixtures.entries_sql()}, judged AS (SELECT *, {UNSAFE} AS unsafe,
      NOT {UNSAFE} AND NOT {oracle.is_blocked('entry_path')} AND {oracle.is_allowed('entry_path')}
        AND size <= {file_bytes} AS wanted FROM entries WHERE NOT is_dir)"""


def running_cte() -> str:
    return f"""{judged_cte()}, running AS (SELECT *,
        sum(size) OVER w AS total_bytes, count(*) OVER w AS total_files
      FROM judged WHERE wanted
      WINDOW w AS (PARTITION BY project_id ORDER BY entry_ord ROWS UNBOUNDED PRECEDING))"""


def verdict_cte() -> str:
    return f"""{running_cte()}, events AS (
        SELECT project_id, entry_ord, entry_path, 'unsafe path' AS reason FROM judged WHERE unsafe
        UNION ALL SELECT project_id, entry_ord, entry_path,
          CASE WHEN total_bytes > {TOTAL_BYTES} THEN 'too many bytes' ELSE 'too many files' END
        FROM running WHERE total_bytes > {TOTAL_BYTES} OR total_files > {FILE_COUNT}),
      first_event AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY entry_ord) = 1),
      rejected AS (SELECT * FROM first_event UNION ALL
        SELECT project_id, NULL, NULL, 'no source files' FROM judged
        WHERE project_id NOT IN (SELECT project_id FROM first_event)
        GROUP BY project_id HAVING count(*) FILTER (wanted) = 0)"""


def _admission(spark, sf_dir):
    return admission.admit_archives(fixtures.entries(spark, sf_dir), TOTAL_BYTES, FILE_COUNT, FILE_BYTES)


def admit_entries(spark, sf_dir):
    return _admission(spark, sf_dir).admitted.select("project_id", "entry_ord", "entry_path", "size")


def rejected_archives(spark, sf_dir):
    return _admission(spark, sf_dir).rejected


def admitted_files(spark, sf_dir):
    return admission.admit_files(fixtures.files(spark, sf_dir)).select(
        "project_id", "file_path", F.length("content").alias("n_chars"))


def running_limits(spark, sf_dir):
    judged = admission.judged_entries(fixtures.entries(spark, sf_dir), FILE_BYTES)
    return admission.entry_totals(judged, slice_width=64).select(
        "project_id", "entry_ord", "entry_path", "total_bytes", "total_files")


def archive_totals(spark, sf_dir):
    return admission.archive_totals(fixtures.entries(spark, sf_dir), FILE_BYTES)


def project_root(spark, sf_dir):
    judged = admission.judged_entries(fixtures.entries(spark, sf_dir), FILE_BYTES)
    return admission.project_roots(judged.filter("wanted"), "entry_path")


PROJECT_ROOT_SQL = f"""WITH {judged_cte()} SELECT project_id,
  CASE WHEN count(DISTINCT list_filter(string_split(entry_path, '/'), lambda p: p NOT IN ('', '.'))[1]) = 1
    AND NOT bool_or(len(list_filter(string_split(entry_path, '/'), lambda p: p NOT IN ('', '.'))) = 1)
    THEN min(list_filter(string_split(entry_path, '/'), lambda p: p NOT IN ('', '.'))[1]) END AS root
  FROM judged WHERE wanted GROUP BY project_id"""

# ---------------------------------------------------------------------------
# Submissions: every document is one submission of four files
# ---------------------------------------------------------------------------

NAMES = {
    "main": f"CASE WHEN doc_id % 5 = 0 THEN 'wrap/' ELSE '' END || ({fixtures.FILE_PATH})",
    "second": "CASE doc_id % 6 WHEN 0 THEN 'wrap/lib/util.py' WHEN 1 THEN '/lib/util.py' "
              "WHEN 2 THEN 'lib' || chr(92) || 'util.py' WHEN 3 THEN 'lib/../util.py' "
              "WHEN 4 THEN 'myenv/util.py' ELSE 'lib/util.bin' END",
    "third": "CASE WHEN doc_id % 3 = 0 THEN 'wrap/blank.py' ELSE 'blank.py' END",
}
TEXTS = {"main": "text", "second": "'x = ' || CAST(doc_id AS STRING)",
         "third": "CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(10) || chr(9) ELSE 'y = 1' END"}
SUBMITTER = "CASE WHEN doc_id % 29 = 3 THEN '  ' ELSE ' ' || source || '-' || CAST(doc_id AS STRING) || ' ' END"
MAX_BYTES = 20_000


def payloads(spark, sf_dir):
    given = F.array(*[F.struct(F.expr(NAMES[k]).alias("filename"), F.expr(TEXTS[k]).alias("source_code"))
                      for k in NAMES])
    return fixtures.documents(spark, sf_dir).select(F.expr(SUBMITTER).alias("project_name"), given.alias("files"))


def inline_admission(spark, sf_dir):
    judged = admission.judged_payloads(payloads(spark, sf_dir), MAX_BYTES)
    return judged.select(
        "project_name", F.size("admitted").alias("admitted_files"), "admitted_bytes", "reason", "root")


def inline_files(spark, sf_dir):
    files = admission.payload_files(admission.judged_payloads(payloads(spark, sf_dir), MAX_BYTES))
    return files.select("project_id", "file_path", F.length("content").alias("n_chars"))


def payload_cte() -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id, trim({SUBMITTER}) AS project_name, {i} AS n, "
        f"regexp_replace(replace({NAMES[k]}, chr(92), '/'), '^/+', '') AS file_path, {TEXTS[k]} AS content FROM documents"
        for i, k in enumerate(NAMES))
    parts = "string_split(file_path, '/')"
    return f"""given AS ({rows}),
      checked AS (SELECT *, list_has_any({parts}, ['', '.', '..']) AS unsafe,
        NOT {oracle.is_blocked('file_path')} AND {oracle.is_allowed('file_path')}
          AND {oracle.strip('content')} <> '' AS kept FROM given),
      verdicts AS (SELECT doc_id, project_name, CAST(count(*) FILTER (kept) AS INTEGER) AS admitted_files,
          CAST(coalesce(sum(strlen(content)) FILTER (kept), 0) AS BIGINT) AS admitted_bytes,
          bool_or(unsafe) AS any_unsafe,
          count(DISTINCT {parts}[1]) FILTER (kept) AS tops, min({parts}[1]) FILTER (kept) AS top,
          bool_or(len({parts}) = 1) FILTER (kept) AS top_file
        FROM checked GROUP BY doc_id, project_name),
      judged AS (SELECT doc_id, project_name, admitted_files, admitted_bytes,
          CASE WHEN project_name = '' THEN 'project name missing' WHEN any_unsafe THEN 'unsafe path'
            WHEN admitted_bytes > {MAX_BYTES} THEN 'upload too large' END AS reason,
          CASE WHEN tops = 1 AND NOT top_file THEN top END AS root FROM verdicts)"""


INLINE_SQL = f"""WITH {payload_cte()} SELECT project_name, admitted_files, admitted_bytes, reason, root FROM judged"""
INLINE_FILES_SQL = f"""WITH {payload_cte()} SELECT j.project_name AS project_id,
  CASE WHEN root IS NOT NULL THEN substr(file_path, length(root) + 2) ELSE file_path END AS file_path,
  CAST(length(content) AS INTEGER) AS n_chars FROM checked JOIN judged j USING (doc_id) WHERE kept AND reason IS NULL"""



def written_submissions(spark, sf_dir, project_name=None):
    """The folder in which the submissions stand as JSON lines."""
    given = payloads(spark, sf_dir)
    if project_name is not None:
        given = given.withColumn("project_name", project_name)
    folder = f"{shared_folder(spark)}/submissions-{uuid.uuid4().hex}"
    given.select(F.to_json(F.struct("project_name", "files")).alias("value")).write.text(folder)
    return folder


def stored_submissions(spark, sf_dir, project_name=None):
    """The submissions written as JSON lines to the shared folder, and read back."""
    return read_payloads(spark, written_submissions(spark, sf_dir, project_name))


def stored_admission(spark, sf_dir):
    judged = admission.judged_payloads(stored_submissions(spark, sf_dir), MAX_BYTES)
    return judged.select("project_name", F.size("admitted").alias("admitted_files"), "admitted_bytes", "reason", "root")


def submission_scans(spark, sf_dir):
    """Reports and refusals of submissions whose project names repeat, counted by name."""
    source = F.regexp_replace("project_name", "-[0-9]+ $", "")
    result = scan_payloads(stored_submissions(spark, sf_dir, source), rule_set=())
    return _by_name(result.reports, result.refusals)


def _by_name(reports, refusals):
    rows = reports.select("project_name", F.lit(None).cast("string").alias("reason"), "scan_id").unionByName(
        refusals.select("project_name", "reason", F.col("submission").alias("scan_id")))
    return rows.groupBy("project_name", "reason").agg(
        F.count("*").alias("submissions"), F.countDistinct("scan_id").alias("scans"))


def _database(spark):
    """A new database in the shared folder."""
    name = f"scans_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}/{name}'")
    tables.create_tables(spark, name)
    return name


def stored_scans(spark, sf_dir):
    """Submissions scanned with all rules, appended twice and read back, counted by name."""
    result = scan_payloads(stored_submissions(spark, sf_dir, F.regexp_replace("project_name", "-[0-9]+ $", "")), keep=True)
    name = _database(spark)
    for _ in range(2):
        tables.append_scan(result, name)
    return _by_name(tables.read_table(spark, "reports", name), tables.read_table(spark, "refusals", name))


def arrived_scans(spark, sf_dir):
    """The same submissions scanned as a stream of files that have landed."""
    source, name = F.regexp_replace("project_name", "-[0-9]+ $", ""), _database(spark)
    folder = written_submissions(spark, sf_dir, source)
    arrivals.scan_arrivals(spark, folder, f"{folder}-progress", name, once=True).awaitTermination()
    return _by_name(tables.read_table(spark, "reports", name), tables.read_table(spark, "refusals", name))


def status_log(spark, sf_dir):
    """Order states logged as a stream, every change delivered twice, and the last one of each finding."""
    changes = fixtures.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("finding_id"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "FIXED").otherwise("IGNORED").alias("status"),
        F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")) * 86400).alias("changed_at"), F.col("o_orderkey").cast("long").alias("change_id"))
    name = _database(spark)
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    changes.union(changes).write.parquet(folder)
    stream = spark.readStream.schema(schema.STATUS_CHANGES).parquet(folder)
    arrivals.log_status_changes(stream, f"{folder}-progress", name, late_by="36500 days", once=True).awaitTermination()
    log = tables.read_table(spark, "status_changes", name)
    return log.groupBy("finding_id").agg(
        F.count("*").alias("changes"), F.max_by("status", F.struct("changed_at", "change_id")).alias("status"))


STATUS_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS finding_id, count(*) AS changes,
  max_by(CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FIXED' ELSE 'IGNORED' END,
    {'d': CAST(o_orderdate AS DATE), 'k': o_orderkey}) AS status FROM orders GROUP BY ALL"""
SUBMISSIONS_SQL = f"""WITH {payload_cte().replace(str(MAX_BYTES), str(seeds.MAX_UPLOAD_BYTES))}
  SELECT regexp_replace(project_name, '-[0-9]+$', '') AS project_name, reason, count(*) AS submissions, count(*) AS scans
  FROM judged GROUP BY ALL"""

# ---------------------------------------------------------------------------
# Paths and categories
# ---------------------------------------------------------------------------

RAW_PATH = f"""CASE doc_id % 6 WHEN 0 THEN '/srv/' || source || '/' || ({fixtures.FILE_PATH})
  WHEN 1 THEN 'C:' || chr(92) || 'Temp' || chr(92) || '{paths.WORK_MARKER}' || chr(92) || '14c6-9a' || chr(92) || 'project'
    || chr(92) || replace({fixtures.FILE_PATH}, '/', chr(92))
  WHEN 2 THEN '/tmp/{paths.WORK_MARKER}/14c6920f-108d/' || ({fixtures.FILE_PATH})
  WHEN 3 THEN '/elsewhere/' || ({fixtures.FILE_PATH})
  WHEN 4 THEN '/tmp/{paths.WORK_MARKER}/14c6' ELSE ({fixtures.FILE_PATH}) END"""
ROOT = "'/srv/' || source"


def path_forms(spark, sf_dir):
    table = fixtures.select(fixtures.read(spark, sf_dir, "documents"), {
        "doc_id": "doc_id", "raw": RAW_PATH, "file_path": fixtures.FILE_PATH, "root": ROOT})
    raw, path = F.col("raw"), F.col("file_path")
    return table.select(
        "doc_id", paths.relative_path(raw, F.col("root")).alias("relative"),
        paths.graph_path(raw).alias("shown"), paths.basename(path).alias("label"),
        F.coalesce(paths.language(path), F.lit("-")).alias("lang"),
        F.coalesce(paths.counted_language(path), F.lit("-")).alias("counted"),
        paths.is_config(path).alias("is_config"))


PATHS_SQL = f"""WITH p AS (SELECT doc_id, {RAW_PATH} AS raw, {fixtures.FILE_PATH} AS file_path, {ROOT} AS root FROM documents),
  q AS (SELECT *, replace(raw, chr(92), '/') AS plain,
      regexp_extract(replace(raw, chr(92), '/'), '{paths.WORK_MARKER}/(.*)$', 1) AS after FROM p)
  SELECT doc_id,
    CASE WHEN starts_with(raw, root || '/') THEN substr(raw, length(root) + 2)
      WHEN contains(plain, '{paths.WORK_MARKER}/') THEN
        CASE WHEN contains(after, '/') THEN
          regexp_replace(regexp_replace(after, '^[^/]*/', ''), '^project/', '') ELSE after END
      ELSE {oracle.BASENAME.format('raw')} END AS relative,
    CASE WHEN regexp_matches(plain, '{paths.WORK_MARKER}/[0-9a-fA-F-]+/.+$')
      THEN regexp_extract(plain, '{paths.WORK_MARKER}/[0-9a-fA-F-]+/(.+)$', 1) ELSE plain END AS shown,
    {oracle.basename('file_path')} AS label, coalesce({oracle.language('file_path')}, '-') AS lang,
    CASE WHEN file_path LIKE '%.py' THEN 'py' WHEN regexp_matches(file_path, '\\.(js|jsx|ts|tsx)$') THEN 'js' ELSE '-' END AS counted,
    {oracle.basename('file_path')} IN {oracle.in_list(seeds.CONFIG_NAMES)} OR {oracle.suffix('file_path')} IN ('.yml', '.yaml') AS is_config
  FROM q"""

SPELLINGS = (*seeds.CATEGORY_ALIASES, "b605", "weak_cryptography", "Sql-Injection", "XSS", "custom-Check")
RAW_CATEGORY = oracle.case_map(f"p_partkey % {len(SPELLINGS)}", dict(enumerate(SPELLINGS)))


def category_norm(spark, sf_dir):
    table = fixtures.select(fixtures.read(spark, sf_dir, "part"), {"p_partkey": "p_partkey", "category": RAW_CATEGORY})
    return table.select("p_partkey", "category", canonical_category(F.col("category")).alias("canonical"))


CATEGORY_SQL = f"""WITH c AS (SELECT p_partkey, {RAW_CATEGORY} AS category FROM part)
  SELECT p_partkey, category, {oracle.canonical('category')} AS canonical FROM c"""

QUERIES = {
    "q_admit_files": admitted_files, "q_admit_archives": admit_entries,
    "q_rejected_archives": rejected_archives, "q_running_limits": running_limits,
    "q_archive_totals": archive_totals, "q_project_root": project_root,
    "q_inline_admission": inline_admission, "q_inline_files": inline_files,
    "q_stored_admission": stored_admission, "q_submission_scans": submission_scans,
    "q_stored_scans": stored_scans, "q_arrived_scans": arrived_scans, "q_status_log": status_log,
    "q_paths": path_forms, "q_category_norm": category_norm,
}
ORACLES = {
    "q_admit_files": f"WITH {fixtures.files_sql()} SELECT project_id, file_path, CAST(length(content) AS INTEGER) AS n_chars FROM files "
                     f"WHERE {oracle.is_allowed('file_path')} AND NOT {oracle.is_blocked('file_path')}",
    "q_admit_archives": f"WITH {verdict_cte()} SELECT project_id, entry_ord, entry_path, size FROM judged "
                        "WHERE wanted AND project_id NOT IN (SELECT project_id FROM rejected)",
    "q_rejected_archives": f"WITH {verdict_cte()} SELECT project_id, reason, entry_ord, entry_path FROM rejected",
    "q_running_limits": f"WITH {running_cte()} SELECT project_id, entry_ord, entry_path, "
                        "CAST(total_bytes AS BIGINT) AS total_bytes, total_files FROM running",
    "q_archive_totals": f"WITH {judged_cte()} SELECT project_id, count(*) FILTER (wanted) AS admitted_files, "
                        "CAST(coalesce(sum(size) FILTER (wanted), 0) AS BIGINT) AS admitted_bytes FROM judged GROUP BY project_id",
    "q_project_root": PROJECT_ROOT_SQL, "q_inline_admission": INLINE_SQL,
    "q_stored_admission": INLINE_SQL, "q_submission_scans": SUBMISSIONS_SQL,
    "q_stored_scans": SUBMISSIONS_SQL, "q_arrived_scans": SUBMISSIONS_SQL, "q_status_log": STATUS_SQL,
    "q_inline_files": INLINE_FILES_SQL, "q_paths": PATHS_SQL, "q_category_norm": CATEGORY_SQL,
}
