"""Queries over text rules, syntax checks, deduplication and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions import severity, syntax
from faultline.functions.text import QUOTED_VALUE, decode_text
from faultline.operators import findings, reports, rules, score
from faultline.plans.scan import STATIC_RULES, scan, scan_findings, static_findings
from faultline.queries import fixtures, oracle
from faultline.queries.dependency_queries import advisories_cte, counters_select, frameworks_cte

PY = tuple(r for r in seeds.PATTERN_RULES if r.lang == "py")
JS = tuple(r for r in seeds.PATTERN_RULES if r.lang == "js")
CREDENTIAL = tuple(r for r in PY if r.rule_id == "py11")
MATCH = ("project_id", "file_path", "rule_id", "line_number", "match_no", "code_snippet")

# ---------------------------------------------------------------------------
# Matches
# ---------------------------------------------------------------------------


def _matches(spark, sf_dir, rule_set):
    return rules.rule_matches(fixtures.files(spark, sf_dir), rule_set).select(*MATCH)


def _matches_sql(rule_set):
    return (f"WITH {fixtures.files_sql()}, {oracle.matches_sql(rule_set)} "
            f"SELECT {', '.join(MATCH)} FROM matches")


def credential_scan(spark, sf_dir):
    """The credential rule over the plain documents, whatever their path."""
    table = fixtures.select(fixtures.documents(spark, sf_dir), {
        "project_id": "source", "file_path": "CAST(doc_id AS STRING) || '.py'", "content": "text"})
    return rules.rule_matches(table, CREDENTIAL).select(*MATCH)


CREDENTIAL_SQL = (
    "WITH files AS (SELECT source AS project_id, CAST(doc_id AS STRING) || '.py' AS file_path, "
    f"text AS content FROM documents), {oracle.matches_sql(CREDENTIAL)} "
    f"SELECT {', '.join(MATCH)} FROM matches")

# ---------------------------------------------------------------------------
# Syntax checks
# ---------------------------------------------------------------------------

PLACE = ("project_id", "file_path", "line_number", "code_snippet")


def taint_xss(spark, sf_dir):
    return rules.rule_matches(fixtures.files(spark, sf_dir), (syntax.TAINT,)).select(*PLACE)


def silent_except(spark, sf_dir):
    return rules.rule_matches(fixtures.files(spark, sf_dir), (syntax.SUPPRESSION,)).select(*PLACE)


# Patterns of the check's own, one per line of text.
REQUEST_LINE = (r"(?m)^[ \t]*([A-Za-z_]\w*)[ \t]*=[ \t]*request\.(?:args|form|values|json)"
                r"\.\w+\([^()\n]*\)[ \t]*(?:#[^\n]*)?$")
PLACED = r"\{[ \t]*([A-Za-z_]\w*)[ \t]*=?[ \t]*(?:![rsa])?(?::[^{}]*)?\}"

# Line by line here: the check only needs one-line literals, which is all the texts hold.
TAINT_CTE = f"""py_files AS (SELECT * FROM files WHERE ({oracle.language('file_path')}) = 'py'),
  sources AS (SELECT project_id, file_path,
      unnest(regexp_extract_all(content, {oracle.quoted(REQUEST_LINE)}, 1)) AS var FROM py_files),
  py_lines AS (SELECT project_id, file_path, unnest(generate_series(1, len(ls))) AS line_number, ls
      FROM (SELECT *, string_split(content, chr(10)) AS ls FROM py_files WHERE contains(content, 'return'))),
  sinks AS (SELECT project_id, file_path, line_number, ls[line_number] AS line,
      unnest(regexp_extract_all(regexp_replace(ls[line_number], '\\{{\\{{|\\}}\\}}', '', 'g'),
        {oracle.quoted(PLACED)}, 1)) AS var
      FROM py_lines WHERE regexp_matches(ls[line_number], '^[ \t]*return[ \t]+[fF]["'']')),
  tainted AS (SELECT DISTINCT project_id, file_path, CAST(line_number AS INTEGER) AS line_number,
      {oracle.strip('line')} AS code_snippet
      FROM sinks SEMI JOIN sources USING (project_id, file_path, var))"""

SILENT_CTE = f"""code_lines AS (
    SELECT project_id, file_path, i AS line_number, ls[i] AS line,
      row_number() OVER (PARTITION BY project_id, file_path ORDER BY i) AS n
    FROM (SELECT project_id, file_path, ls, unnest(generate_series(1, len(ls))) AS i
      FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files
        WHERE contains(content, 'except') AND ({oracle.language('file_path')}) = 'py'))
    WHERE regexp_matches(ls[i], '^[ \t]*[^ \t#]')),
  around AS (SELECT *, len(regexp_extract(line, '^[ \t]*')) AS indent,
      lead(line, 1) OVER w AS next_line, lead(line, 2) OVER w AS third_line
    FROM code_lines WINDOW w AS (PARTITION BY project_id, file_path ORDER BY n)),
  silent AS (SELECT project_id, file_path, CAST(line_number AS INTEGER) AS line_number,
      {oracle.strip('line')} AS code_snippet FROM around
    WHERE regexp_matches(line, '^[ \t]*except[ \t]*:[ \t]*pass[ \t]*(#.*)?$')
      OR (regexp_matches(line, '^[ \t]*except[ \t]*:[ \t]*(#.*)?$')
        AND regexp_matches(next_line, '^[ \t]*pass[ \t]*(#.*)?$')
        AND len(regexp_extract(next_line, '^[ \t]*')) > indent
        AND (third_line IS NULL OR len(regexp_extract(third_line, '^[ \t]*')) <= indent)))"""

# Statements of many forms, each before the documents' own texts in a string, and the rule and line that hold.
STATEMENTS = (
    ('name = request.args.get("n")\nreturn f"<b>{name}</b>"', "ast01", 2),
    ('# name = request.args.get("n")\nname = 1\nreturn f"{name}"', None, None),
    ("s = \'\'\'\nname = request.args.get(1)\nexcept:\n    pass\n\'\'\'\nreturn f\"{name}\"", None, None),
    ('n = request.form.get(key(a(1), [2]), default=(3))\nreturn f"{n!r:>{w}}"', "ast01", 2),
    ('a = b = request.json.get("x")\nif b: return f"<p>{b}</p>"', "ast01", 2),
    ('a, b = request.args.get("x")\nreturn f"{a}{b}"', None, None),
    ('a = request.args.get("x").strip()\nreturn f"{a}"', None, None),
    ('a = (\n  request.values.get(  # note (\n    "x")\n)\nreturn (\n  "<b>"\n  f"{a}"\n)', "ast01", 5),
    ('a: str = request.args.get("x")\nreturn f"{a}"', None, None),
    ("try:\n    run()\nexcept:\n    # quiet\n    pass\n    pass", "ast02", 3),
    ("try: run()\nexcept: pass; pass", "ast02", 2),
    ("try:\n    run()\nexcept:\n    pass\n    log()", None, None),
    ("try:\n    run()\nexcept ValueError:\n    pass", None, None),
    ("try:\n  a()\nexcept:\n  try:\n    b()\n  except:\n    pass", "ast02", 6),
    ('x = "abc\ntry: a()\nexcept:\n    pass', None, None),
    ("f(1\ntry: a()\nexcept:\n    pass", None, None),
    ('a = request.args.get("x")\nreturn f"{{a}} {a.b}"', None, None),
    ('a = request.args.get("x")\nreturn f"{a}" + x', None, None),
    ('a = request.args.get("x")\nreturn f"""\n<p>{\na}</p>"""', "ast01", 2),
    ('a \\\n = request.args.get("x"); b = 1\nreturn "%" f"{a}"', "ast01", 3),
)


def statement_files(spark, sf_dir):
    case = F.element_at(F.lit([text for text, *_ in STATEMENTS]), (F.col("doc_id") % len(STATEMENTS) + 1).cast("int"))
    own = F.translate("text", '"\\', "  ")
    return fixtures.read(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(case, F.lit('\nx = """'), own, F.lit('"""')).alias("content"))


def statement_rules(spark, sf_dir):
    return rules.rule_matches(statement_files(spark, sf_dir), (syntax.TAINT, syntax.SUPPRESSION)).select(
        "project_id", "file_path", "rule_id", "line_number", "code_snippet")


STATEMENT_SQL = (
    "WITH expected (k, rule_id, line_number, code_snippet) AS (VALUES "
    + ", ".join(f"({k}, '{rule}', {line}, {oracle.quoted(text.split(chr(10))[line - 1].strip())})"
                for k, (text, rule, line) in enumerate(STATEMENTS) if rule)
    + f""") SELECT source AS project_id, 'f' || doc_id || '.py' AS file_path, rule_id, CAST(line_number AS INTEGER) AS line_number, code_snippet
      FROM documents JOIN expected ON doc_id % {len(STATEMENTS)} = k WHERE text IS NOT NULL""")

# ---------------------------------------------------------------------------
# Findings
# ---------------------------------------------------------------------------

STATIC = ("project_id", "file_path", "line_number", "category", "severity", "confidence",
          "title", "source_tool", "code_snippet")
SOURCE = {r.rule_id: rules.source_rank_of(r) for r in STATIC_RULES + seeds.SECRET_RULES}


def rule_values(rule_set) -> str:
    rows = [(r.rule_id, i, SOURCE[r.rule_id], r.title, r.category, r.severity, r.confidence, r.tool)
            for i, r in enumerate(rule_set)]
    return oracle.values_table(
        "rules", "rule_id, rule_ord, source_rank, title, category, severity, confidence, source_tool", rows)


def raw_cte(project=fixtures.BY_SOURCE, secrets=False, admitted=False) -> str:
    """All findings of rules and syntax checks before deduplication."""
    rule_set = STATIC_RULES + (seeds.SECRET_RULES if secrets else ())
    plain = seeds.PATTERN_RULES + (seeds.SECRET_RULES if secrets else ())
    return f"""{fixtures.files_sql(project, admitted)}, {oracle.matches_sql(plain)}, {TAINT_CTE}, {SILENT_CTE},
      {rule_values(rule_set)},
      hits AS (SELECT project_id, file_path, rule_id, line_number, code_snippet FROM matches
        UNION ALL SELECT project_id, file_path, 'ast01', line_number, code_snippet FROM tainted
        UNION ALL SELECT project_id, file_path, 'ast02', line_number, code_snippet FROM silent),
      raw AS (SELECT * FROM hits JOIN rules USING (rule_id))"""


def static_cte(project=fixtures.BY_SOURCE, secrets=False, admitted=False) -> str:
    own = ", CASE WHEN source_rank = 5 THEN rule_ord END" if secrets else ""
    return f"""{raw_cte(project, secrets, admitted)},
      static AS (SELECT * FROM raw QUALIFY row_number() OVER (
        PARTITION BY project_id, file_path, line_number, category{own}
        ORDER BY source_rank, rule_ord, line_number) = 1)"""


def exact_dedupe(spark, sf_dir):
    return static_findings(fixtures.files(spark, sf_dir)).select(*STATIC)


def near_dedupe(spark, sf_dir):
    return findings.best_per_place(static_findings(fixtures.files(spark, sf_dir))).select(*STATIC)


def near_cte(source="static", name="near", per_package=False) -> str:
    package = ", CASE WHEN category = 'insecure-dependency' THEN title END" if per_package else ""
    return f"""{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (
      PARTITION BY project_id, file_path, CAST(floor(line_number / 2.0) AS BIGINT), {oracle.canonical('category')}{package}
      ORDER BY {oracle.severity_rank('severity')}, -confidence, source_rank, origin, rule_ord, line_number) = 1)"""


STATIC_LIST = ", ".join(STATIC)
EXACT_SQL = f"WITH {static_cte()} SELECT {STATIC_LIST} FROM static"
NEAR_SQL = (f"WITH {static_cte()}, ranked AS (SELECT *, '' AS origin FROM static), "
            f"{near_cte('ranked')} SELECT {STATIC_LIST} FROM near")

# ---------------------------------------------------------------------------
# Scores and full scan
# ---------------------------------------------------------------------------


def scan_cte(project=fixtures.BY_BATCH, per_package=False) -> str:
    """Merged findings of all producers, as the full scan has them."""
    return f"""{static_cte(project, secrets=True, admitted=True)}, {advisories_cte()},
      producers AS (
        SELECT project_id, file_path, line_number, category, severity, confidence, source_rank,
          '' AS origin, rule_ord, title, source_tool, code_snippet FROM static
        UNION ALL SELECT project_id, file_path, line_number, category, severity, confidence,
          source_rank, origin, rule_ord, title, source_tool, code_snippet FROM dependency_findings),
      {near_cte('producers', 'merged', per_package)}"""


MASKED = oracle.masked_sql("code_snippet", [(QUOTED_VALUE, 1)] + [(r.regex, 0) for r in seeds.SECRET_RULES])
SCAN = ("project_id", "file_path", "line_number", "category", "severity", "confidence", "title",
        "source_tool", "code_snippet")


def full_scan(spark, sf_dir, per_package=False):
    """Findings of the whole scan: rules, syntax checks, secrets and dependencies."""
    files = fixtures.files(spark, sf_dir, fixtures.BY_BATCH)
    return scan_findings(files, per_package=per_package).select(*SCAN)


def full_scan_sql(per_package=False) -> str:
    masked = (f"CASE WHEN {oracle.canonical('category')} = 'hardcoded-secrets' THEN {MASKED} "
              "ELSE code_snippet END AS code_snippet")
    return (f"WITH {scan_cte(per_package=per_package)} "
            f"SELECT {', '.join(SCAN[:-1])}, {masked} FROM merged")


SCORE = ("project_id", "overall_score", "security_posture", "total_findings", "critical_count",
         "high_count", "medium_count", "low_count", "worst_severity", "penalty_units")


def project_scores(spark, sf_dir):
    """Score of every project from the findings of the full scan."""
    files = fixtures.files(spark, sf_dir, fixtures.BY_BATCH)
    return score.scores(scan_findings(files), files.select("project_id").distinct()).select(*SCORE)


def score_cte(source="merged", projects="SELECT DISTINCT project_id FROM given_files") -> str:
    scored = "CASE WHEN severity IN ('CRITICAL','HIGH','MEDIUM','LOW') THEN severity ELSE 'MEDIUM' END"
    weights = oracle.case_map("sev", seeds.SEVERITY_WEIGHTS)
    caps = oracle.case_map("worst", dict(enumerate(seeds.SCORE_CAPS.values())), "100")
    names = oracle.case_map("worst", dict(enumerate(seeds.SEVERITIES)))
    return f"""weighed AS (SELECT *, {scored} AS sev FROM {source}),
      sums AS (SELECT project_id, count(*) AS n,
          count(*) FILTER (sev = 'CRITICAL') AS c, count(*) FILTER (sev = 'HIGH') AS h,
          count(*) FILTER (sev = 'MEDIUM') AS m, count(*) FILTER (sev = 'LOW') AS l,
          min({oracle.severity_rank('sev')}) AS worst,
          sum({weights} * greatest(30, least(100, confidence)) *
            CASE WHEN category = 'hardcoded-secrets' THEN 115
                 WHEN category = 'insecure-dependency' AND sev = 'CRITICAL' THEN 110 ELSE 100 END) AS penalty
        FROM weighed GROUP BY project_id),
      capped AS (SELECT p.project_id, n, c, h, m, l, worst, {names} AS worst_severity,
          coalesce(penalty, 0) AS penalty,
          CAST(least(round_even(greatest(0, 1000000 - coalesce(penalty, 0)) / 10000.0, 0), {caps}) AS INTEGER) AS score
        FROM ({projects}) p LEFT JOIN sums USING (project_id)),
      scores AS (SELECT project_id, score AS overall_score,
          CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good'
               WHEN score >= 50 THEN 'Needs Attention' WHEN score >= 25 THEN 'High Risk'
               ELSE 'Critical Risk' END AS security_posture,
          coalesce(n, 0) AS total_findings, coalesce(c, 0) AS critical_count,
          coalesce(h, 0) AS high_count, coalesce(m, 0) AS medium_count, coalesce(l, 0) AS low_count,
          worst_severity, CAST(penalty AS BIGINT) AS penalty_units FROM capped)"""


SCORE_SQL = f"WITH {scan_cte()}, {score_cte()} SELECT {', '.join(SCORE)} FROM scores"

REPORT = ("project_name", "overall_score", "security_posture", "total_findings", "critical_count",
          "high_count", "medium_count", "low_count", "explanations_available", "total_files",
          "python_files", "javascript_files", "config_files", "detected_frameworks")


def scan_reports(spark, sf_dir):
    """Report and metadata of every scanned project."""
    result = scan(fixtures.files(spark, sf_dir, fixtures.BY_BATCH), scan_date="2024-03-05 16:07:09")
    return result.reports.join(result.scan_metadata, "scan_id").select(
        *REPORT[:-1], F.array_join("detected_frameworks", ",").alias("detected_frameworks"))


SCAN_REPORTS_SQL = f"""WITH {scan_cte()}, {score_cte()}, {frameworks_cte()},
  counters AS ({counters_select()})
  SELECT s.project_id AS project_name, {', '.join(REPORT[1:8])}, 'unavailable' AS explanations_available,
    coalesce(total_files, 0) AS total_files, coalesce(python_files, 0) AS python_files,
    coalesce(javascript_files, 0) AS javascript_files, coalesce(config_files, 0) AS config_files,
    coalesce(detected_frameworks, '') AS detected_frameworks
  FROM scores s LEFT JOIN counters USING (project_id) LEFT JOIN frameworks USING (project_id)"""


def finding_scores(spark, sf_dir):
    """Rank, bucket, canonical category and penalty of every static finding."""
    table = static_findings(fixtures.files(spark, sf_dir))
    return table.select(
        "project_id", "file_path", "line_number", "category",
        severity.severity_rank(F.col("severity")).alias("severity_rank"),
        severity.line_bucket(F.col("line_number")).alias("line_bucket"),
        severity.canonical_category(F.upper(F.replace("category", F.lit("-"), F.lit("_")))).alias("canonical"),
        severity.penalty_units(F.col("severity"), F.col("confidence"), F.col("category")).alias("penalty_units"))


FINDING_SCORES_SQL = f"""WITH {static_cte()} SELECT project_id, file_path, line_number, category,
  {oracle.severity_rank('severity')} AS severity_rank, CAST(floor(line_number / 2.0) AS BIGINT) AS line_bucket,
  {oracle.canonical("upper(replace(category, '-', '_'))")} AS canonical,
  CAST({oracle.case_map('severity', seeds.SEVERITY_WEIGHTS)} * greatest(30, least(100, confidence)) *
    CASE WHEN category = 'hardcoded-secrets' THEN 115 ELSE 100 END AS BIGINT) AS penalty_units FROM static"""

# ---------------------------------------------------------------------------
# Snippets and secrets
# ---------------------------------------------------------------------------


def snippet_fill(spark, sf_dir):
    """Syntax findings lose their snippet and get it back from the files."""
    files = fixtures.files(spark, sf_dir)
    table = rules.rule_findings(files, PY + rules.SYNTAX_RULES)
    gone = F.col("source_rank") == rules.SOURCE_RANKS["syntax"]
    table = table.withColumn("code_snippet", F.when(~gone, F.col("code_snippet")))
    return findings.fill_snippets(table, files).select(
        "project_id", "file_path", "line_number", "title", "code_snippet")


SNIPPET_SQL = f"""WITH {raw_cte()} SELECT DISTINCT project_id, file_path, line_number, title, code_snippet
  FROM raw WHERE source_rank IN (2, 4)"""


def masked_secrets(spark, sf_dir):
    """Secrets of a known form and quoted credentials over the plain documents, masked."""
    table = fixtures.select(fixtures.documents(spark, sf_dir), {
        "project_id": "source", "file_path": "CAST(doc_id AS STRING) || '.py'", "content": "text"})
    found = rules.secret_findings(table, seeds.SECRET_RULES + CREDENTIAL)
    return found.select("project_id", "file_path", "line_number", "title", "code_snippet")


MASK_SQL = f"""WITH files AS (SELECT source AS project_id, CAST(doc_id AS STRING) || '.py' AS file_path,
    text AS content FROM documents), {oracle.matches_sql(seeds.SECRET_RULES + CREDENTIAL)},
  {rule_values(seeds.SECRET_RULES + CREDENTIAL)}
  SELECT project_id, file_path, line_number, title, {oracle.masked_sql(
    'code_snippet', [(QUOTED_VALUE, 1)] + [(r.regex, 0) for r in seeds.SECRET_RULES]
    + [('(?i)' + r.regex, 0) for r in CREDENTIAL])} AS code_snippet
  FROM matches JOIN rules USING (rule_id) WHERE match_no = 1"""


def findings_by_severity(spark, sf_dir):
    """Merged findings of every project in display order, with the check of the stored widths."""
    table = scan_findings(fixtures.files(spark, sf_dir, fixtures.BY_BATCH))
    return reports.within_limits(findings.by_severity(table)).select(
        "project_id", "severity", "file_path", "line_number", "category", "title", "fits")


BY_SEVERITY_SQL = f"""WITH {scan_cte()} SELECT project_id, severity, file_path, line_number, category, title,
  confidence BETWEEN 0 AND 100 AND length(title) <= 255 AND length(category) <= 64
    AND length(file_path) <= 1024 AND length(source_tool) <= 64 AS fits
  FROM merged ORDER BY project_id, {oracle.severity_rank('severity')}"""


def decoded_text(spark, sf_dir):
    """Documents stored as bytes with foreign line ends and a broken byte, read back as text."""
    table = fixtures.documents(spark, sf_dir).select("doc_id", F.concat(
        F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary"), F.unhex(F.lit("FF0D41"))).alias("data"))
    text = decode_text(F.col("data"))
    return table.select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.length(text).alias("n_chars"))


DECODED_SQL = """SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars FROM (
  SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || 'A' AS t FROM documents)"""

QUERIES = {
    "q_pattern_findings": lambda spark, d: _matches(spark, d, PY),
    "q_js_findings": lambda spark, d: _matches(spark, d, JS),
    "q_credential_scan": credential_scan,
    "q_taint_xss": taint_xss,
    "q_silent_except": silent_except,
    "q_statement_rules": statement_rules,
    "q_exact_dedupe": exact_dedupe,
    "q_near_dedupe": near_dedupe,
    "q_finding_scores": finding_scores,
    "q_snippet_fill": snippet_fill,
    "q_mask": masked_secrets,
    "q_full_scan": full_scan,
    "q_full_scan_per_package": lambda spark, d: full_scan(spark, d, per_package=True),
    "q_score": project_scores,
    "q_scan_reports": scan_reports,
    "q_findings_by_severity": findings_by_severity,
    "q_decode_text": decoded_text,
}
ORACLES = {
    "q_pattern_findings": _matches_sql(PY),
    "q_js_findings": _matches_sql(JS),
    "q_credential_scan": CREDENTIAL_SQL,
    "q_taint_xss": f"WITH {fixtures.files_sql()}, {TAINT_CTE} SELECT {', '.join(PLACE)} FROM tainted",
    "q_statement_rules": STATEMENT_SQL,
    "q_silent_except": f"WITH {fixtures.files_sql()}, {SILENT_CTE} SELECT {', '.join(PLACE)} FROM silent",
    "q_exact_dedupe": EXACT_SQL,
    "q_near_dedupe": NEAR_SQL,
    "q_finding_scores": FINDING_SCORES_SQL,
    "q_snippet_fill": SNIPPET_SQL,
    "q_mask": MASK_SQL,
    "q_full_scan": full_scan_sql(),
    "q_full_scan_per_package": full_scan_sql(per_package=True),
    "q_score": SCORE_SQL,
    "q_scan_reports": SCAN_REPORTS_SQL,
    "q_findings_by_severity": BY_SEVERITY_SQL,
    "q_decode_text": DECODED_SQL,
}
