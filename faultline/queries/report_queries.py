"""Queries over tool reports, explanations, stored reports and status changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline import seeds
from faultline.operators import explain, reports
from faultline.plans.scan import scan_findings
from faultline.queries import fixtures, oracle
from faultline.queries import rule_queries as rq
from faultline.session import spread
from faultline.sources import reports as tool_reports

# ---------------------------------------------------------------------------
# External tool reports: every event is one report of two results
# ---------------------------------------------------------------------------

ID = "CAST(event_id AS STRING)"
CHECKS = {i: name for i, name in enumerate((
    "python.lang.security.audit-eval", "js.express.xss-via-innerHTML", "generic.secrets.gitleaks-aws2key",
    "use-of-md5", "java.spring.csrf_disabled-now"))}
SEMGREP_BODY = f"""'{{"results": [{{"check_id": "' || {oracle.case_map('event_id % 5', CHECKS)} || '", "path": "/srv/app/src/f' || {ID} || '.py", '
  || '"start": {{"line": ' || CAST(user_id AS STRING) || '}}, "extra": {{"severity": "' || event_type
  || '", "message": "seen ' || event_type || '", "lines": "  call()", "metadata": {{"category": "security"}}}}}}, '
  || '{{"path": "lib/x.py", "extra": {{"severity": "' || CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING'
       WHEN 2 THEN 'INFO' ELSE 'OTHER' END || '"}}}}]}}'"""
BANDIT_BODY = f"""'{{"results": [{{"test_name": "check_' || event_type || '", "test_id": "B60' || CAST(event_id % 9 AS STRING)
  || '", "issue_severity": "' || CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' ELSE 'LOW' END
  || '", "issue_confidence": "' || CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'low' ELSE 'UNDEFINED' END
  || '", "filename": "/srv/app/m' || {ID} || '.py", "line_number": ' || CAST(user_id AS STRING)
  || ', "issue_text": "text ' || event_type || '", "code": "run()"}}, {{"test_name": "bare_' || {ID} || '"}}]}}'"""

REPORTED = ("project_id", "file_path", "line_number", "category", "severity", "confidence", "title",
            "description", "recommendation", "source_tool", "code_snippet")


def tool_findings(spark, sf_dir):
    events = spread(fixtures.read(spark, sf_dir, "events"))

    def body(text):
        return fixtures.select(events, {
            "project_id": "event_type", "root": "'/srv/app'", "body": text})

    return tool_reports.semgrep_findings(body(SEMGREP_BODY)).unionByName(
        tool_reports.bandit_findings(body(BANDIT_BODY))).select(*REPORTED)


def _each(body: str, tool: str) -> str:
    return (f"SELECT event_type AS project_id, '{tool}' AS source_tool, r FROM "
            f"(SELECT event_type, unnest(CAST(json_extract(CAST({body} AS JSON), '$.results') AS JSON[])) AS r FROM events)")


def _text(key: str, other: str = "NULL") -> str:
    return f"coalesce(json_extract_string(r, '{key}'), {other})"


def _relative(path: str) -> str:
    return (f"CASE WHEN starts_with({path}, '/srv/app/') THEN substr({path}, 10) "
            f"ELSE list_last(string_split({path}, '/')) END")


TITLE = "list_last(string_split(" + _text("$.check_id", "'Semgrep finding'") + ", '.'))"
TOOL_SQL = f"""WITH s AS ({_each(SEMGREP_BODY, 'semgrep')}), b AS ({_each(BANDIT_BODY, 'bandit')})
  SELECT project_id, {_relative(_text('$.path', "'unknown'"))} AS file_path,
    CAST(json_extract_string(r, '$.start.line') AS INTEGER) AS line_number,
    {_text('$.extra.metadata.category', "'security-misconfiguration'")} AS category,
    CASE {_text('$.extra.severity', "'WARNING'")} WHEN 'ERROR' THEN 'HIGH' WHEN 'INFO' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
    80 AS confidence,
    array_to_string(list_transform(regexp_extract_all(replace({TITLE}, '-', ' '), '[A-Za-z]+|[^A-Za-z]+'),
      lambda w: upper(w[1]) || lower(w[2:])), '') AS title,
    {_text('$.extra.message', "'Reported by Semgrep without a message.'")} AS description,
    {_text('$.extra.message', "'Follow the guidance of the Semgrep rule.'")} AS recommendation,
    source_tool, {_text('$.extra.lines')} AS code_snippet FROM s
  UNION ALL SELECT project_id, {_relative(_text('$.filename', "'unknown'"))},
    CAST(json_extract_string(r, '$.line_number') AS INTEGER), {_text('$.test_id', "'security-misconfiguration'")},
    upper({_text('$.issue_severity', "'MEDIUM'")}),
    CASE upper({_text('$.issue_confidence', "'MEDIUM'")}) WHEN 'HIGH' THEN 85 WHEN 'MEDIUM' THEN 65 WHEN 'LOW' THEN 40 ELSE 50 END,
    {_text('$.test_name', "'Bandit finding'")}, {_text('$.issue_text', "''")},
    {_text('$.issue_text', "'Read the documentation of the Bandit check.'")}, source_tool, {_text('$.code')} FROM b"""

# ---------------------------------------------------------------------------
# Explanations
# ---------------------------------------------------------------------------

CHOSEN = ("project_id", "file_path", "line_number", "category", "explain_rank")


def _by_source(spark, sf_dir):
    return scan_findings(fixtures.files(spark, sf_dir))


def top_explain(spark, sf_dir):
    """The findings of each project that are sent for explanation, with fields of the request."""
    best = _by_source(spark, sf_dir)
    ranked = explain.top_findings(best)
    from faultline.functions.replies import request_document
    request = request_document(F.col("code_snippet"))
    return ranked.select(*CHOSEN, F.get_json_object(request, "$.finding.title").alias("title"),
                         F.get_json_object(request, "$.finding.severity").alias("severity"))


TOP_SQL = f"""WITH {rq.scan_cte(fixtures.BY_SOURCE)}
  SELECT project_id, file_path, line_number, category, explain_rank, title, severity FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {oracle.severity_rank('severity')},
      source_rank, origin, file_path, line_number NULLS FIRST, rule_ord) AS INTEGER) AS explain_rank FROM merged)
  WHERE explain_rank <= {seeds.EXPLAIN_LIMIT}"""

# Every conversation turn is a finding; every assistant turn is a reply to the turn before it.
TURN = "CAST(conv_id AS STRING) || '-' || CAST({0} AS STRING)"
REPLY_FIELDS = """'", "impact": "' || CASE turn % 4 WHEN 1 THEN '' ELSE 'impact ' || CAST(turn AS STRING) END
  || '", "attack_path": ' || CASE conv_id % 5 WHEN 0 THEN '"none"' WHEN 1 THEN '[]' ELSE '["enter", "climb"]' END
  || ', "recommendation": "do ' || CAST(conv_id AS STRING) || '", "example_fix": ""'
  || CASE WHEN conv_id % 7 = 2 THEN '' ELSE ', "reasoning_summary": "because"' END
  || ', "confidence": ' || CASE conv_id % 6 WHEN 0 THEN '"90"' WHEN 1 THEN '87.9' ELSE CAST(50 + turn AS STRING) END || '}'"""
WORDS = "regexp_replace(text, '[^A-Za-z .]', ' ', 'g')"
REPLY = f"""CASE WHEN conv_id % 3 = 0 THEN '```json' || chr(10) ELSE '' END
  || '{{"explanation": "' || {WORDS} || {REPLY_FIELDS} || CASE WHEN conv_id % 11 = 4 THEN '}}' ELSE '' END
  || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '```' ELSE '' END"""
TURN_FINDING = {
    "project_id": "'c' || CAST(conv_id % 50 AS STRING)", "finding_id": TURN.format("turn"),
    "description": "CASE WHEN turn % 3 = 0 THEN '' ELSE role END", "impact": "'old impact'",
    "recommendation": "'old advice'", "example_fix": "'old fix'",
}
MERGED = ("project_id", "finding_id", "description", "impact", "recommendation", "example_fix",
          "attack_path", "ai_explanation", "ai_reasoning_summary", "ai_confidence", "reply_usable")


def _merged(spark, sf_dir):
    turns = fixtures.read(spark, sf_dir, "conversations")
    table = fixtures.select(turns, TURN_FINDING).withColumn(
        "attack_path", F.array(F.lit("start")))
    reply = REPLY.replace("' ', 'g')", "' ')")
    replies = fixtures.select(turns.filter(F.col("role") == "assistant"), {
        "finding_id": TURN.format("(turn - 1)"), "reply": reply})
    return explain.merge_replies(table, replies)


def merge_replies(spark, sf_dir):
    return _merged(spark, sf_dir).select(*[
        F.array_join(c, ">").alias(c) if c == "attack_path" else F.col(c) for c in MERGED])


def availability(spark, sf_dir):
    return explain.reply_availability(_merged(spark, sf_dir))


REPLY_CTE = f"""replies AS (SELECT {TURN.format('(turn - 1)')} AS finding_id, {REPLY} AS reply FROM conversations WHERE role = 'assistant'),
  opened AS (SELECT finding_id, CASE WHEN starts_with(reply, '```') THEN
      regexp_replace(regexp_replace(reply, '^[^\\n]*\\n', ''), '\\n```$', '') ELSE reply END AS body FROM replies),
  typed AS (SELECT finding_id, CAST(body AS JSON) AS j FROM opened WHERE json_valid(body)),
  usable AS (SELECT * FROM typed WHERE
      len(list_filter(['explanation','impact','attack_path','recommendation','example_fix','reasoning_summary','confidence'],
        lambda k: list_contains(json_keys(j), k))) = 7
      AND json_type(j, '$.attack_path') = 'ARRAY'
      AND json_type(j, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')),
  turns AS (SELECT {', '.join(f'{v} AS {k}' for k, v in TURN_FINDING.items())} FROM conversations),
  merged AS (SELECT project_id, finding_id,
      coalesce(nullif(description, ''), j->>'$.explanation', description) AS description,
      coalesce(nullif(j->>'$.impact', ''), impact) AS impact,
      coalesce(nullif(j->>'$.recommendation', ''), recommendation) AS recommendation,
      coalesce(nullif(j->>'$.example_fix', ''), example_fix) AS example_fix,
      CASE WHEN json_array_length(j, '$.attack_path') > 0 THEN
        array_to_string(CAST(j->'$.attack_path' AS VARCHAR[]), '>') ELSE 'start' END AS attack_path,
      j->>'$.explanation' AS ai_explanation, j->>'$.reasoning_summary' AS ai_reasoning_summary,
      CAST(trunc(CAST(j->>'$.confidence' AS DOUBLE)) AS INTEGER) AS ai_confidence,
      j IS NOT NULL AS reply_usable
    FROM turns LEFT JOIN usable USING (finding_id))"""


def posture_requests(spark, sf_dir):
    return explain.posture_requests(rq.project_scores(spark, sf_dir))


POSTURE_SQL = f"""WITH {rq.scan_cte()}, {rq.score_cte()} SELECT project_id,
  'Summarise in two or three plain sentences how safe this code base is. Score ' || overall_score || ' of 100; '
  || 'critical ' || critical_count || ', high ' || high_count || ', medium ' || medium_count || ', low ' || low_count
  || '.' AS request FROM scores"""

# ---------------------------------------------------------------------------
# Stored reports: orders as reports, line items as findings
# ---------------------------------------------------------------------------

REPORT = {
    "scan_id": "CAST(o_orderkey AS STRING)", "project_name": "'project' || CAST(o_custkey AS STRING)",
    "scan_date": "o_orderdate", "overall_score": "CAST(floor(o_totalprice) AS BIGINT) % 101",
    "security_posture": "o_orderpriority",
}
# Every third report was stopped: its metadata is stored under another id.
METADATA = {
    "scan_id": "CASE WHEN o_orderkey % 3 = 0 THEN 'stopped-' ELSE '' END || CAST(o_orderkey AS STRING)", "total_files": "o_custkey % 50",
    "scan_duration": "CAST(o_custkey % 90 AS DOUBLE) / 4",
}
# Line items of some suppliers belong to no report.
STORED = {
    "scan_id": "CASE WHEN l_suppkey % 10 = 3 THEN 'unknown-' ELSE '' END || CAST(l_orderkey AS STRING)",
    "finding_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
                  " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING)",
    "severity": "CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'MEDIUM' ELSE 'HIGH' END",
    "confidence": "CAST(l_quantity AS INT)",
}


def _columns(columns: dict) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def _stored(spark, sf_dir):
    orders = fixtures.read(spark, sf_dir, "orders")
    return (fixtures.select(orders, REPORT),
            fixtures.select(fixtures.read(spark, sf_dir, "lineitem"), STORED),
            fixtures.select(orders, METADATA))


STORED_CTE = f"""reports AS (SELECT {_columns(REPORT)} FROM orders),
  findings AS (SELECT {_columns(STORED)} FROM lineitem),
  metadata AS (SELECT {_columns(METADATA)} FROM orders)"""


def report_findings(spark, sf_dir):
    """Findings of the reports there are, in their order within the report."""
    stored, found, _ = _stored(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.monotonically_increasing_id()))
    return reports.report_findings(stored, found).withColumn("place", place)


def latest_reports(spark, sf_dir):
    return reports.latest_per_project(_stored(spark, sf_dir)[0])


def latest_report(spark, sf_dir):
    return reports.latest_report(_stored(spark, sf_dir)[0])


def report_detail(spark, sf_dir):
    return reports.report_detail(*_stored(spark, sf_dir))


def report_list(spark, sf_dir):
    return reports.newest_first(_stored(spark, sf_dir)[0])


def latest_detail(spark, sf_dir):
    """The newest report with its findings and metadata."""
    stored, found, meta = _stored(spark, sf_dir)
    latest = reports.latest_report(stored)
    return reports.report_detail(latest, found.join(latest.select("scan_id"), "scan_id", "left_semi"), meta)


ONE_ID = "128"


def report_by_id(spark, sf_dir):
    """One report by its id, with the findings it has."""
    stored, found, meta = _stored(spark, sf_dir)
    return reports.report_detail(
        reports.report_by_id(stored, ONE_ID), found.filter(F.col("scan_id") == ONE_ID), meta)


DETAIL = "SELECT * FROM {0} LEFT JOIN metadata USING (scan_id) LEFT JOIN findings USING (scan_id)"

STATE = oracle.case_map("event_type", {
    "signup": "OPEN", "error": "FALSE_POSITIVE", "click": "IGNORED", "purchase": "FIXED", "view": "SEEN"})
CHANGE = {"finding_id": "CAST(user_id AS STRING)", "status": STATE, "changed_at": "ts", "change_id": "event_id"}


def status_current(spark, sf_dir):
    """Customers stand for findings, events for status changes."""
    found = fixtures.select(fixtures.read(spark, sf_dir, "customer"), {"finding_id": "CAST(c_custkey AS STRING)"})
    return reports.current_status(found, fixtures.select(fixtures.read(spark, sf_dir, "events"), CHANGE))


STATUS_SQL = f"""WITH changes AS (SELECT {_columns(CHANGE)} FROM events),
  last AS (SELECT finding_id, status FROM changes WHERE status IN {oracle.in_list(seeds.FINDING_STATES)}
    QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY changed_at DESC, change_id DESC) = 1)
  SELECT CAST(c_custkey AS STRING) AS finding_id, coalesce(status, 'OPEN') AS status
  FROM customer LEFT JOIN last ON last.finding_id = CAST(c_custkey AS STRING)"""

QUERIES = {
    "q_tool_reports": tool_findings, "q_top_explain": top_explain, "q_merge_replies": merge_replies,
    "q_reply_availability": availability, "q_posture_requests": posture_requests,
    "q_report_findings": report_findings, "q_latest_reports": latest_reports,
    "q_latest_report": latest_report, "q_report_detail": report_detail, "q_report_list": report_list,
    "q_latest_detail": latest_detail, "q_report_by_id": report_by_id,
    "q_status_current": status_current,
}
ORACLES = {
    "q_tool_reports": TOOL_SQL, "q_top_explain": TOP_SQL,
    "q_merge_replies": f"WITH {REPLY_CTE} SELECT {', '.join(MERGED)} FROM merged",
    "q_reply_availability": f"WITH {REPLY_CTE} SELECT project_id, CASE WHEN bool_or(reply_usable) THEN 'available' "
                            "ELSE 'unavailable' END AS explanations_available FROM merged GROUP BY project_id",
    "q_posture_requests": POSTURE_SQL,
    "q_report_findings": f"WITH {STORED_CTE} SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY "
                         f"{oracle.severity_rank('severity')}, finding_id) AS INTEGER) AS place "
                         "FROM findings SEMI JOIN reports USING (scan_id)",
    "q_latest_reports": f"WITH {STORED_CTE} SELECT * FROM reports QUALIFY row_number() OVER "
                        "(PARTITION BY project_name ORDER BY scan_date DESC, scan_id DESC) = 1",
    "q_latest_report": f"WITH {STORED_CTE} SELECT * FROM reports ORDER BY scan_date DESC, scan_id LIMIT 1",
    "q_report_detail": f"WITH {STORED_CTE} " + DETAIL.format("reports"),
    "q_latest_detail": f"WITH {STORED_CTE}, latest AS (SELECT * FROM reports ORDER BY scan_date DESC, scan_id LIMIT 1) "
                       + DETAIL.format("latest"),
    "q_report_by_id": f"WITH {STORED_CTE}, one AS (SELECT * FROM reports WHERE scan_id = '{ONE_ID}') " + DETAIL.format("one"),
    "q_report_list": f"WITH {STORED_CTE} SELECT * FROM reports",
    "q_status_current": STATUS_SQL,
}
