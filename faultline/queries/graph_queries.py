"""Queries over security areas, the graph and the dashboard."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from faultline import seeds
from faultline.functions.areas import SEPARATORS, SHORT
from faultline.operators import dashboard, graph, ordered
from faultline.plans.scan import scan, scan_findings
from faultline.queries import fixtures, oracle
from faultline.queries import rule_queries as rq
from faultline.session import cut


def _findings(spark, sf_dir):
    return scan_findings(fixtures.files(spark, sf_dir))


# ---------------------------------------------------------------------------
# Classification, as joins with pattern tables
# ---------------------------------------------------------------------------

_TEXT_ROWS = [(area.name, p, re.sub(SEPARATORS, " ", p), 1 if len(p) <= SHORT else 0)
              for area in seeds.AREAS for p in area.text_patterns]
_PATH_ROWS = [(area.name, p) for area in seeds.AREAS for p in area.path_patterns]


def _names(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '[_\\-/.\\s]+', ' ', 'g')"
    return (f"(short = 0 AND contains({plain}, plain)) OR (short = 1 AND regexp_matches(lower({text}), "
            "'(^|[^a-z0-9])' || pattern || '($|[^a-z0-9])'))")


CLASSIFIED_CTE = f"""{rq.scan_cte(fixtures.BY_SOURCE)},
  {oracle.values_table('text_rules', 'area, pattern, plain, short', _TEXT_ROWS)},
  {oracle.values_table('path_rules', 'area, pattern', _PATH_ROWS)},
  found AS (SELECT *, row_number() OVER () AS fid FROM merged),
  claims AS (
    SELECT fid, area FROM found JOIN text_rules ON ({_names('category')}) OR ({_names('title')})
    UNION SELECT fid, area FROM found JOIN path_rules ON contains(lower(file_path), pattern)),
  members AS (
    SELECT f.*, area FROM found f JOIN claims USING (fid)
    UNION ALL SELECT f.*, CASE WHEN regexp_matches(lower(file_path), '\\.(py|rb|go|java|cs|php)$') THEN 'Backend'
      WHEN regexp_matches(lower(file_path), '\\.(js|jsx|ts|tsx|vue|svelte)$') THEN 'Frontend'
      WHEN regexp_matches(lower(file_path), '\\.(sql|db|sqlite)$') THEN 'Database'
      WHEN regexp_matches(lower(file_path), '\\.(ya?ml|toml|ini|cfg|conf|json)$') THEN 'Configuration'
      ELSE 'Backend' END
    FROM found f ANTI JOIN claims USING (fid))"""


def areas(spark, sf_dir):
    return graph.classified(_findings(spark, sf_dir)).select("project_id", "full_path", "line", "title", "severity", "area")


AREAS_SQL = (f"WITH {CLASSIFIED_CTE} SELECT project_id, file_path AS full_path, line_number AS line, title, severity, area FROM members")

# ---------------------------------------------------------------------------
# Nodes and edges
# ---------------------------------------------------------------------------

RANK = oracle.case_map("severity", seeds.GRAPH_RANKS, "0")
NAME = oracle.case_map("rank", {v: k for k, v in seeds.GRAPH_RANKS.items()})
KIND = oracle.case_map("area", {area.name: area.kind for area in seeds.AREAS})
AREA_ID = "lower(replace({0}, ' ', '-'))"

GRAPH_CTE = f"""{CLASSIFIED_CTE},
  file_groups AS (SELECT project_id, area, file_path, count(*) AS n, max({RANK}) AS rank FROM members GROUP BY ALL),
  area_rows AS (SELECT project_id, area, CAST(sum(n) AS BIGINT) AS n, max(rank) AS rank, count(*) AS file_count
    FROM file_groups GROUP BY ALL),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY area) - 1 AS i,
    count(*) OVER (PARTITION BY project_id) AS c FROM area_rows),
  area_nodes AS (SELECT project_id, {AREA_ID.format('area')} AS node_id, area, {KIND} AS kind,
      CASE WHEN c = 1 THEN 50.0 WHEN c = 2 THEN CASE WHEN i = 0 THEN 30.0 ELSE 70.0 END
        ELSE floor((50 + 30 * cos(2 * pi() * i / c - pi() / 2)) * 10 + 0.5) / 10 END AS x,
      CASE WHEN c <= 2 THEN 50.0 ELSE floor((50 + 26 * sin(2 * pi() * i / c - pi() / 2)) * 10 + 0.5) / 10 END AS y,
      n AS finding_count, rank, {NAME} AS highest_severity, file_count FROM ordered),
  file_rows AS (SELECT f.*, a.node_id AS parent_id, a.x AS ax, a.y AS ay, a.file_count,
      row_number() OVER (PARTITION BY f.project_id, f.area ORDER BY f.file_path) - 1 AS i
    FROM file_groups f JOIN area_nodes a USING (project_id, area)),
  file_nodes AS (SELECT project_id, parent_id || '-' || regexp_replace(file_path, '[^a-zA-Z0-9]', '-', 'g') AS node_id,
      parent_id, file_path AS full_path, list_last(string_split(file_path, '/')) AS label, i AS ordinal,
      floor((ax + (8 + greatest(0, file_count - 5)) * cos(2 * pi() * i / file_count)) * 10 + 0.5) / 10 AS x,
      floor((ay + (8 + greatest(0, file_count - 5)) * sin(2 * pi() * i / file_count)) * 10 + 0.5) / 10 AS y,
      n AS finding_count, rank, {NAME} AS highest_severity FROM file_rows),
  {oracle.values_table('adjacency', 'p, q', seeds.ADJACENT_AREAS)},
  edges AS (
    SELECT project_id, parent_id AS from_id, node_id AS to_id, rank >= 3 AS active, TRUE AS is_hierarchy FROM file_nodes
    UNION ALL SELECT a.project_id, a.node_id, b.node_id, a.rank >= 3 OR b.rank >= 3, FALSE
    FROM adjacency JOIN area_nodes a ON a.area = p JOIN area_nodes b ON b.area = q AND b.project_id = a.project_id)"""


def _groups(spark, sf_dir):
    return graph.file_groups(graph.classified(_findings(spark, sf_dir)))


AREA_NODE = ("project_id", "node_id", "area", "kind", "x", "y", "finding_count", "highest_severity", "file_count")
FILE_NODE = ("project_id", "node_id", "parent_id", "full_path", "label", "ordinal", "x", "y", "finding_count", "highest_severity")


def area_nodes(spark, sf_dir):
    return graph.placed_areas(_groups(spark, sf_dir)).select(*AREA_NODE)


def file_nodes(spark, sf_dir):
    groups = cut(_groups(spark, sf_dir))
    return graph.placed_files(groups, graph.placed_areas(groups)).select(*FILE_NODE)


def file_order(spark, sf_dir):
    """Files of each area in the order of the Unicode collation, case last."""
    groups = cut(_groups(spark, sf_dir)).withColumn("full_path", F.when(
        F.length("full_path") % 2 == 0, F.upper("full_path")).otherwise(F.col("full_path")))
    return ordered.ordinals(groups, ["project_id", "area"], "full_path", "ordinal", "UNICODE").select(
        "project_id", "area", "full_path", "ordinal")


def edges(spark, sf_dir):
    return graph.security_graph(_findings(spark, sf_dir)).edges


def graph_nodes(spark, sf_dir):
    return graph.security_graph(_findings(spark, sf_dir)).nodes


NODES_SQL = f"""WITH {GRAPH_CTE}
  SELECT project_id, node_id, 'area' AS node_type, area AS label, kind, x, y, finding_count, highest_severity,
    NULL AS parent_id, NULL AS full_path FROM area_nodes
  UNION ALL SELECT project_id, node_id, 'file', label, 'FILE', x, y, finding_count, highest_severity, parent_id, full_path FROM file_nodes"""


def area_members(spark, sf_dir):
    """Findings listed by area pages, unrolled again; pages hold about 40 findings."""
    pages = graph.member_pages(graph.classified(_findings(spark, sf_dir)), page_size=40)
    return pages.select("project_id", "area", F.explode("findings").alias("f")).groupBy("project_id", "area").agg(
        F.count("*").alias("finding_count"), F.countDistinct("f.finding_id").alias("distinct_findings"),
        F.sum(F.coalesce("f.line", F.lit(0))).alias("line_sum"))


MEMBERS_SQL = f"""WITH {CLASSIFIED_CTE} SELECT project_id, area, count(*) AS finding_count,
  count(DISTINCT fid) AS distinct_findings, CAST(sum(coalesce(line_number, 0)) AS BIGINT) AS line_sum FROM members GROUP BY ALL"""

UNCLAIMED_SQL = f"""WITH {CLASSIFIED_CTE}, plain AS (SELECT *, title AS t FROM found ANTI JOIN claims USING (fid))
  SELECT project_id, file_path, area, count(*) AS n FROM members SEMI JOIN plain USING (fid) GROUP BY ALL"""


def unclaimed(spark, sf_dir):
    return graph.unclaimed(_findings(spark, sf_dir)).groupBy("project_id", "file_path", "area").agg(
        F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Dashboard
# ---------------------------------------------------------------------------

SHOWN = ("project_id", "cve", "title", "asset", "severity", "cvss", "vector", "detected", "status")
SCAN_DATE = "2024-03-05 16:07:09"
STATUS = "CASE length(file_path) % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'FIXED' WHEN 2 THEN 'IGNORED' ELSE 'FALSE_POSITIVE' END"


def dashboard_rows(spark, sf_dir):
    found = scan(fixtures.files(spark, sf_dir), scan_date=SCAN_DATE).findings
    return dashboard.vulnerability_rows(found.withColumn("status", F.expr(STATUS))).select(*SHOWN)


DASHBOARD_SQL = f"""WITH {rq.scan_cte(fixtures.BY_SOURCE)}, shown AS (SELECT *, {STATUS} AS state FROM merged)
  SELECT project_id, upper(category) AS cve, title,
    file_path || coalesce(':' || nullif(line_number, 0), '') AS asset, lower(severity) AS severity,
    CAST({oracle.case_map('lower(severity)', seeds.CVSS, '5.0')} AS DOUBLE) AS cvss, category AS vector,
    '3/5/2024, 4:07:09 PM' AS detected,
    CASE WHEN state IN ('FIXED', 'FALSE_POSITIVE') THEN 'contained' WHEN state = 'IGNORED' THEN 'investigating'
      ELSE 'active' END AS status FROM shown"""


def risk(spark, sf_dir):
    return dashboard.risk_rows(rq.project_scores(spark, sf_dir))


RISK_SQL = f"""WITH {rq.scan_cte()}, {rq.score_cte()} SELECT project_id, 100 - overall_score AS risk_index,
  CASE WHEN overall_score <= 25 THEN 'critical' WHEN overall_score <= 50 THEN 'high' WHEN overall_score <= 75 THEN 'medium'
    ELSE 'low' END AS risk_severity,
  CASE WHEN overall_score <= 25 THEN 'Critical Exposure' WHEN overall_score <= 50 THEN 'Elevated Risk'
    WHEN overall_score <= 75 THEN 'Moderate Risk' ELSE 'Low Risk' END AS risk_label FROM scores"""


def metrics(spark, sf_dir):
    result = scan(fixtures.files(spark, sf_dir, fixtures.BY_BATCH), scan_date=SCAN_DATE, duration=2.0)
    names = result.reports.select("scan_id", "project_name")
    return dashboard.metric_rows(result.reports, result.scan_metadata).join(names, "scan_id").drop("scan_id")


METRICS_SQL = f"""WITH {rq.scan_cte()}, {rq.score_cte()}, counters AS (SELECT project_id, count(*) AS total_files FROM files GROUP BY 1)
  SELECT project_id AS project_name, total_findings AS findings, security_posture AS posture, coalesce(total_files, 0) AS files_analyzed,
    critical_count AS critical, high_count AS high, '2s' AS duration FROM scores LEFT JOIN counters USING (project_id)"""

QUERIES = {
    "q_areas": areas, "q_unclaimed_areas": unclaimed, "q_area_nodes": area_nodes, "q_file_nodes": file_nodes, "q_file_order": file_order,
    "q_graph_nodes": graph_nodes, "q_edges": edges, "q_area_members": area_members,
    "q_dashboard": dashboard_rows, "q_risk": risk, "q_metrics": metrics,
}
ORACLES = {
    "q_areas": AREAS_SQL, "q_unclaimed_areas": UNCLAIMED_SQL,
    "q_area_nodes": f"WITH {GRAPH_CTE} SELECT {', '.join(AREA_NODE)} FROM area_nodes",
    "q_file_order": f"""WITH {GRAPH_CTE}, cased AS (
        SELECT project_id, area, CASE WHEN length(file_path) % 2 = 0 THEN upper(file_path) ELSE file_path END AS full_path FROM file_groups)
      SELECT *, row_number() OVER (PARTITION BY project_id, area ORDER BY lower(full_path), full_path DESC) - 1 AS ordinal FROM cased""",
    "q_file_nodes": f"WITH {GRAPH_CTE} SELECT {', '.join(FILE_NODE)} FROM file_nodes",
    "q_graph_nodes": NODES_SQL, "q_edges": f"WITH {GRAPH_CTE} SELECT * FROM edges",
    "q_area_members": MEMBERS_SQL, "q_dashboard": DASHBOARD_SQL, "q_risk": RISK_SQL, "q_metrics": METRICS_SQL,
}
