"""All registered queries and their checks."""

from __future__ import annotations

from faultline.queries import (
    admission_queries, dependency_queries, graph_queries, report_queries, rule_queries)

_GROUPS = (rule_queries, dependency_queries, admission_queries, report_queries, graph_queries)

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
