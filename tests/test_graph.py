"""Areas, nodes, edges and display rows."""

from __future__ import annotations

import math

import pytest

from faultline.operators import dashboard, graph

FINDING = ("project_id string, finding_id string, title string, category string, severity string, "
           "file_path string, line_number int")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([
        ("p", "1", "Use of eval()", "unsafe-code-execution", "CRITICAL", "backend/a.py", 3),
        ("p", "2", "md5", "weak-cryptography", "medium", "backend/a.py", 0),
        ("p", "3", "", "hardcoded_sql_expressions", "LOW", "x/y.unknown", 1),
        ("p", "4", "plain", "other", "HIGH", "lib/foci/a-b.py", 1),
        ("p", "5", "plain", "other", "INFO", "lib/foci/a/b.py", 2),
        ("p", "6", "plain", "axss", "LOW", "", None),
        ("one", "7", "plain", "other", "LOW", "main.go", 1),
        ("two", "8", "xss", "sqli", "LOW", "main.go", 1),
    ], FINDING)


def test_classification(table):
    got = {}
    for r in graph.classified(table).collect():
        got.setdefault(r.finding_id, set()).add(r.area)
    assert got == {
        "1": {"Backend"}, "2": {"Backend", "Cryptography"}, "3": {"Database"}, "4": {"Infrastructure"},
        "5": {"Infrastructure"}, "6": {"Backend"}, "7": {"Backend"}, "8": {"Frontend", "Database"}}
    assert {r.finding_id for r in graph.unclaimed(table).collect()} == {"6", "7"}


def test_nodes_and_edges(table):
    nodes, edges = graph.security_graph(table)
    rows = nodes.collect()
    areas = {(r.project_id, r.node_id): r for r in rows if r.node_type == "area"}
    backend = areas["p", "backend"]
    assert (backend.finding_count, backend.highest_severity, backend.kind) == (3, "CRITICAL", "compute")
    assert areas["one", "backend"].x == 50 and areas["one", "backend"].y == 50
    assert [areas["two", i].x for i in ("database", "frontend")] == [30, 70]
    order = ["backend", "cryptography", "database", "infrastructure"]
    for i, node in enumerate(order):
        angle = -math.pi / 2 + 2 * math.pi * i / len(order)
        assert areas["p", node].x == math.floor((50 + 30 * math.cos(angle)) * 10 + .5) / 10
        assert areas["p", node].y == math.floor((50 + 26 * math.sin(angle)) * 10 + .5) / 10
    files = [r for r in rows if r.node_type == "file" and r.project_id == "p"]
    assert sorted((r.parent_id, r.full_path, r.finding_count, r.highest_severity) for r in files) == [
        ("backend", "backend/a.py", 2, "CRITICAL"), ("cryptography", "backend/a.py", 1, "MEDIUM"),
        ("database", "x/y.unknown", 1, "LOW"), ("infrastructure", "lib/foci/a-b.py", 1, "HIGH"),
        ("infrastructure", "lib/foci/a/b.py", 1, "INFO")]
    # two paths may share an id
    assert len({r.node_id for r in files if r.parent_id == "infrastructure"}) == 1
    linked = {(r.from_id, r.to_id): r.active for r in edges.collect() if r.project_id == "p" and not r.is_hierarchy}
    assert linked == {
        ("backend", "database"): True, ("backend", "cryptography"): True, ("database", "cryptography"): False,
        ("infrastructure", "backend"): True}
    assert edges.filter("is_hierarchy").count() == nodes.filter("node_type = 'file'").count()


def test_file_ordinals_of_large_groups(spark):
    rows = [("p", str(i), "t", "other", "LOW", f"d{i % 50:02d}/f.py", i) for i in range(400)]
    groups = graph.file_groups(graph.classified(spark.createDataFrame(rows, FINDING)))
    placed = graph.placed_files(groups, graph.placed_areas(groups)).collect()
    for area in {r.area for r in placed}:
        found = sorted((r.ordinal, r.full_path) for r in placed if r.area == area)
        assert found == list(enumerate(sorted(r.full_path for r in placed if r.area == area)))


def test_member_pages_lose_nothing(table):
    members = graph.classified(table)
    keys = ("project_id", "area", "full_path")
    whole = {f"{r.project_id}|{r.area}|{r.full_path}": [f.finding_id for f in r.findings]
             for r in graph.member_pages(members, keys).collect()}
    assert whole["p|Backend|backend/a.py"] == ["1", "2"] and whole["p|Backend|None"] == ["6"]
    paged = graph.member_pages(members, page_size=1).collect()
    ids = sorted(f.finding_id for r in paged for f in r.findings)
    assert ids == sorted(r.finding_id for r in members.collect())
    titles = {f.finding_id: (f.title, f.line) for r in paged for f in r.findings}
    assert titles["3"] == ("Unknown vulnerability", 1) and titles["2"] == ("md5", None)


def test_display_rows(spark):
    table = spark.createDataFrame([
        ("p", "1", "xss", "t", "HIGH", "a.py", 3, None, "FIXED"), ("p", "2", "b", "t", "odd", "b.py", 0, "d", "IGNORED"),
        ("p", "3", "c", "t", "Low", "c.py", None, "", "OPEN")],
        "project_id string, finding_id string, category string, title string, severity string, file_path string, "
        "line_number int, description string, status string").selectExpr("*", "timestamp_ntz'2024-03-05 16:07:09' AS created_at")
    rows = {r.finding_id: r for r in dashboard.vulnerability_rows(table).collect()}
    assert (rows["1"].asset, rows["1"].cve, rows["1"].cvss, rows["1"].status, rows["1"].description) == (
        "a.py:3", "XSS", 7.5, "contained", "No description provided.")
    assert (rows["2"].asset, rows["2"].cvss, rows["2"].status) == ("b.py", 5.0, "investigating")
    assert (rows["3"].cvss, rows["3"].status, rows["3"].description) == (2.5, "active", "")
    assert rows["1"].detected == "3/5/2024, 4:07:09 PM"
    scores = spark.createDataFrame([(str(s), s) for s in (0, 25, 26, 50, 75, 76, 100)], "project_id string, overall_score int")
    assert [r.risk_severity for r in dashboard.risk_rows(scores).collect()] == [
        "critical", "critical", "high", "high", "medium", "low", "low"]
    assert {r.high for r in dashboard.recounted(table).collect()} == {1}
