"""Rules, areas and markers from tables of any length."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions.literals import owners_in, pattern
from faultline.operators import graph
from faultline.operators.rules import rule_findings
from faultline.plans.scan import scan
from faultline.sources import rulebooks

RULE = "rule_id string, lang string, regex string, title string, category string, severity string, confidence int, hints array<string>, position int"


def test_literals_equal_a_search_for_each(spark):
    rng = random.Random(5)
    letters = "ab -."
    literals = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): [str(i)] for i in range(60)} | {"a.(b": ["x"], "\U0001f600\u00e9": ["y", "x"]}
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "a.(b", "z\U0001f600\u00e9", "a\nb"]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = frame.select("t", owners_in(F.col("t"), literals).alias("any"), owners_in(F.col("t"), literals, alone=True).alias("alone")).collect()
    for row in rows:
        text = row.t or ""
        assert set(row.any) == {o for p, owners in literals.items() if p in text for o in owners}
        assert set(row.alone) == {o for p, owners in literals.items() if re.search(f"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", text) for o in owners}
    with pytest.raises(ValueError, match="empty"):
        pattern([""])


def test_thousands_of_rules_and_areas_from_tables(spark, files):
    rules = rulebooks.rules_in(spark.createDataFrame([
        (f"r{i}", ("py", "js", "any")[i % 3], rf"\bcall{i}\s*\(", f"Call {i}", f"category-{i}", "HIGH", 50, [f"call{i}"] if i % 2 else None, None)
        for i in range(5000)], RULE))
    table = files(("p", "a.py", "x\ncall12 (1)\ncall13(2)\ncall123(3) call11(4)"), ("p", "b.ts", "call13(1) call4999(2)"), ("p", "c.txt", "call14(1)"))
    found = {(r.file_path, r.line_number, r.rule_id) for r in rule_findings(table, rules).collect()}
    assert found == {("a.py", 2, "r12"), ("a.py", 4, "r123"), ("a.py", 4, "r11"), ("b.ts", 1, "r13"), ("b.ts", 1, "r4999"), ("c.txt", 1, "r14")}
    areas = spark.createDataFrame(
        [(f"Area {i}", "kind", "text", f"Category-{i}") for i in range(5000)] + [("Area 1", "kind", "path", "odd/")], "area string, kind string, applies_to string, pattern string")
    findings = spark.createDataFrame([("p", "1", "t", "category-7", "HIGH", "x.py", 1), ("p", "2", "t", "category-77", "LOW", "odd/x.py", 2)],
                                     "project_id string, finding_id string, title string, category string, severity string, file_path string, line_number int")
    assert {(r.finding_id, r.area) for r in graph.classified(findings, areas).collect()} == {
        ("1", "Area 7"), ("2", "Area 7"), ("2", "Area 77"), ("2", "Area 1")}
    nodes, edges = graph.security_graph(findings, areas, adjacent=spark.createDataFrame([("Area 1", "Area 7")], "start string, end string"))
    assert {r.kind for r in nodes.filter("node_type = 'area'").collect()} == {"kind"}
    assert [(r.from_id, r.to_id) for r in edges.filter("NOT is_hierarchy").collect()] == [("area-1", "area-7")]


def test_a_scan_takes_its_rules_and_markers_from_tables(spark, files):
    rules = spark.createDataFrame([("own", "py", r"danger\(", "Danger", "own", "CRITICAL", 90, ["danger"], 2), ("first", "py", "dang", "First", "own", "LOW", 9, None, 1)], RULE)
    markers = spark.createDataFrame([("python", "rocket", "Rocket"), ("npm", "@x/y", "XY")], "manifest string, marker string, label string")
    table = files(("p", "a.py", "danger(1)\neval(2)"), ("p", "requirements.txt", "Rocket==1\nflask==3.0.0"), ("p", "package.json", '{"devDependencies": {"@x/y": "1.0.0"}}'))
    result = scan(table, scan_date="2024-01-02 03:04:05", rule_set=rules, markers=markers)
    assert {(r.title, r.line_number) for r in result.findings.collect() if r.file_path == "a.py"} == {("First", 1)}
    assert result.scan_metadata.first().detected_frameworks == ["Rocket", "XY"]


@pytest.mark.parametrize(("change", "message"), [
    ({"lang": "cobol"}, "language"), ({"regex": "x*"}, "nothing at all"), ({"title": None}, "no title")])
def test_broken_rules_are_refused(spark, change, message):
    row = {"rule_id": "r", "lang": "py", "regex": "x", "title": "t", "category": "c", "severity": "LOW", "confidence": 1, "hints": [], "position": 0} | change
    with pytest.raises(ValueError, match=message):
        rulebooks.rules_in(spark.createDataFrame([tuple(row.values())], RULE))
