"""Whole scans with results worked out by hand."""

from __future__ import annotations

import pytest

from faultline import schema
from faultline.plans.scan import scan, scan_payloads, static_findings

SHOP = [
    ("shop/backend/app.py", 'import os\nos.system("ls")'),
    ("shop/backend/requirements.txt", "flask==0.12.3"),
    ("shop/frontend/package.json", '{"dependencies": {"express": "4.17.2"}}'),
    ("shop/frontend/src/App.tsx", 'console.log("hello");'),
    ("shop/frontend/src/index.tsx", 'import React from "react";'),
    ("shop/backend/models.py", "class User: pass"),
    ("shop/backend/auth.py", 'password = "super_secret_password_123"'),
    ("shop/backend/utils.py", 'import yaml\nyaml.load("test")'),
    ("shop/backend/config.py", "DEBUG = True"),
    ("shop/frontend/src/api.js", 'fetch("http://example.com", {mode: "no-cors"})'),
    ("shop/frontend/src/components/List.tsx",
     'export default () => <div dangerouslySetInnerHTML={{__html: "hello"}} />'),
]
BLOCKED = [
    ("app.py", 'print("hello")'),
    ("myenv/Lib/site-packages/pytest/__init__.py", ""),
    ("node_modules/express/index.js", "console.log(1)"),
]
WRAPPED = [("w/backend/app.py", 'import os\nos.system("ls")'), ("w/frontend/App.tsx", "console.log(1)")]
CLIMBING = [("../x.py", "eval(x)")]
DAY = "2024-01-02 03:04:05"


@pytest.fixture(scope="module")
def result(spark):
    payloads = spark.createDataFrame(
        [("shop", SHOP), ("blocked", BLOCKED), ("wrapped", WRAPPED), ("climbing", CLIMBING),
         ("skipped only", [("a.bin", "x")])], schema.PAYLOAD)
    return scan_payloads(payloads, scan_date=DAY, secret_rules=())


def by_name(rows, key="project_name"):
    return {r[key]: r for r in rows}


def test_findings_of_a_small_project(result):
    names = result.reports.select("scan_id", "project_name")
    rows = result.findings.join(names, "scan_id").filter("project_name = 'shop'").collect()
    assert sorted((r.severity, r.file_path, r.line_number, r.category, r.confidence) for r in rows) == [
        ("CRITICAL", "backend/auth.py", 1, "hardcoded-secrets", 70),
        ("HIGH", "backend/app.py", 2, "command-injection", 80),
        ("HIGH", "backend/utils.py", 2, "insecure-deserialization", 70),
        ("HIGH", "frontend/src/components/List.tsx", 1, "xss", 65),
        ("MEDIUM", "backend/config.py", 1, "security-misconfiguration", 70),
        ("MEDIUM", "dependency manifest", None, "insecure-dependency", 85),
    ]
    assert all(r.description and r.impact and r.recommendation for r in rows)
    secret = next(r for r in rows if r.category == "hardcoded-secrets")
    assert secret.code_snippet == 'password = "supe*****************_123"'


def test_reports(result):
    reports = by_name(result.reports.collect())
    assert set(reports) == {"shop", "blocked", "wrapped", "skipped only"}
    shown = {n: (r.overall_score, r.security_posture, r.total_findings) for n, r in reports.items()}
    assert shown["shop"] == (24, "Critical Risk", 6)
    assert shown["blocked"] == (100, "Excellent", 0)
    assert shown["wrapped"] == (49, "High Risk", 1)
    assert shown["skipped only"] == (100, "Excellent", 0)


def test_metadata(result):
    rows = result.scan_metadata.join(result.reports.select("scan_id", "project_name"), "scan_id").collect()
    meta = {r.project_name: (r.total_files, r.python_files, r.javascript_files, r.config_files,
                             r.detected_frameworks) for r in rows}
    assert meta["shop"] == (11, 5, 4, 2, ["Express", "Flask"])
    assert meta["blocked"] == (1, 1, 0, 0, [])
    assert meta["wrapped"] == (2, 1, 1, 0, [])
    assert meta["skipped only"] == (0, 0, 0, 0, [])


def test_empty_project(spark, files):
    projects = spark.createDataFrame([("empty",)], "project_id string")
    report = scan(files(), projects, scan_date=DAY).reports.first()
    assert (report.overall_score, report.security_posture, report.total_findings) == (100, "Excellent", 0)


def test_keep_gives_the_same_result(spark, files):
    table = files(("p", "a.py", "eval(x)\nos.system(y)"), ("p", "requirements.txt", "flask==0.1"))
    plain, kept = scan(table, scan_date=DAY), scan(table, scan_date=DAY, keep=True)
    for one, other in zip(plain[:3], kept[:3]):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_order_of_files_does_not_matter(files):
    rows = [("p", f"d/f{i}.py", "eval(x)\nh = md5(b)\npassword = 'abcd1234'") for i in range(20)]
    one = scan(files(*rows), scan_date=DAY).findings.collect()
    other = scan(files(*reversed(rows)), scan_date=DAY).findings.collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_external_report_wins_within_a_line(spark, files):
    from faultline.sources.reports import bandit_findings

    body = ('{"results": [{"test_id": "command-injection", "test_name": "shell", "issue_severity": "LOW",'
            ' "issue_confidence": "HIGH", "filename": "/r/a.py", "line_number": 1}]}')
    reports = spark.createDataFrame([("p", "/r", body)], "project_id string, root string, body string")
    table = files(("p", "a.py", "os.system(x)"))
    rows = static_findings(table, bandit=bandit_findings(reports)).collect()
    assert [(r.source_tool, r.severity) for r in rows] == [("bandit", "LOW")]


def test_per_package_keeps_every_package(files):
    table = files(("p", "requirements.txt", "flask==0.1\nrequests==1.0\nflask==0.2"))
    assert scan(table, scan_date=DAY).reports.first().total_findings == 1
    rows = scan(table, scan_date=DAY, per_package=True).findings.collect()
    assert sorted(r.title for r in rows) == [
        "Vulnerable dependency: flask", "Vulnerable dependency: requests"]


def test_syntax_checks(files):
    table = files(
        ("p", "hit.py", 'name = request.args.get("n")\ndef f():\n    return f"<b>{name!r:>10}</b>"'),
        ("p", "long.py", 'n = request.form.get("n")\nx = 1\nreturn f"""<p>\n{n}\n</p>"""\nreturn f"{m}"'),
        ("p", "escaped.py", 'name = request.args.get("n")\nreturn f"{{name}}"'),
        ("p", "other.py", 'name = request.args["n"]\nreturn f"{name}"'),
        ("p", "chained.py", 'name = request.args.get("n").strip()\nreturn f"{name}"'),
        ("p", "plain.py", "try:\n    f()\nexcept:\n    # why\n\n    pass\nx = 1"),
        ("p", "two.py", "try:\n    f()\nexcept:\n    pass\n    pass  # again\n"),
        ("p", "goes_on.py", "try:\n    f()\nexcept:\n    pass\n    g()\n"),
        ("p", "typed.py", "try:\n    f()\nexcept ValueError:\n    pass\n"),
        ("p", "short.py", "try: f()\nexcept: pass\n"),
        ("p", "nested.py", "if x:\n    try:\n        f()\n    except:\n        pass\n    y = 1\n"),
    )
    rows = static_findings(table).collect()
    assert sorted((r.file_path, r.line_number, r.title) for r in rows) == [
        ("hit.py", 3, "Reflected XSS in HTML response"),
        ("long.py", 3, "Reflected XSS in HTML response"),
        ("nested.py", 4, "Silent exception suppression"),
        ("plain.py", 3, "Silent exception suppression"),
        ("short.py", 2, "Silent exception suppression"),
        ("two.py", 3, "Silent exception suppression"),
    ]


def test_a_scan_needs_a_date(files):
    with pytest.raises(ValueError):
        scan(files(("p", "a.py", "eval(x)")))


def test_refused_files_give_no_findings(files):
    table = files(("p", "a.py", "eval(x)"), ("p", "node_modules/y.js", "el.innerHTML = x"), ("p", "b.exe", "eval(x)"))
    result = scan(table, scan_date=DAY)
    assert [r.file_path for r in result.findings.collect()] == ["a.py"]
    assert result.scan_metadata.first().total_files == 1


def test_equal_names_are_scans_of_their_own(spark):
    one = ("same", [("x.py", "eval(1)")])
    result = scan_payloads(spark.createDataFrame([one, one, ("bad", [("../x.py", "x")]), (" ", [("x.py", "x")])], schema.PAYLOAD),
                           scan_date=DAY)
    reports = result.reports.collect()
    assert [r.project_name for r in reports] == ["same", "same"] and len({r.scan_id for r in reports}) == 2
    assert result.findings.count() == 2
    assert sorted((r.project_name, r.reason) for r in result.refusals.collect()) == [
        ("", "project name missing"), ("bad", "unsafe path")]


def test_a_status_belongs_to_one_scan(spark, files):
    table = files(("p", "a.py", "eval(x)"))
    first, second = (scan(table, scan_date=d).findings.first() for d in ("2024-01-01", "2024-02-01"))
    assert first.finding_id != second.finding_id and first.fingerprint == second.fingerprint


def test_all_given_replies_are_merged(files):
    from faultline.plans.scan import scan_findings

    table = files(("p", "a.py", "\n\n".join("eval(x)" for _ in range(40))))
    ids = scan_findings(table).select("finding_id")
    reply = ids.selectExpr("finding_id", """'{"explanation": "e", "impact": "i", "attack_path": ["a"], "recommendation": "r",
        "example_fix": "f", "reasoning_summary": "s", "confidence": 50}' AS reply""")
    assert scan_findings(table, replies=reply).filter("reply_usable").count() == 40
    assert scan_findings(table, replies=reply, explain_limit=25).filter("reply_usable").count() == 25
