"""Deduplication, scores, snippets, explanations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import severity, versions
from faultline.functions.text import decode_text, mask, strip, title_case
from faultline.operators import explain, findings, score


def test_first_per_line_keeps_producer_order(raw):
    rows = findings.first_per_line(raw(
        {"source_rank": 2, "rule_ord": 4, "title": "later"},
        {"source_rank": 2, "rule_ord": 1, "title": "earlier", "severity": "LOW"},
        {"source_rank": 0, "line_number": None, "title": "tool"},
        {"source_rank": 1, "line_number": None, "title": "other tool", "severity": "CRITICAL"},
        {"source_rank": 2, "category": "XSS", "title": "other spelling"})).collect()
    assert sorted(r.title for r in rows) == ["earlier", "other spelling", "tool"]


def test_best_per_place(raw):
    rows = findings.best_per_place(raw(
        {"line_number": 6, "severity": "LOW", "title": "mild"},
        {"line_number": 7, "severity": "HIGH", "confidence": 40, "title": "worst"},
        {"line_number": 8, "severity": "LOW", "title": "next pair"},
        {"line_number": 20, "confidence": 60, "title": "unsure"},
        {"line_number": 21, "confidence": 61, "title": "surer"},
        {"line_number": 30, "category": "B605", "title": "tool name", "source_rank": 1},
        {"line_number": 30, "category": "command-injection", "title": "own name"},
        {"line_number": 40, "severity": "STRANGE", "title": "unknown"},
        {"line_number": 41, "severity": "LOW", "title": "known"},
        {"line_number": None, "title": "none 1"}, {"line_number": None, "title": "none 2", "rule_ord": -1},
    )).collect()
    assert sorted(r.title for r in rows) == ["known", "next pair", "none 2", "surer", "tool name", "worst"]
    assert next(r for r in rows if r.title == "tool name").category == "B605"


def test_deduplication_is_idempotent_and_order_free(raw):
    rng = random.Random(3)
    rows = [{"line_number": rng.choice([None, 1, 2, 3, 4]), "category": rng.choice(["xss", "XSS", "B602", "a"]),
             "severity": rng.choice(["LOW", "HIGH", "CRITICAL"]), "confidence": rng.randint(1, 99),
             "rule_ord": i, "title": f"t{i}"} for i in range(200)]
    once = findings.best_per_place(raw(*rows))
    shuffled = findings.best_per_place(raw(*rng.sample(rows, len(rows))))
    again = findings.best_per_place(once)
    titles = sorted(r.title for r in once.collect())
    assert titles == sorted(r.title for r in shuffled.collect()) == sorted(r.title for r in again.collect())


@pytest.mark.parametrize("rows, expected", [
    ([], (100, "Excellent", 0)),
    ([("LOW", 100, "x")], (89, "Good", 10000)),
    ([("MEDIUM", 10, "x")], (74, "Needs Attention", 9000)),
    ([("HIGH", 150, "x")], (49, "High Risk", 70000)),
    ([("CRITICAL", 100, "insecure-dependency")], (24, "Critical Risk", 132000)),
    ([("CRITICAL", 70, "hardcoded-secrets")], (24, "Critical Risk", 96600)),
    ([("strange", 50, "x")], (74, "Needs Attention", 15000)),
    ([("LOW", 50, "x")] * 25, (88, "Good", 125000)),   # 87.5 rounds to the even 88
    ([("LOW", 50, "x")] * 27, (86, "Good", 135000)),   # 86.5 rounds to the even 86
    ([("LOW", 100, "x")] * 150, (0, "Critical Risk", 1500000)),
])
def test_score(spark, rows, expected):
    table = spark.createDataFrame([("p", *r) for r in rows], "project_id string, severity string, confidence int, category string")
    projects = spark.createDataFrame([("p",)], "project_id string")
    row = score.scores(table, projects).first()
    assert (row.overall_score, row.security_posture, row.penalty_units) == expected


def test_score_never_rises_with_more_findings(spark):
    rng = random.Random(5)
    rows, last = [], 100
    table = []
    for n in range(15):
        rows.append((rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"]), rng.randint(0, 120), "c"))
        table += [(f"p{n:02d}", *r) for r in rows]
    df = spark.createDataFrame(table, "project_id string, severity string, confidence int, category string")
    for row in score.scores(df).orderBy("project_id").collect():
        assert row.overall_score <= last
        last = row.overall_score


def test_snippets_are_filled_from_files(raw, files):
    table = raw({"line_number": 2}, {"line_number": 9}, {"line_number": None}, {"line_number": 1, "code_snippet": "kept"})
    rows = findings.fill_snippets(table, files(("p", "a.py", "one\n  two  \nthree"))).collect()
    assert sorted((r.line_number or 0, r.code_snippet or "-") for r in rows) == [
        (0, "-"), (1, "kept"), (2, "two"), (9, "-")]


def test_categories(spark):
    given = ["B605", "b605", "HARDCODED_SECRETS", "sql_injection", "Xss-Thing"]
    table = spark.createDataFrame([(g,) for g in given], "c string")
    shown = [r[0] for r in table.select(severity.canonical_category(F.col("c"))).collect()]
    assert shown == ["command-injection", "command-injection", "hardcoded-secrets", "sql-injection", "xss-thing"]


@pytest.mark.parametrize("version, bound, below", [
    ("2.19.9", "2.20.0", True), ("2.20", "2.20.0", False), ("2.20.0.0", "2.20", False), ("5", "5.4", True),
    ("2.*", "5.4", False), ("1.0rc1", "5.4", False), ("v1.2", "5.4", True), ("latest", "5.4", False),
    ("", "5.4", False), (None, "5.4", False), ("1.0.dev1", "5.4", False), ("1.0.post1", "1.1", True),
    ("0.12.3.post1", "0.12.3", False), ("1.0-1", "1.1", True), ("1.0+local.2", "1.1", True),
    ("4.17.3-beta", "4.17.3", False), ("10.0", "9.0.0", False), ("20230101120000", "9", False),
    (" 1.0 ", "1.1", True), ("1.x", "9", False),
])
def test_versions(spark, version, bound, below):
    table = spark.createDataFrame([(version, bound)], "v string, b string")
    assert table.select(versions.is_below(F.col("v"), F.col("b"))).first()[0] is below


def test_manifests(files):
    from faultline.operators.dependencies import detected_frameworks, framework_labels
    from faultline.sources import manifests

    table = files(
        ("p", "requirements.txt", "# c\n-r x\n\n Flask>=0.12.2 \nflask[x]==1\n@bad\nname==2.*\nreq~=1.0rc1"),
        ("p", "a/package.json", '{"dependencies": {"React": "~1.2", "n": 3}, "devDependencies": {"React": ""}}'),
        ("p", "broken/package.json", '{"dependencies": {"a": "1"}, "dev'),
        ("p", "list/package.json", "[1]"),
        ("p", "node_modules/x/package.json", '{"dependencies": {"vue": "1"}}'),
        ("q", "pyproject.toml", "uses FastAPI"), ("q", "package.json", '{"devDependencies": {"next": "1"}}'))
    rows = manifests.declared_packages(table).collect()
    assert sorted((r.manifest_path, r.position, r.package, r.version) for r in rows) == [
        ("a/package.json", 0, "react", "1.2"), ("a/package.json", 1, "n", "3"), ("a/package.json", 2, "react", None),
        ("package.json", 0, "next", "1"), ("requirements.txt", 3, "flask", "0.12.2"), ("requirements.txt", 4, "flask", None),
        ("requirements.txt", 6, "name", "2."), ("requirements.txt", 7, "req", "1.0rc1")]
    assert {r.project_id: r.detected_frameworks for r in detected_frameworks(table).collect()} == {
        "p": ["Flask"], "q": ["FastAPI", "Next.js"]}
    assert framework_labels(table).count() == 3


def test_texts(spark):
    table = spark.createDataFrame([(b"a\xff b\r\nc\rd\xef\xbf\xbd",), ("\u00e9\ufffd".encode(),)], "b binary")
    assert [r[0] for r in table.select(decode_text(F.col("b"))).collect()] == ["a b\nc\nd", "\u00e9\ufffd"]
    one = spark.range(1).select(
        title_case(F.lit("use of MD5-hash x2y")), mask(F.lit("12345678")), mask(F.lit("123456789")),
        strip(F.lit("\t\u2003 x \u00a0\n"))).first()
    assert tuple(one) == ("Use Of Md5-Hash X2Y", "********", "1234*6789", "x")


def test_replies(spark):
    good = ('{"explanation": "e", "impact": "", "attack_path": ["a", 1], "recommendation": "r",'
            ' "example_fix": "f", "reasoning_summary": "s", "confidence": 87.9}')
    replies = {
        "good": good, "fenced": f"```json\n{good}\n```", "tail": good + "}", "two": good + good, "note": good + "] x",
        "text": "no json", "string": good.replace("87.9", '"87"'), "flag": good.replace("87.9", "true"),
        "path": good.replace('["a", 1]', '"a"'), "missing": good.replace('"impact": "", ', ""), "list": f"[{good}]"}
    given = spark.createDataFrame(list(replies.items()), "finding_id string, reply string")
    table = spark.createDataFrame(
        [("p", k, "", "old", "old", None, ["x"]) for k in [*replies, "none"]],
        "project_id string, finding_id string, description string, impact string, recommendation string, "
        "example_fix string, attack_path array<string>")
    rows = {r.finding_id: r for r in explain.merge_replies(table, given).collect()}
    assert {k for k, r in rows.items() if r.reply_usable} == {"good", "fenced", "flag"}
    good_row = rows["fenced"]
    assert (good_row.description, good_row.impact, good_row.recommendation, good_row.example_fix,
            good_row.attack_path, good_row.ai_confidence) == ("e", "old", "r", "f", ["a", "1"], 87)
    assert (rows["none"].impact, rows["none"].attack_path, rows["flag"].ai_confidence) == ("old", ["x"], 1)


def test_top_findings_and_requests(raw):
    rows = [{"project_id": f"p{i % 2}", "line_number": i, "severity": "LOW" if i % 3 else "CRITICAL",
             "code_snippet": f"s{i}"} for i in range(120)]
    table = findings.with_finding_id(raw(*rows))
    top = explain.top_findings(table).collect()
    assert len(top) == 50
    assert sum(r.severity == "CRITICAL" for r in top) == 40
    request = explain.explanation_requests(table, limit=1).first().request
    assert '"additional_code_context":"s' in request and '"description":null' in request


@pytest.mark.parametrize(("given", "canonical"), [
    ("B605", "command-injection"), ("B602", "command-injection"), ("B608", "sql-injection"), ("B324", "weak-cryptography"),
    ("B105", "hardcoded-secrets"), ("B110", "security-misconfiguration"), ("B310", "path-traversal"),
    ("B501", "sensitive-data-exposure"), ("B506", "insecure-deserialization"), ("SQL_INJECTION", "sql-injection"),
    ("Other-Thing", "other-thing")])
def test_aliases_by_hand(spark, given, canonical):
    from faultline.functions.severity import canonical_category

    row = spark.createDataFrame([(given,)], "c string").select(canonical_category(F.col("c")).alias("x")).first()
    assert row.x == canonical


@pytest.mark.parametrize(("width", "fits"), [(64, True), (65, False)])
def test_width_of_a_category(raw, width, fits):
    from faultline.operators.reports import within_limits

    assert within_limits(raw({"category": "c" * width, "source_tool": "t"})).first().fits is fits


VERSIONS = ("1.0", "1", "1.0.0", "v1.2", "1.2.post1", "1.2-3", "1.2.dev4", "1.2a1", "1.2b2.dev1", "1.2rc1", "1.2c1.post2", "1.2+local.1", "1.2+local.a", "1.10",
            "0.9", "2!0.1", "1!1.2", "2.0", "2.0.0.1", "1.2.3.4", "latest", "1.x", "", "1.2.post", "1.2_alpha", "01.02", "1.2.0+7", "3.2.18", "3.2.17.post9")
SPECIFIERS = ("<1.2", "<=1.2", ">1.2", ">=1.2", "==1.2", "!=1.2", "~=1.2", "~=1.2.0", "==1.*", "!=1.2.*", "==1.2+local.1", "===1.2", ">=1.0,<2", ">=1,!=1.2,<1.3",
              ">=1.2a1", "==1.2rc1", "<=1.2b2", "~=1.2rc1", "==2!0.*", ">=1!0", "", "~=1", "nonsense", ">=1,bad", "<3.2.18", ">1.2.post1", "!=1.2+local.a", "==1.0.*")


def test_specifiers_are_those_of_the_packaging_rules(spark):
    packaging = pytest.importorskip("packaging.specifiers")
    from packaging.version import InvalidVersion, Version

    def expected(version, specifier):
        try:
            wanted = packaging.SpecifierSet(specifier)
            # Pre-releases are left out unless a clause names one, whatever the version of that library makes of it.
            return wanted.contains(Version(version), prereleases=bool(wanted.prereleases))
        except (InvalidVersion, packaging.InvalidSpecifier):
            return False

    from faultline.functions import versions

    table = spark.createDataFrame([(v, s) for v in VERSIONS for s in SPECIFIERS], "v string, s string")
    got = table.select("v", "s", versions.satisfies(versions.version_key(F.col("v")), versions.clauses(F.col("s"))).alias("x")).collect()
    assert {(r.v, r.s): r.x for r in got} == {(v, s): expected(v, s) for v in VERSIONS for s in SPECIFIERS}


def test_version_order_is_total(spark):
    ordered = ["0.9", "1.0.dev1", "1.0a1.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1.dev2", "1.0rc1", "1.0", "1.0+a", "1.0+a.b", "1.0+2", "1.0.post1.dev3", "1.0.post1",
               "1.0.1", "1.2", "1.10", "1!0.1"]
    from faultline.functions import versions

    table = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r.v for r in table.orderBy(versions.order_of(versions.version_key(F.col("v")))).collect()] == ordered


def test_advisories_with_specifiers(spark):
    from faultline.operators import dependencies

    packages = spark.createDataFrame([("p", "m", i, "lib", v) for i, v in enumerate(("1.4", "1.5", "1.9", "2.0", "2.0rc1", "x", None))],
                                     "project_id string, manifest_path string, position int, package string, version string")
    known = spark.createDataFrame([("lib", None, ">=1.5,<2,!=1.9", "A"), ("lib", "1.5", None, "B"), ("lib", None, None, "C"), ("lib", "1", "oops", "D")],
                                  "package string, bound string, specifier string, advisory_id string")
    got = {(r.version, r.advisory_id) for r in dependencies.affected_packages(packages, known).collect()}
    assert got == {("1.5", "A"), ("1.4", "B")}


def test_parts_of_a_version_are_found_once(spark):
    from faultline.functions import versions

    fulfilled = versions.satisfies(versions.version_key(F.col("v")), versions.clauses(F.col("s")))
    # One test and one pass for the version, and the same for the clauses; every mention would be evaluated for every row.
    assert str(fulfilled).count("(alpha|a|beta|b|preview|pre|c|rc)") == 4
