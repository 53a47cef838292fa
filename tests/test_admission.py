"""Admission of files, archives and submissions; paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import paths
from faultline.operators import admission
from faultline.operators.ordered import ordinals, positions, running_totals

ENTRY = "project_id string, entry_ord int, entry_path string, is_dir boolean, size long"


def test_allowed_files(files):
    names = ["a.py", "A.PY", ".py", ".env", "x.env", "Dockerfile", "my.dockerfile", "a.bin", "b.csproj", "*.csproj",
             "build/a.py", "a/venv/b.js", "x.egg-info/a.py", "*.egg-info/a.py", "a/.github", "noext", "a.tar.gz", "x/build"]
    table = admission.admit_files(files(*[("p", n, "") for n in names]))
    assert {r.file_path for r in table.collect()} == {
        "a.py", "A.PY", ".env", "x.env", "Dockerfile", "my.dockerfile", "*.csproj", "x.egg-info/a.py", "a/.github"}


def test_archives(spark):
    rows = [
        ("ok", 0, "w/", True, 0), ("ok", 1, "w/a.py", False, 10), ("ok", 2, "w/big.py", False, 6_000_000),
        ("ok", 3, "w/node_modules/x.js", False, 1), ("ok", 4, "w/../dir/", True, 1),
        ("climb", 0, "a.py", False, 1), ("climb", 1, "a/../../b", False, 1),
        ("drive", 0, "C:\\x.py", False, 1), ("root", 0, "/x.py", False, 1),
        ("none", 0, "a.bin", False, 1),
        ("bytes", 0, "a.py", False, 60), ("bytes", 1, "b.py", False, 60), ("bytes", 2, "../x", False, 1),
        ("count", 0, "a.py", False, 1), ("count", 1, "b.py", False, 1), ("count", 2, "c.py", False, 1),
        ("early", 0, "../x", False, 1), ("early", 1, "b.py", False, 200),
    ]
    result = admission.admit_archives(spark.createDataFrame(rows, ENTRY), max_total_bytes=100, max_files=2)
    assert [(r.project_id, r.entry_path) for r in result.admitted.collect()] == [("ok", "w/a.py")]
    assert {r.project_id: (r.reason, r.entry_ord) for r in result.rejected.collect()} == {
        "climb": ("unsafe path", 1), "drive": ("unsafe path", 0), "root": ("unsafe path", 0),
        "none": ("no source files", None), "bytes": ("too many bytes", 1), "count": ("too many files", 2),
        "early": ("unsafe path", 0)}


def test_project_roots(files):
    table = files(("one", "w/a.py", ""), ("one", "w/b/c.py", ""), ("two", "w/a.py", ""), ("two", "v/a.py", ""),
                  ("flat", "w/a.py", ""), ("flat", "a.py", ""), ("dot", "./w//a.py", ""))
    assert {r.project_id: r.root for r in admission.project_roots(table).collect()} == {
        "one": "w", "two": None, "flat": None, "dot": "w"}


def test_payloads(spark):
    rows = [
        (" good ", [("/w/a.py", "x"), ("w\\b.js", "y"), ("w/blank.py", " \n\u00a0"), ("w/a.py", "again"), ("w/x.bin", "b")]),
        ("unsafe", [("a/../b.py", "x")]), ("unsafe blocked", [("node_modules/./x.js", "x")]),
        ("", [("a.py", "x")]), ("empty", []), ("nothing", None), ("large", [("a.py", "x" * 50)])]
    judged = admission.judged_payloads(spark.createDataFrame(rows, schema.PAYLOAD), max_bytes=40)
    assert {r.project_name: r.reason for r in judged.collect()} == {
        "good": None, "unsafe": "unsafe path", "unsafe blocked": "unsafe path", "": "project name missing",
        "empty": "no files given", "nothing": "no files given", "large": "upload too large"}
    files = admission.payload_files(judged).collect()
    assert sorted((r.project_id, r.file_path, r.content) for r in files) == [
        ("good", "a.py", "again"), ("good", "b.js", "y")]


def test_paths(spark):
    mark = paths.WORK_MARKER
    cases = {
        ("/r/x/a.py", "/r"): "x/a.py", ("/rx/a.py", "/r"): "a.py",
        (f"C:\\t\\{mark}\\id\\project\\b\\a.py", None): "b/a.py", (f"/t/{mark}/id/src/a.py", None): "src/a.py",
        (f"/t/{mark}/id", None): "id", ("/q/a.py", None): "a.py", (f"/t/{mark}/id/", None): ""}
    table = spark.createDataFrame([(*k, v) for k, v in cases.items()], "p string, r string, want string")
    for row in table.select("p", "want", paths.relative_path(F.col("p"), F.col("r")).alias("got")).collect():
        assert row.got == row.want, row
    shown = spark.createDataFrame([("",), (None,), (f"/t/{mark}/0f-1/a/b.py",), ("a\\b.py",)], "p string")
    assert [r[0] for r in shown.select(paths.graph_path(F.col("p"))).collect()] == ["unknown", "unknown", "a/b.py", "a/b.py"]


def test_running_totals_equal_plain_sums(spark):
    rows = [("hot" if i % 3 else "cold", i, i * 7 % 11) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, o int, v long")
    got = {(r.k, r.o): r.total for r in running_totals(table, "k", "o", {"total": F.col("v")}, 37).collect()}
    sums: dict = {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[k, o] == sums[k]


def test_ordinals_equal_plain_ones(spark):
    rows = [("hot", f"src/{i * 7919 % 1000:04d}.py", i) for i in range(1000)] + [("cold", f"{i}", i) for i in range(9)]
    rows += [(None, f"{i}", i) for i in range(5)]
    table = spark.createDataFrame(rows, "k string, path string, position int").repartition(7)
    got = ordinals(table, ["k"], "path", "n").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"k", "path", "position", "n"}
    for key in ("hot", "cold", None):
        found = sorted((r.n, r.path) for r in got if r.k == key)
        assert found == list(enumerate(sorted(p for k, p, _ in rows if k == key)))


def test_ordinals_by_collation(spark):
    names = ["b", "A", "a", "B", "é", "f", "E", "_x", "Z", "10", "9"]
    table = spark.createDataFrame([("p", n) for n in names], "k string, path string").repartition(5)
    plain = [r.path for r in sorted(ordinals(table, ["k"], "path", "n").collect(), key=lambda r: r.n)]
    assert plain == sorted(names)
    read = [r.path for r in sorted(ordinals(table, ["k"], "path", "n", "UNICODE").collect(), key=lambda r: r.n)]
    assert read == ["_x", "10", "9", "a", "A", "b", "B", "E", "é", "f", "Z"]


def test_weighted_positions(spark):
    rows = [(i * 37 % 101, i % 4) for i in range(101)]
    got = positions(spark.createDataFrame(rows, "v long, row_at int").repartition(6), [F.col("v").desc()], "p", F.col("row_at")).collect()
    before = 0
    for r in sorted(got, key=lambda r: -r.v):
        assert r.p == before
        before += r.row_at
    assert positions(spark.createDataFrame([], "v long"), [F.col("v")], "p").collect() == []
