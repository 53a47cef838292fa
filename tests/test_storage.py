"""Sources, stored tables and streams."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators import admission
from faultline.plans import views
from faultline.plans.scan import scan
from faultline.sources import payloads, reports, tables, trees
from faultline.streaming import arrivals


def test_read_trees(spark, tmp_path):
    texts = {
        "p/a/b.py": b"x = 1\r\ny\xff\rz", "p/A.PY": b"1", "p/Dockerfile": b"FROM x", "p/a.bin": b"no",
        "p/node_modules/x.js": b"no", "p/big.py": b"x" * 200, "q/c.ts": b"let a", "top.py": b"no project"}
    for name, data in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = trees.read_trees(spark, str(tmp_path), max_file_bytes=100).collect()
    assert {(r.project_id, r.file_path): r.content for r in rows} == {
        ("p", "a/b.py"): "x = 1\ny\nz", ("p", "A.PY"): "1", ("p", "Dockerfile"): "FROM x", ("q", "c.ts"): "let a",
        (".", "top.py"): "no project"}
    assert "big.py" in {r.file_path for r in trees.read_trees(spark, str(tmp_path)).collect()}  # no size is refused unasked


def test_read_payloads_and_reports(spark, tmp_path):
    lines = [json.dumps({"project_name": "a", "files": [{"filename": "x.py", "source_code": "eval(1)"}]}), "{broken"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    judged = admission.judged_payloads(payloads.read_payloads(spark, str(tmp_path / "in.json")))
    assert sorted((r.project_name or "", r.reason) for r in judged.collect()) == [
        ("", "project name missing"), ("a", None)]

    folder = tmp_path / "reports" / "proj"
    folder.mkdir(parents=True)
    (folder / "semgrep.json").write_text(json.dumps({"results": [
        {"check_id": "a.b.sql-injection_x", "path": "src/a.py", "start": {"line": 4},
         "extra": {"severity": "ERROR", "message": "m", "lines": "l", "metadata": {"category": "c"}}}, {}]}, indent=1))
    rows = reports.semgrep_findings(reports.read_reports(spark, str(tmp_path / "reports"))).collect()
    assert [(r.project_id, r.title, r.severity, r.confidence, r.file_path, r.line_number, r.category) for r in rows] == [
        ("proj", "Sql Injection_X", "HIGH", 80, "a.py", 4, "c"),
        ("proj", "Semgrep Finding", "MEDIUM", 80, "unknown", None, "security-misconfiguration")]


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{os.urandom(4).hex()}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path / 'tables'}'")
    tables.create_tables(spark, name)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_tables_round_trip(spark, files, database):
    table = files(("p", "a.py", "eval(x)\npassword = 'abcdefgh'"), ("q", "b.py", "x = 1"))
    first = scan(table, scan_date="2024-01-02 03:04:05", duration=1.5, keep=True)
    tables.append_scan(first, database)
    tables.append_scan(first, database)  # a repeat adds nothing
    tables.append_scan(scan(table, scan_date="2024-01-03 03:04:05"), database)
    tables.create_tables(spark, database)  # existing tables stay
    stored = views.stored(spark, database)
    assert (stored.reports.count(), stored.findings.count(), stored.scan_metadata.count()) == (4, 4, 4)
    assert views.stored(spark, database, ("2024-01-03", "2024-01-03")).reports.count() == 2

    listed = views.list_reports(stored).collect()
    assert [str(r.scan_date)[:10] for r in listed] == ["2024-01-03"] * 2 + ["2024-01-02"] * 2
    scan_id = next(r.scan_id for r in listed if r.project_name == "p")
    shown = views.get_findings(stored, scan_id).collect()
    assert [r.status for r in shown] == ["OPEN", "OPEN"] and len(views.get_report(stored, scan_id).collect()) == 2
    assert views.get_findings(stored, "no such scan").isEmpty()

    changed = shown[0].finding_id
    changes = spark.createDataFrame(
        [(changed, "FIXED", 1, 1), (changed, "IGNORED", 2, 2), (changed, "NONSENSE", 3, 3)],
        "finding_id string, status string, at int, change_id bigint",
    ).select("finding_id", "status", F.timestamp_seconds("at").alias("changed_at"), "change_id")
    tables.append_status_changes(changes, database)
    after = {r.finding_id: r.status for r in views.get_findings(stored, scan_id).collect()}
    assert after[changed] == "IGNORED" and sorted(after.values()) == ["IGNORED", "OPEN"]
    assert {r.project_name for r in views.latest_detail(stored).collect()} <= {"p", "q"}
    assert views.latest_dashboard(stored).columns and views.latest_graph(stored).nodes.columns


def test_submissions_stream(spark, tmp_path, database):
    inbox, progress = tmp_path / "inbox", str(tmp_path / "progress")
    inbox.mkdir()

    def land(name, *submissions):
        (inbox / name).write_text("\n".join(json.dumps(s) for s in submissions))

    def run():
        query = arrivals.scan_arrivals(spark, str(inbox), progress, database, once=True)
        query.awaitTermination(120)
        assert query.exception() is None

    bad = {"project_name": "bad", "files": [{"filename": "../x.py", "source_code": "eval(1)"}]}
    one = {"project_name": " a ", "files": [{"filename": "w/x.py", "source_code": "eval(1)"}]}
    land("1.json", one, bad, one)
    run()
    land("2.json", one, {"project_name": "b", "files": [{"filename": "y.py", "source_code": "x = 1"}]})
    run()
    stored = views.stored(spark, database)
    assert sorted((r.project_name, r.overall_score) for r in stored.reports.collect()) == [
        ("a", 24), ("a", 24), ("a", 24), ("b", 100)]
    refused = tables.read_table(spark, "refusals", database)
    assert [(r.project_name, r.reason) for r in refused.collect()] == [("bad", "unsafe path")]
    assert stored.findings.count() == 3 and {r.file_path for r in stored.findings.collect()} == {"x.py"}

    # a batch that is run again adds nothing
    arrivals.scan_batch(payloads.read_payloads(spark, str(inbox / "1.json")), database)
    assert stored.reports.count() == 4 and refused.count() == 1


def test_an_append_shows_all_its_tables_or_none(spark, files, database, monkeypatch):
    result = scan(files(("p", "a.py", "eval(x)"), ("q", "b.py", "x = 1")), scan_date="2024-01-02 03:04:05", keep=True)
    insert = tables._insert
    for broken in ("scan_metadata", "reports", "scan_index", "commits"):
        def stop(rows, table, broken=broken):
            if table.endswith(broken):
                raise OSError("lost")
            insert(rows, table)

        monkeypatch.setattr(tables, "_insert", stop)
        with pytest.raises(OSError, match="lost"):
            tables.append_scan(result, database)
        stored = views.stored(spark, database)
        assert [t.count() for t in (stored.reports, stored.findings, stored.scan_metadata)] == [0, 0, 0]
    assert spark.read.table(f"{database}.findings").count() == 4  # what the broken appends left
    monkeypatch.setattr(tables, "_insert", insert)
    for _ in range(2):
        tables.append_scan(result, database)
        stored = views.stored(spark, database)
        assert [t.count() for t in (stored.reports, stored.findings, stored.scan_metadata)] == [2, 1, 2]
    assert spark.read.table(f"{database}.commits").count() == 1


def test_a_report_is_found_by_the_index(spark, files, database):
    table = files(("p", "a.py", "eval(x)"))
    for day in range(1, 6):
        tables.append_scan(scan(table, scan_date=f"2024-01-0{day} 00:00:00", keep=True), database)
    scan_id = spark.read.table(f"{database}.reports").filter("scan_day = DATE'2024-01-03'").first().scan_id
    found = views.get_findings(views.stored(spark, database), scan_id)
    assert [r.scan_id for r in found.collect()] == [scan_id]
    part = tables.index_part(F.lit(scan_id))
    assert tables.scan_places(spark, scan_id, database).count() == 1
    # Only one part of the index is listed, and only the day it names of the large tables.
    plan = tables.scan_places(spark, scan_id, database)._jdf.queryExecution().executedPlan().toString()
    number = spark.range(1).select(part).first()[0]
    assert f"= {number})" in plan.split("PartitionFilters: ")[1].split("]")[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    for name in ("findings", "reports"):
        scanned = next(line for line in plan.split("\n") if f"{database}.{name}[" in line)
        assert "dynamicpruning" in scanned and "scan_day" in scanned, scanned


def test_large_files_of_submissions_are_split_and_equal_ones_stay_apart(spark, tmp_path):
    from faultline.plans.scan import judged_submissions

    one = {"project_name": "a", "files": [{"filename": "w/x.py", "source_code": "eval(1) # " + "x" * 2000}]}
    two = {"project_name": "b", "files": [{"filename": "y.py", "source_code": "x = 1"}]}
    path = tmp_path / "in.json"
    path.write_bytes(b"\r\n".join(json.dumps(s).encode() for s in [*[one] * 60, two, {"project_name": "", "files": []}]) + b"\n\r\n")
    names = set()
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        given = payloads.read_payloads(spark, str(path))
        assert (given.rdd.getNumPartitions() > 4) == (size == "16k")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        rows = judged_submissions(given).select("submission", "project_name", "reason").collect()
        assert len({r.submission for r in rows}) == len(rows) == 62
        assert sorted(r.project_name for r in rows if r.reason is None) == ["a"] * 60 + ["b"]
        names.add(frozenset(r.submission for r in rows))
    assert len(names) == 1  # the same names however the file was split


def test_status_stream(spark, tmp_path, database):
    folder = tmp_path / "changes"
    rows = [("f", "FIXED", 10, 1), ("f", "FIXED", 10, 1), ("f", "OPEN", 20, 2)]
    spark.createDataFrame(rows, "finding_id string, status string, at int, change_id bigint").select(
        "finding_id", "status", F.timestamp_seconds("at").alias("changed_at"), "change_id",
    ).write.parquet(str(folder))
    stream = spark.readStream.schema(schema.STATUS_CHANGES).parquet(str(folder))
    query = arrivals.log_status_changes(stream, str(tmp_path / "progress"), database, once=True)
    query.awaitTermination(120)
    assert query.exception() is None
    log = tables.read_table(spark, "status_changes", database).collect()
    assert sorted((r.status, r.change_id) for r in log) == [("FIXED", 1), ("OPEN", 2)]


def test_status_changes_of_many_days_make_few_files(spark, database, monkeypatch):
    changes = spark.range(600).repartition(12).selectExpr(
        "CAST(id % 50 AS STRING) AS finding_id", "'OPEN' AS status", "timestamp_seconds(id % 50 * 86400) AS changed_at", "id AS change_id")
    days = spark.read.table(f"{database}.status_changes")

    def files():
        return days.select(F.input_file_name()).distinct().count()

    tables.append_status_changes(changes, database)
    days = spark.read.table(f"{database}.status_changes")
    assert days.count() == 600 and files() == 50
    # A day of many rows is written by several tasks; a null date and no rows at all are kept as they are.
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    tables.append_status_changes(changes.withColumn("changed_at", F.lit(None).cast("timestamp")), database)
    tables.append_status_changes(changes.limit(0), database)
    days = spark.read.table(f"{database}.status_changes")
    assert days.count() == 1200 and days.filter("changed_day IS NULL").count() == 600 and 53 <= files() <= 60


def test_roots_of_any_form(spark, tmp_path):
    for name in ("g1/p/a/b.py", "g1/p/top.py", "g2/q/c.py", "g2/loose.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1")

    def found(root):
        return {(r.project_id, r.file_path) for r in trees.read_trees(spark, root).collect()}

    one = {("p", "a/b.py"), ("p", "top.py")}
    here = spark._jvm.java.lang.System.getProperty("user.dir")
    assert found(f"{tmp_path}/g1/") == found(f"file://{tmp_path}/g1") == found(os.path.relpath(tmp_path / "g1", here)) == one
    assert found(f"{tmp_path}/g*") == one | {("q", "c.py"), (".", "loose.py")}
    with pytest.raises(FileNotFoundError):
        trees.read_trees(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="depths"):
        trees.read_trees(spark, f"{tmp_path}/{{g1,g2/q}}")


def test_scans_without_a_date_are_refused(spark, database):
    from faultline.plans.scan import scan_payloads

    given = spark.createDataFrame([("a", [("x.py", "eval(1)")])], "project_name string, files array<struct<filename:string,source_code:string>>")
    with pytest.raises(ValueError, match="date"):
        scan_payloads(given)
    with pytest.raises(ValueError, match="without a date"):
        tables.append_scan(scan_payloads(given.selectExpr("*", "CAST(NULL AS TIMESTAMP) AS landed_at")), database)
    tables.append_scan(scan_payloads(given.selectExpr("*", "TIMESTAMP'2025-01-02 03:04:05' AS scan_date")), database)
    assert [str(r.scan_day) for r in tables.read_table(spark, "reports", database).collect()] == ["2025-01-02"]
