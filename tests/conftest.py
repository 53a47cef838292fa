from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from faultline.session import local_session

    session = local_session("*", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Builds a files table from ``(project, path, text)`` rows."""
    from faultline import schema

    return lambda *rows: spark.createDataFrame([tuple(r) for r in rows], schema.FILES)


@pytest.fixture(scope="session")
def raw(spark):
    """Builds raw findings from partial dictionaries."""
    from faultline import schema

    names = schema.names(schema.RAW_FINDING)
    base = dict.fromkeys(names) | {
        "project_id": "p", "file_path": "a.py", "line_number": 1, "category": "xss", "severity": "HIGH",
        "confidence": 50, "source_rank": 2, "origin": "", "rule_ord": 0, "match_ord": 0, "title": "t",
        "attack_path": []}

    def build(*rows):
        return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schema.RAW_FINDING)

    return build
