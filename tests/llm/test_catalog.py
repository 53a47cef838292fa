"""Every registered query of this part, over the smallest tables, and the pipeline against plain steps."""

from __future__ import annotations

import glob
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from faultline.llm import catalog, pii

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(table).stem} AS SELECT * FROM '{table}'")
    want = con.sql(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, str(TABLES)).toPandas()[list(want.columns)]
    plain = lambda frame: sorted((tuple(None if x != x else round(x, 9) if isinstance(x, float) else x for x in r)
                                  for r in frame.values.tolist()), key=repr)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted({*catalog.QUERIES} - {*catalog.ORACLES}))
def test_query_answers_for_every_document(spark, name):
    got = catalog.QUERIES[name](spark, str(TABLES))
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(TABLES)).cache()
        texts[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() <= before.count()
    assert not any(kind for t in texts["near_duplicates"].text for *_, kind, f in pii.find(t) if any(f in u for u in texts["personal_data"].text))
    assert set(texts["packing"].doc_id) == set(texts["personal_data"].doc_id)


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(TABLES)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
