"""Counts and verdicts against DuckDB, whole plans without Python."""

from __future__ import annotations

import duckdb

from faultline.llm import quality

from .conftest import ODD


def test_verdicts_equal_sql(docs):
    clean = [f"this is text number {i} with some ordinary words in every line of it and nothing that repeats\nline {i} too" for i in range(60)]
    junk = ["bad ### $$$ %%% &&& ||| words ### $$$ %%% here and there ### $$$ in all of the text ### so it goes on and on"] * 2
    shout = ["THIS TEXT IS LOUD AND KEEPS ON SHOUTING FROM ITS FIRST WORD TO THE VERY LAST ONE WITHOUT A SINGLE PAUSE FOR BREATH"]
    loop = ["one two three four five six seven eight nine ten " * 8]
    frame = docs(*ODD, *clean, *junk, *shout, *loop)
    given = frame.toPandas()
    con = duckdb.connect()
    con.register("given", given)
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    want = con.sql(quality.sql()).df()
    got = quality.quality(frame).toPandas()[list(want.columns)]
    key = ["doc_id"]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
    kept = set(got[got.kept].doc_id)
    assert kept >= set(range(len(ODD), len(ODD) + 60)) and not kept & set(range(len(ODD) + 60, len(given)))


def test_null_groups_and_empty_tables(spark, docs):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, None, None), (1, text, None, None), (2, text, "en", None), (3, None, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id, r.kept) for r in quality.quality(frame).collect()) == [(1, True), (1, True), (2, True), (3, False)]
    assert quality.quality(docs()).count() == 0


def test_no_python_in_the_plan(docs):
    plan = quality.quality(docs("a b c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
