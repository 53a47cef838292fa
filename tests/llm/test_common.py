"""Batches that tasks give back."""

from __future__ import annotations

import pyarrow as pa

from faultline.llm import common, jaccard


class Frame:
    """A frame that hands out the function it is mapped by."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, function, schema):
        return function


def test_large_batches_are_given_back_in_small_ones(spark):
    texts = pa.record_batch({"text": ["x" * (1 + i % 50) for i in range(200_000)] + ["y" * (3 << 20), None, ""], "n": range(200_003)})
    made = [*common.arrow_map(Frame(spark), lambda batch: iter((batch, batch.slice(0, 0), batch.slice(7, 5))), "text string, n long")([texts])]
    assert pa.Table.from_batches(made).equals(pa.Table.from_batches([texts, texts.slice(7, 5)]))
    assert sorted(b.nbytes for b in made)[-2] <= 2 * common.GIVEN_BACK and len(made) < 50


def test_parts_of_a_partition_are_given_back_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "GIVEN_BACK", 64)
    texts = [" ".join(f"w{(i // 2) * 7 + j}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in jaccard.linked_components(docs).collect()}
    assert found == {(i, i // 2 * 2) for i in range(40)}
