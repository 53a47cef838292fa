"""Nearest vectors against the exact search, and vectors that take no part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import neighbours


def exact(rows, k):
    usable = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in [i for i in usable if i % 10 == 0]:
        scored = [(-(usable[q] @ v) / np.linalg.norm(usable[q]) / np.linalg.norm(v), i)
                  for i, v in usable.items() if i != q and len(v) == len(usable[q])]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(neighbours, "STEP", 40)
    random = np.random.default_rng(3)
    centres = random.standard_normal((10, 24))
    rows = [(i, [float(x) for x in centres[i % 10] + 0.5 * random.standard_normal(24)]) for i in range(600)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    want = exact(rows, 5)
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.99


def test_bounds_hold():
    random = np.random.default_rng(5)
    v = random.standard_normal((400, 70))
    v /= np.linalg.norm(v, axis=1)[:, None]
    turn = neighbours.rotation(70, 1)
    estimate, error = neighbours.estimates(v[:40], *neighbours.encode(v, turn), turn)
    assert (np.abs(estimate - v[:40] @ v.T) <= error + 1e-9).mean() > 0.999


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 0.0]), (11, [3.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = neighbours.nearest(frame, F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 11), (0, 3, 2)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_repeated_rows_and_extreme_sizes(spark):
    rows = [(0, [1.0, 0.1]), (0, [1.0, 0.1]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1e200, 1e200]), (3, [1e-200, 3e-200]), (4, [5e-324, 0.0]), (5, [-1.7e308, 1e308])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 4), (3, 2), (4, 3), (5, 5)]
    assert all(abs(r.score) <= 1.0000001 for r in got)
