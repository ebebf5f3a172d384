"""Vector search by cells against plain products, with and without clusters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.accumulators import AccumulatorParam

from supportlake.operators import vectors


def plain(queries, rows, k, threshold):
    out = {}
    for q, x in queries:
        if x is None or q is None:
            continue
        s = sorted((-round(float(np.dot(x, v)), 6), c) for c, v in rows if v is not None and c is not None and len(v) == len(x))[:k]
        out |= {(q, r + 1): c for r, (m, c) in enumerate(s) if -m >= threshold}
    return out


@pytest.mark.parametrize(("tight", "alone"), [(True, 0), (False, 0), (False, 5_000)])
def test_search_equals_plain_products(spark, tight, alone, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS", 60)
    monkeypatch.setattr(vectors, "PLAIN", alone)
    monkeypatch.setattr(vectors, "QUESTIONS", 9)
    rnd = np.random.RandomState(1)
    base = rnd.randn(12, 8) * 3
    point = lambda: (base[rnd.randint(12)] + 0.05 * rnd.randn(8)) if tight else rnd.randn(8)
    rows = [(i, [float(a) for a in point()]) for i in range(1500)]
    rows += [(2000, None), (2001, [1.0, 2.0]), (2002, [2.0, 1.0]), (2003, [0.0] * 8), (2004, rows[0][1]), (2005, rows[0][1]), (None, [9.0] * 8)]
    asked = [(i, [float(a) for a in point()]) for i in range(20)] + [(50, None), (51, [1.0, 1.0]), (52, [1.0] * 3), (53, rows[0][1]), (None, [1.0, 1.0])]
    v, q = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, qvec array<double>")
    counted = spark.sparkContext.accumulator(0)
    got = vectors.dense_topk(q, v, 7, 0.1, counted).collect()
    assert {(r.query_id, r["rank"]): r.chunk_id for r in got} == plain(asked, rows, 7, 0.1)
    assert counted.value <= (0.45 if tight else 1.01) * 22 * 1506
    assert vectors.dense_topk(q, v.filter("chunk_id < 0"), 7).count() == vectors.dense_topk(q.filter("query_id < 0"), v, 7).count() == 0


def test_tasks_hold_small_pieces(spark, monkeypatch):
    """A task's score matrix and list of visits stay bounded, however many questions meet a cell."""
    monkeypatch.setattr(vectors, "PLAIN", 0)
    monkeypatch.setattr(vectors, "SCORES", 1_000, raising=False)
    rnd = np.random.RandomState(2)
    rows = [(i, [float(a) for a in rnd.randn(6)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    most = spark.sparkContext.accumulator(0, type("Most", (AccumulatorParam,), {"zero": lambda self, v: 0, "addInPlace": lambda self, a, b: max(a, b)})())
    asked = frame.filter("chunk_id < 300").selectExpr("chunk_id AS query_id", "vector AS qvec")
    got = vectors.dense_topk(asked, frame, 3, 0.1, most).collect()
    assert {(r.query_id, r["rank"]): r.chunk_id for r in got} == plain(rows[:300], rows, 3, 0.1) and 0 < most.value <= 1_000
    assert [f.a.tolist() for f in vectors._slices([pd.DataFrame({"a": range(5)}), pd.DataFrame({"a": []})], 2)] == [[0, 1], [2, 3], [4]]
