"""Operator 12 against brute force in Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import voronoi_knn

BIG = (1 << 63) - 1


def brute(rows, every, k):
    """Answers by place of the query among the rows that take part."""
    sound = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v):
            sound.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for n, (i, q) in enumerate(sound):
        if i is not None and i % every == 0:
            scores = [(-max(-BIG, min(BIG, sum(a * b for a, b in zip(q, c, strict=True)))), BIG if j is None else j) for m, (j, c) in enumerate(sound) if m != n and len(c) == len(q)]
            out += [(i, r + 1, None if j == BIG else j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, every=10, k=5, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts).withColumns({"key": F.lit(1), "asks": F.lit("clash")})
    return sorted((tuple(r) for r in voronoi_knn.nearest(df, every=every, k=k).collect()), key=repr)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.25, -0.5, 0.0, 1.0, 0.0, 2.0]) for i in range(40)]  # ties
    rows += [(10, [1.0] * 6), (10, [1.0] * 6), (20, None), (30, [1.0, None, 2.0]), (40, [float("nan")] * 6), (50, [float("inf")] + [0.0] * 5), (60, []), (61, []), (70, [1.5] * 3), (71, [-1.5] * 3), (72, [0.0] * 3)]
    rows += [(None, [5.0] * 6), (None, [-5.0] * 6), (80, [0.0] * 6), (-90, [-0.001] * 6), (90, [1e308] * 6)]
    assert run(spark, rows) == brute(rows, 10, 5)


def test_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(2)
    scale = [1e-3, 1.0, 1e7, 1e9, 1e12, 1e30, 1e150, 1e300]
    rows = [(i, (rng.standard_normal(4) * scale[i % 8]).tolist()) for i in range(160)]
    assert run(spark, rows, every=3) == brute(rows, 3, 5)


def test_groups_slices_and_blocks(spark, monkeypatch):
    for name, value in (("QUERIES", 7), ("SLICE", 60), ("STEP", 16)):
        monkeypatch.setattr(voronoi_knn, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 4
    rows = [(i, (centres[i % 12] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(900)]
    rows += [(2000 + i, centres[0].tolist()) for i in range(300)]  # a third of the queries in one place
    assert run(spark, rows, every=4) == brute(rows, 4, 5)


def test_clusters_send_rows_to_their_own_groups(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "QUERIES", 8)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((16, 8))
    centres *= 5 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 16] + 0.01 * rng.standard_normal(8)).tolist()) for i in range(1600)]
    kept = voronoi_knn.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=7)
    sent = voronoi_knn.replicated(kept, 5).where("asked").groupBy("grp").count().collect()
    assert len(sent) > 8
    assert sum(r["count"] for r in sent) < 0.5 * 1600 * len(sent)


def test_empty_and_without_queries(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (3, [2.0])]) == []
    assert run(spark, [(10, [1.0])]) == []
