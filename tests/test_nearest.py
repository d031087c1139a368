"""Nearest rows and close pairs by blocks against brute force, and that no row is made for every pair."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import models, nearest, vectors
from quillon.plans import reference_queries

KIND = "vec_id long, label int, embedding array<float>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd_vectors(n: int) -> list[tuple]:
    """Vectors with many copies, near copies, zero, null and empty ones."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), rng.normal(size=6).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, i % 3, rows[7][2]) for i in range(60)] + [(n + 100 + i, i % 3, np.float32([x * 1.0000001 for x in rows[7][2]]).tolist()) for i in range(9)]
    return rows + [(n + 120, 1, [0.0] * 6), (n + 140, 1, None), (n + 160, 2, [])]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 13)
    monkeypatch.setattr(nearest, "QUERIES", 4)


def test_top_k(spark, small_blocks):
    rows = odd_vectors(300)
    df = spark.createDataFrame(rows, KIND)
    got = vectors.top_k(df, df.where("vec_id % 20 = 0"), 3)
    assert "Generate" not in plan(got)
    of = {i: np.array(v, float) if v and any(v) else None for i, _, v in rows}
    none = -np.inf
    for q in (i for i in of if i % 20 == 0):
        sims = [(none if of[q] is None or of[i] is None else round(float(of[q] @ of[i] / np.linalg.norm(of[q]) / np.linalg.norm(of[i])), 6), i) for i in of if i != q]
        want = sorted(sims, key=lambda x: (-x[0], x[1]))[:3]
        rest = [(none if r.sim is None else r.sim, r.vec_id) for r in got.where(F.col("query_id") == q).orderBy("place").collect()] if q in (0, 300, 340, 420, 440) else None
        assert rest is None or rest == want


def test_agent_graph_looks_once(spark, sf_dir):
    assert not re.search("CartesianProduct|NestedLoop|MapInArrow", plan(reference_queries()["agent_graph_dry_run"](spark, sf_dir)))


def test_many_pairs_take_seconds(spark):
    """Pairs of 8,000 vectors by rows and cells took minutes."""
    v = np.random.default_rng(4).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 5, x) for i, x in enumerate(v.tolist())] + [(9000 + i, (i + 1) % 5, x) for i, x in enumerate((v * 1.5).tolist())], KIND)
    began = time.time()
    got = vectors.similar_pairs(df, 0.8, "label")
    assert "Generate" not in plan(got)
    assert sorted((r.a, r.b, r.sim) for r in got.collect()) == [(i, 9000 + i, 1.0) for i in range(4000)] and time.time() - began < 90


def test_close_pairs_of_odd_vectors(spark, small_blocks):
    rows = odd_vectors(200)
    got = {(r.a, r.b): r.sim for r in nearest.pairs_within(spark.createDataFrame(rows, "id long, y int, v array<float>"), 0.6).collect()}
    of = {i: (y, np.array(v, float)) for i, y, v in rows if v and any(v)}
    want = {(a, b): s for a in of for b in of if a < b and of[a][0] != of[b][0] and (s := float(of[a][1] @ of[b][1] / np.linalg.norm(of[a][1]) / np.linalg.norm(of[b][1]))) >= 0.6}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want) and len(want) > 300


def test_nearest_neighbours(spark, small_blocks):
    rng = np.random.default_rng(5)
    rows = [(i, None if i == 7 else int(rng.integers(3)), *map(float, rng.integers(0, 4, 2))) for i in range(400)] + [(500, 1, None, 0.0)]
    df = spark.createDataFrame(rows, "i long, y int, a double, b double")
    got = models.nearest_neighbours(df.where("i % 20 <> 0"), df.where("i % 20 = 0 and i < 500"), "i", ["a", "b"], "y", 5)
    assert "Generate" not in plan(got)
    train = [r for r in rows if r[0] % 20 and r[2] is not None]
    for r in got.collect():
        _, _, a, b = rows[r.i]
        near = [t[1] for t in sorted(train, key=lambda t: ((t[2] - a) ** 2 + (t[3] - b) ** 2, t[0]))[:5]]
        assert r.prediction == min((y for y in near if y is not None), key=lambda y: (-near.count(y), y))
    assert got.count() == 20
