"""Nearest vectors on cells against all pairs."""

import numpy as np
import pytest

from plotwise.operators import vectors


def plain(rows, asks, k, threshold):
    ids = [i for i, v in rows if v is not None]
    x = np.array([v for _, v in rows if v is not None])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    at = {i: n for n, i in enumerate(ids)}
    out = {}
    for a in asks:
        s = np.round(x @ x[at[a]], 9)
        best = sorted((-s[n], i) for n, i in enumerate(ids) if i != a and s[n] >= threshold)[:k]
        out[a] = [(i, round(float(-t), 8)) for t, i in best]
    return out


@pytest.mark.parametrize("block,pivots,k,threshold", [(2048, 1024, 3, -1.0), (16, 1024, 5, 0.6), (16, 3, 10, -1.0)])
def test_topk_equals_all_pairs(spark, block, pivots, k, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 240)] + rng.normal(size=(240, 8)) * 0.2
    x[200:230] = x[0]  # equal vectors: ties go to the smaller id
    x[231] = 2 * x[5]
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)] + [(1, [0.0] * 8), (2, None), (3, [0.0] * 8)]
    d = spark.createDataFrame(rows, "i long, v array<double>")
    asks = d.where("i % 3 = 0 and v is not null")
    got = {}
    for r in vectors.cosine_topk(d, asks, "i", "v", k, threshold, pivots, block).orderBy("qid", "rn").collect():
        got.setdefault(r.qid, []).append((r.i, round(r.similarity, 8)))
    want = {a: v for a, v in plain(rows, [r.i for r in asks.collect()], k, threshold).items() if v}
    assert {a: [i for i, _ in v] for a, v in got.items()} == {a: [i for i, _ in v] for a, v in want.items()}
    assert all(abs(s - t) < 1e-7 for a in want for (_, s), (_, t) in zip(got[a], want[a]))


def test_far_cells_are_not_visited(spark, monkeypatch):
    """Tight, distant groups: most pairs of a query and a cell never meet."""
    rng = np.random.default_rng(6)
    centres = np.eye(16)
    x = centres[np.repeat(np.arange(16), 40)] + rng.normal(size=(640, 16)) * 0.01
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    probes, whole = [], vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda df, label="stage", **kw: probes.append((label, whole(df, label, **kw))) or probes[-1][1])
    got = vectors.cosine_topk(d, d, "i", "v", 4, block=10)
    assert got.count() == 640 * 4 and all(r.qid // 40 == r.i // 40 for r in got.collect())
    cells = next(t for n, t in probes if n == "vector-cells").select("cell").distinct().count()
    assert sum(t.count() for n, t in probes if n == "vector-probes") < 0.5 * 640 * cells


def test_topk_of_nothing(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "i long, v array<double>")
    assert vectors.cosine_topk(d, d, "i", "v").collect() == []
    assert vectors.cosine_topk(d.where("false"), d, "i", "v").collect() == []
    assert vectors.cosine_topk(d, d.where("false"), "i", "v").collect() == []


def test_vectors_are_dealt_out_once(spark, monkeypatch):
    """Blocks hold each vector and query once, and answers are at most k a query, however many cells a query visits."""
    x = np.random.default_rng(7).normal(size=(400, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    staged, whole = {}, vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda df, label="stage", **kw: staged.setdefault(label, []).append(whole(df, label, **kw)) or staged[label][-1])
    assert vectors.cosine_topk(d, d, "i", "v", 4, block=20).count() == 1600
    assert {n: len(t) for n, t in staged.items()} == {"vector-cells": 1, "vector-probes": 1, "vector-hits": 1}
    assert all(sum(len(r.v) for r in staged[n][0].collect()) == 400 * 16 * 8 for n in ("vector-cells", "vector-probes"))
    assert staged["vector-hits"][0].count() == 1600
