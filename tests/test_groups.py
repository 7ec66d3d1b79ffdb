"""Fits of many groups on the executors, and exact quantile regression."""

import itertools

import numpy as np
import pandas as pd
import pytest

from plotwise.operators import gram as gm
from plotwise.operators import regression as rg
from plotwise.operators import validation as va


def test_twenty_thousand_groups(spark):
    rng = np.random.default_rng(2)
    n, per = 20_000, 6
    g = np.repeat(np.arange(n), per)
    x = rng.normal(size=(n * per, 2))
    slope = rng.normal(size=(n, 2))
    y = 1.5 + g / 1000 + (x * slope[g]).sum(1)
    d = spark.createDataFrame(pd.DataFrame({"g": g, "a": x[:, 0], "b": x[:, 1], "y": y})).repartition(6)
    fits = gm.group_grams(d, ["y", "a", "b"], ["g"]).fits("y", ["a", "b"])
    got = fits.toPandas().sort_values("g")
    assert len(got) == n and np.allclose(np.stack(got.coef), slope, atol=1e-6) and np.allclose(got.intercept, 1.5 + np.arange(n) / 1000, atol=1e-6)
    err = rg.predictions(d, fits, ["a", "b"], ["g"]).selectExpr("max(abs(predicted - y)) AS e").first()["e"]
    assert err < 1e-6
    t = rg.grouped_ols(d, "y", ["a", "b"], ["g"])
    assert t.where("item = 'n'").count() == n
    assert rg.vif(d, ["a", "b"], ["g"]).count() == 2 * n
    s = va.subgroup_fits(d, "g", "y", "a", ["a", "b"], [], at_least=5)
    assert s.where("item = 'r2_full'").count() == n and s.where("item = 'verdict'").first()["label"] == "homogeneous"


def test_group_statistics_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    g = rng.choice(["a", "b", "c", None], 400, p=[0.7, 0.2, 0.05, 0.05])
    x = rng.normal(size=(400, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    x[rng.random(400) < 0.1, 1] = np.nan
    d = spark.createDataFrame(pd.DataFrame({"g": g, "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
    stats = gm.grams(d, ["x", "y", "z"], ["g"])
    assert set(stats) == {("a",), ("b",), ("c",)}
    for (k,), s in stats.items():
        v = x[(g == k) & ~np.isnan(x[:, 1])]
        assert s.n == len(v) and np.allclose(s.mean(), v.mean(0)) and np.allclose(s.cov(), np.cov(v.T))


def check_loss(r, tau):
    return np.where(r >= 0, tau * r, (tau - 1) * r).sum()


def best_vertex(X, y, tau):
    """Least loss over all planes through as many points as there are coefficients."""
    best = np.inf
    for at in itertools.combinations(range(len(y)), X.shape[1]):
        A = X[list(at)]
        if abs(np.linalg.det(A)) > 1e-9:
            best = min(best, check_loss(y - X @ np.linalg.solve(A, y[list(at)]), tau))
    return best


@pytest.mark.parametrize("p", [2])
def test_quantile_fits_are_optimal(spark, p):
    rng = np.random.default_rng(10 + p)
    frames, data = [], {}
    for k, n in (("a", 30), ("b", 41), ("c", 12)):
        x = rng.normal(size=(n, p)) * 50 + 1000
        y = 3 + x.sum(1) * (2 if k == "a" else -1) + rng.exponential(20, n)
        y[: n // 4] = np.round(y[: n // 4])
        frames.append(pd.DataFrame({"k": k, **{f"x{i}": x[:, i] for i in range(p)}, "y": y}))
        data[k] = (np.hstack([np.ones((n, 1)), x]), y)
    d = spark.createDataFrame(pd.concat(frames)).repartition(3)
    got = rg.quantile_fits(d, "y", [f"x{i}" for i in range(p)], ["k"], taus=(0.1, 0.5, 0.75)).collect()
    assert len(got) == 9
    for r in got:
        X, y = data[r.k]
        loss, want = check_loss(y - X @ np.array([r.intercept, *r.coef]), r.tau), best_vertex(X, y, r.tau)
        assert want - 1e-7 * want <= loss <= want * (1 + 1e-7) and r.gap <= 1e-8 * r.loss and abs(r.loss - want) <= 1e-7 * want and r.passes < rg.MOST_PASSES


def test_quantile_fits_of_odd_groups(spark):
    rows = [("one", 1.0, 2.0)] + [("flat", 1.0, float(i)) for i in range(9)] + [("exact", float(i), 2.0 * i + 1) for i in range(8)] + [("none", None, 1.0), (None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in rg.quantile_fits(d, "y", ["x"], ["k"], taus=(0.5,)).collect()}
    assert set(got) == {"one", "flat", "exact"}
    assert abs(got["one"].intercept + got["one"].coef[0] - 2) < 1e-6 and abs(got["flat"].intercept + got["flat"].coef[0] - 4) < 1e-6
    assert abs(got["exact"].coef[0] - 2) < 1e-6 and abs(got["exact"].intercept - 1) < 1e-6
    assert rg.quantile_fits(d.where("false"), "y", ["x"], ["k"]).collect() == []


def test_quantile_rows_meet_the_state_in_blocks(spark):
    d = spark.range(5000).selectExpr("id % 2 AS k", "double(id) AS x").coalesce(1)
    got = rg.blocks(d, ["k"], ["x"], "k long").collect()
    held = [(r.k, x) for r in got for x in np.frombuffer(r._rows)]
    assert len(got) < 100 and sorted(held) == sorted((i % 2, float(i)) for i in range(5000))
