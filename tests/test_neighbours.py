"""Neighbour search on leaves and counts in bands against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotwise.operators import geo, neighbours, outliers, valuation, vectors
from plotwise.operators.relational import band_counts, weight_in_boxes


@pytest.fixture
def small(monkeypatch):
    """Many leaves and rounds on few rows."""
    for n, v in {"LEAF": 8, "BLOCK": 16, "SLICE": 16, "RUN": 4, "WORK": 64}.items():
        monkeypatch.setattr(neighbours, n, v)


def listings(rng, n):
    price, area = np.exp(rng.normal(19, 0.5, n)).astype(int), np.round(np.exp(rng.normal(4.4, 0.4, n)))
    price[: n // 8], area[: n // 8] = price[0], area[0]  # copies
    lon, lat = rng.normal(-74, 0.05, n).round(3), rng.normal(4.6, 0.05, n).round(3)
    rows = [(int(i), "c", "k" if i % 3 else "m", float(a), int(p), None if i % 7 == 0 else float(x), None if i % 7 == 0 else float(y), i % 11 == 0, 1.0)
            for i, (a, p, x, y) in enumerate(zip(area, price, lon, lat))]
    return rows + [rows[5], rows[21]]  # whole rows may repeat


SCHEMA = "id long, city string, kind string, area double, price long, lon double, lat double, is_outlier boolean, composite double"


def metres(a, b):
    x, y = np.radians([a[6], b[6]])
    h = np.sin((y - x) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin(np.radians(b[5] - a[5]) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(min(1.0, h)))


@pytest.mark.parametrize("scaled,itself", [(True, True), (False, True), (True, False)])
def test_similar_equals_all_pairs(spark, small, scaled, itself):
    rows = listings(np.random.default_rng(3), 160)
    got = valuation.similar(spark.createDataFrame(rows, SCHEMA), k=5, scaled=scaled, include_self=itself)
    want = {}
    for a in rows:
        for b in rows:
            if a[2] == b[2] and a[4] * 0.8 <= b[4] <= a[4] * 1.2 and a[3] * 0.85 <= b[3] <= a[3] * 1.15 and (itself or a[0] != b[0]):
                d = round(abs(b[4] - a[4]) / a[4] + abs(b[3] - a[3]) / a[3], 9) if scaled else float(abs(b[4] - a[4]) + abs(b[3] - a[3]))
                want.setdefault(a[0], []).append((d, b[0]))
    want = {(i, n + 1): (d, j) for i, v in want.items() for n, (d, j) in enumerate(sorted(v)[:5])}
    got = {(r.id, r.rn): (r.dist, r.sim_id) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[x][1] == want[x][1] and got[x][0] == pytest.approx(want[x][0]) for x in want)


def test_comparables_equal_all_pairs(spark, small):
    rows = listings(np.random.default_rng(5), 140)
    d = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for a in dict.fromkeys(rows):
        for level, (wa, wp) in enumerate(valuation.BANDS, 1):
            c = []
            for b in rows:
                if a[0] != b[0] and a[2] == b[2] and not b[7] and a[3] * (1 - wa) <= b[3] <= a[3] * (1 + wa) and a[4] * (1 - wp) <= b[4] <= a[4] * (1 + wp) and (a[5] is None or b[5] is not None):
                    c += [(round(metres(a, b), 3) if a[5] is not None else round(abs(b[3] - a[3]) + abs(b[4] - a[4]) / 1e6, 6), b[0])] * rows.count(a)
            if len(c) >= 4 or level == 3:
                want.update({(a[0], n + 1): (level, j) for n, (_, j) in enumerate(sorted(c)[:4])})
                break
    assert {(r.id, r.rn): (r.level, r.comp_id) for r in valuation.comparables(d, d).collect()} == want


def test_k_distances_equal_all_pairs(spark, small):
    x = np.random.default_rng(6).normal(size=(200, 3)) ** 3
    x[:20] = x[30]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = {r.id: r.k_dist for r in outliers.k_distances(df, ["a", "b", "c"], "id", 5).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 5]
    assert got == pytest.approx(dict(enumerate(d)), abs=2e-9)


def test_nearest_per_key_and_others(spark, small):
    rng = np.random.default_rng(8)
    p, f = rng.uniform(0, 0.2, (50, 2)), rng.uniform(0, 0.2, (150, 2))
    pts = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, lon double, lat double")
    fs = spark.createDataFrame([(i, "ab"[i % 2], *map(float, v)) for i, v in enumerate(f)], "fid long, key string, flon double, flat double")
    got = {(r.id, r.key, r.fid) for r in geo.nearest_per_key(pts, fs, 3, ident="id", fid="fid", key="key", within=4000.0).collect()}
    at = lambda x: (0, 0, 0, 0, 0, *x)
    want = set()
    for i, a in enumerate(p):
        for key in "ab":
            near = sorted((round(metres(at(a), at(b)), 3), j) for j, b in enumerate(f) if "ab"[j % 2] == key and metres(at(a), at(b)) <= 4000)
            want |= {(i, key, j) for _, j in near[:3]}
    assert got == want
    others = {(r.id, r._f) for r in geo.nearest_others(pts, pts, 4, ident="id").collect()}
    assert others == {(i, j) for i, a in enumerate(p) for _, j in sorted((round(metres(at(a), at(b)), 3), j) for j, b in enumerate(p) if j != i)[:4]}


def test_many_equal_listings(spark):
    """40 000 equal listings are one place with 40 000 answers to choose from, not 1.6 billion pairs."""
    d = spark.range(40_000).select("id", F.lit("c").alias("city"), F.lit("k").alias("kind"), F.lit(80.0).alias("area"), F.lit(2 * 10**8).alias("price"),
                                   F.lit(-74.1).alias("lon"), F.lit(4.6).alias("lat"), F.lit(False).alias("is_outlier"), F.lit(1.0).alias("composite"))
    assert valuation.similar(d).where("sim_id < 5 and rn = sim_id + 1").count() == 200_000
    assert valuation.comparables(d, d).where("level = 1 and comp_id < 5").count() == 160_000


def test_weight_in_boxes():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        x, y, w = rng.integers(0, 30, n).astype(float), rng.integers(0, 30, n).astype(float), rng.integers(1, 4, n)
        a, b = rng.uniform(-2, 30, (2, 90)), rng.uniform(0, 12, (2, 90))
        got = weight_in_boxes(x, y, w, [a[0], a[0] + b[0] - 1, a[1], a[1] + b[1] - 1])
        inside = (x >= a[0][:, None]) & (x <= (a[0] + b[0] - 1)[:, None]) & (y >= a[1][:, None]) & (y <= (a[1] + b[1] - 1)[:, None])
        assert (got == (inside * w).sum(1)).all()


def test_band_counts_of_one_crowded_bin(spark):
    """40 000 different listings inside one another's bands: counted, never paired."""
    d = spark.range(40_000).select("id", F.lit("c").alias("city"), (F.col("id") * 1e-6 + 100).alias("area"), (F.col("id") % 20_000 + 10**8).alias("price"))
    got = band_counts(d, d, ["city"], {"area": 0.2, "price": 0.3})
    assert got.where("matches = 40000").count() == 40_000


def test_vector_batches_stay_small():
    parts = list(vectors._slices(pd.DataFrame({"id": range(10_000)}), 1024))
    assert max(map(len, parts)) * 1024 <= vectors.VISITS and sum(map(len, parts)) == 10_000


def test_search_takes_two_rounds(spark, small, monkeypatch):
    """Points are staged twice, however many leaves lie within their reach, and equal spots send back k rows of an answer."""
    x = np.random.default_rng(9).normal(size=(400, 3))
    x[200:300] = x[0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    staged, whole = [], neighbours.stage
    monkeypatch.setattr(neighbours, "stage", lambda d, label="stage", **kw: staged.append((label, whole(d, label, **kw))) or staged[-1][1])
    got = {r.id: r.k_dist for r in outliers.k_distances(df, ["a", "b", "c"], "id", 4).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 4]
    assert got == pytest.approx(dict(enumerate(d)), abs=2e-9)
    assert [n for n, _ in staged] == ["features", "leaves", "points", "found"]
    found = staged[-1][1].where("_c is not null").selectExpr("size(_c) n", "size(array_distinct(transform(_c, x -> struct(x._fa, x._fb, x._fc)))) spots").collect()
    assert len(found) == 300 and max(r.n for r in found) <= 5 * 5 and any(r.n > r.spots for r in found)


def test_only_allowed_pairs_are_measured():
    p, f = neighbours.Rows({"x": np.arange(5.0)}), neighbours.Rows({"y": np.arange(8.0)})
    asked = []
    measure = lambda a, b, one: asked.append((len(a), len(b), one)) or neighbours.apart(a, b, "x", "y", one)
    got = neighbours.where_allowed(lambda a, b: b["y"][None, :] > a["x"][:, None], measure)(p, f)
    assert asked == [(25, 25, True)]
    assert np.array_equal(got, np.where(np.arange(8) > np.arange(5)[:, None], np.arange(8.0) - np.arange(5.0)[:, None], np.inf))
