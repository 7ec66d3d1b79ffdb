"""Clipped polygon cells against the plain even-odd rule over whole rings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.functions import spatial as sp
from plotwise.operators import geo


def star(rng, x, y, r, n):
    pts = [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return pts + pts[:1]


def frame(spark, polys):
    return spark.createDataFrame([(i, f"p{i}", [[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]) for i, rings in polys], "poly_id long, name string, rings array<array<struct<x:double,y:double>>>")


def plain(rings, x, y):
    odd = np.zeros(len(x), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


@pytest.mark.parametrize("size", [2.0**-7, 0.3, 8.0])
def test_cells_equal_whole_rings(spark, size):
    rng = random.Random(5)
    polys = [(i, [star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0.004, 0.05, 0.6]), rng.randint(3, 40))]) for i in range(25)]
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    polys += [(30, [square(-0.5, -0.5, 1.0), square(-0.25, -0.25, 0.5)]), (31, [square(0.5, 0.25, 0.25), square(-1, -1, 0.125)]), (32, [square(0.5, 0.25, 0.25)]), (33, [[(0.1, 0.1), (0.2, 0.1), (0.1, 0.1)]])]
    grid = [(a / 16, b / 16) for a in range(-18, 18, 1) for b in range(-18, 18, 1)]  # on corners, borders and cell sides
    pts = grid + [(rng.uniform(-1.7, 1.7), rng.uniform(-1.7, 1.7)) for _ in range(2500)]
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(-1, None, 0.0)], "id long, lon double, lat double")
    df = frame(spark, polys)
    hits = geo.point_in_polygon(d, df, size=size)
    assert hits.columns == ["lon", "lat", "poly_id", "name"]
    got = {(r.lon, r.lat, r.poly_id) for r in hits.collect()}
    x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
    want = {(pts[i][0], pts[i][1], pid) for pid, rings in polys for i in np.flatnonzero(plain(rings, x, y))}
    assert got == want and len(want) > 500
    closed = geo.point_in_polygon(d, df, size=size, closed=True)
    brute = d.dropna().select("lon", "lat").distinct().crossJoin(df).where(sp.inside(F.col("rings"), "lon", "lat") | sp.on_boundary(F.col("rings"), "lon", "lat"))
    assert {tuple(r) for r in closed.select("lon", "lat", "poly_id").collect()} == {tuple(r) for r in brute.select("lon", "lat", "poly_id").collect()}


def test_a_polygon_of_many_vertices(spark):
    """10^5 vertices: no row of the index holds more than the edges of one cell, most cells hold none."""
    n = 100_000
    ring = [(0.5 * math.cos(2 * math.pi * i / n) * (1 + 0.2 * math.sin(2 * math.pi * 7 * i / n)), 0.5 * math.sin(2 * math.pi * i / n) * (1 + 0.2 * math.sin(2 * math.pi * 7 * i / n))) for i in range(n)]
    poly = frame(spark, [(1, [ring + ring[:1]])])
    cells = geo.clipped_cells(poly)
    assert "rings" not in cells.columns
    most, empty, rows = cells.agg(F.max(F.size("_edges")), F.count(F.when(F.size("_edges") == 0, 1)), F.count("*")).first()
    assert most < n / 50 and empty > rows / 2
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-0.7, 0.7, 3000), rng.uniform(-0.7, 0.7, 3000)
    d = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "lon double, lat double")
    r, a = np.hypot(x, y), np.arctan2(y, x)
    clear = np.abs(r - 0.5 * (1 + 0.2 * np.sin(7 * a))) > 1e-4
    got = {(h.lon, h.lat) for h in geo.point_in_polygon(d, poly).collect()}
    inside = r < 0.5 * (1 + 0.2 * np.sin(7 * a))
    assert all(((px, py) in got) == bool(i) for px, py, i, c in zip(x, y, inside, clear) if c)


def test_no_polygons(spark):
    d = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    assert geo.point_in_polygon(d, frame(spark, []).where("false")).collect() == []
    none = frame(spark, [(1, [])]).withColumn("rings", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
    assert geo.point_in_polygon(d, none).collect() == []


def recursive(pts, tol):
    """Plain Douglas-Peucker over a list of points."""
    if len(pts) < 3:
        return pts
    (ax, ay), (bx, by) = pts[0], pts[-1]

    def off(p):
        dx, dy = bx - ax, by - ay
        long = dx * dx + dy * dy
        t = min(1, max(0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / long)) if long else 0
        return math.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy)

    at = max(range(1, len(pts) - 1), key=lambda i: off(pts[i]))
    if off(pts[at]) <= tol:
        return [pts[0], pts[-1]]
    return recursive(pts[: at + 1], tol)[:-1] + recursive(pts[at:], tol)


@pytest.mark.parametrize("tol", [0.0, 0.01, 0.1, 0.4])
def test_simplified_rings_equal_the_recursive_version(spark, tol):
    rng = random.Random(3)
    polys = [(i, [star(rng, 0, 0, 1, rng.randint(5, 120)), star(rng, 3, 3, 1, 30)]) for i in range(20)]
    walk = [(0.0, 0.0)]
    for _ in range(200):
        walk.append((walk[-1][0] + rng.uniform(0, 1), walk[-1][1] + rng.uniform(-0.3, 0.3)))
    polys += [(50, [walk]), (51, [[(0, 0), (1, 1)], [(2, 2)], []])]
    got = {r.poly_id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in geo.simplified(frame(spark, polys), tol).collect()}
    for pid, rings in polys:
        for ring, mine in zip(rings, got[pid]):
            want = recursive([(float(x), float(y)) for x, y in ring], tol)
            assert mine == want or (len(want) < 4 and ring[0] == ring[-1])


def test_small_rings_stay_rings(spark):
    tiny = [(0.0, 0.0), (0.01, 0.0), (0.012, 0.004), (0.01, 0.01), (0.0, 0.01), (0.0, 0.0)]
    (r,) = geo.simplified(frame(spark, [(1, [tiny])]), 5.0).collect()
    ring = [(p.x, p.y) for p in r.rings[0]]
    assert len(ring) == 4 and ring[0] == ring[-1] and len(set(ring)) == 3
