"""Geometry as plain columns: points are lon/lat doubles, rings are array<struct<x,y>>."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_R = 6_371_000.0
METRES_PER_DEGREE = math.pi * EARTH_R / 180
MERCATOR_R = 6_378_137.0


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres on a sphere."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_R) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_xy(lon, lat, lat0: float = 4.65) -> tuple[Column, Column]:
    """Equirectangular metres around `lat0`, the planar frame of the short-range kernels."""
    return (_c(lon) * (METRES_PER_DEGREE * math.cos(math.radians(lat0))), _c(lat) * METRES_PER_DEGREE)


# ------------------------------------------------------------- projections


def mercator_to_lonlat(x, y) -> tuple[Column, Column]:
    return F.degrees(_c(x) / MERCATOR_R), F.degrees(F.atan(F.sinh(_c(y) / MERCATOR_R)))


def lonlat_to_mercator(lon, lat) -> tuple[Column, Column]:
    return (F.radians(_c(lon)) * MERCATOR_R,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * MERCATOR_R)


class TransverseMercator:
    """Transverse Mercator by the Krueger series (third order), forward and inverse."""

    def __init__(self, lat0, lon0, k0, x0, y0, a, rf):
        self.lon0, self.k0, self.x0, self.y0 = math.radians(lon0), k0, x0, y0
        f = 1 / rf
        n = f / (2 - f)
        self.e = math.sqrt(f * (2 - f))
        self.A = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
        self.beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
        self.delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
        p = math.radians(lat0)
        t = math.sinh(math.atanh(math.sin(p)) - self.e * math.atanh(self.e * math.sin(p)))
        xi = math.atan(t)
        self.m0 = xi + sum(a_ * math.sin(2 * (j + 1) * xi) for j, a_ in enumerate(self.alpha))

    def forward(self, lon, lat) -> tuple[Column, Column]:
        s, dl = F.sin(F.radians(_c(lat))), F.radians(_c(lon)) - self.lon0
        t = F.sinh(F.atanh(s) - F.lit(self.e) * F.atanh(F.lit(self.e) * s))
        xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
        east, north = eta, xi
        for j, a in enumerate(self.alpha):
            m = 2 * (j + 1)
            east = east + F.lit(a) * F.cos(xi * m) * F.sinh(eta * m)
            north = north + F.lit(a) * F.sin(xi * m) * F.cosh(eta * m)
        return (F.lit(self.x0) + east * (self.k0 * self.A), F.lit(self.y0) + (north - self.m0) * (self.k0 * self.A))

    def inverse(self, x, y) -> tuple[Column, Column]:
        xi = (_c(y) - self.y0) / (self.k0 * self.A) + self.m0
        eta = (_c(x) - self.x0) / (self.k0 * self.A)
        xi2, eta2 = xi, eta
        for j, b in enumerate(self.beta):
            m = 2 * (j + 1)
            xi2 = xi2 - F.lit(b) * F.sin(xi * m) * F.cosh(eta * m)
            eta2 = eta2 - F.lit(b) * F.cos(xi * m) * F.sinh(eta * m)
        chi = F.asin(F.sin(xi2) / F.cosh(eta2))
        lat = chi
        for j, d in enumerate(self.delta):
            lat = lat + F.lit(d) * F.sin(chi * (2 * (j + 1)))
        return F.degrees(F.lit(self.lon0) + F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(lat)


# National metric grid (EPSG 3116) and the city's own cartesian grid.
NATIONAL_GRID = TransverseMercator(4.596200416666666, -74.07750791666666, 1.0, 1_000_000.0, 1_000_000.0,
                                   6_378_137.0, 298.257222101)
CITY_GRID = TransverseMercator(4.680486111, -74.14659167, 1.0, 92_334.879, 109_320.965, 6_380_687.0, 298.257222101)


# -------------------------------------------------------------------- rings


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs; the ring is closed (first vertex repeated)."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))


def _fold(ring: Column, term) -> Column:
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + term(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def ring_area(ring: Column) -> Column:
    """Signed area in squared coordinate units."""
    return _fold(ring, lambda x1, y1, x2, y2: x1 * y2 - x2 * y1) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid; coordinates are taken relative to the first vertex to keep precision."""
    o = F.get(ring, 0)
    cross = lambda x1, y1, x2, y2: (x1 - o["x"]) * (y2 - o["y"]) - (x2 - o["x"]) * (y1 - o["y"])
    a = _fold(ring, cross)
    sx = _fold(ring, lambda x1, y1, x2, y2: (x1 + x2 - o["x"] * 2) * cross(x1, y1, x2, y2))
    sy = _fold(ring, lambda x1, y1, x2, y2: (y1 + y2 - o["y"] * 2) * cross(x1, y1, x2, y2))
    flat = F.nullif(a, F.lit(0.0)) * 3
    return o["x"] + F.coalesce(sx / flat, F.lit(0.0)), o["y"] + F.coalesce(sy / flat, F.lit(0.0))


def inside(rings: Column, x, y) -> Column:
    """Even-odd rule over all rings, so holes and multi-polygons need no flags.

    Edges are half-open: a point on a shared border belongs to one side only.
    """
    x, y = _c(x), _c(y)

    def crossings(ring):
        return F.aggregate(ring_edges(ring), F.lit(0), lambda n, e: n + F.when(
            ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]),
            1).otherwise(0))

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def on_boundary(rings: Column, x, y, eps: float = 1e-12) -> Column:
    """Point lies on some edge: `inside | on_boundary` is the intersects predicate."""
    x, y = _c(x), _c(y)

    def hit(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((F.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= eps)
                & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by)))

    return F.exists(rings, lambda r: F.exists(ring_edges(r), hit))


def edge_distance(rings: Column, lon, lat) -> Column:
    """Metres from a point to the nearest edge, in a plane tangent at the point."""
    lon, lat = _c(lon), _c(lat)
    kx, ky = F.cos(F.radians(lat)) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE)

    def one(e):
        ax, ay = (e["a"]["x"] - lon) * kx, (e["a"]["y"] - lat) * ky
        bx, by = (e["b"]["x"] - lon) * kx, (e["b"]["y"] - lat) * ky
        dx, dy = bx - ax, by - ay
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(ring_edges(r), one))))


def bbox(rings: Column) -> Column:
    """struct(x0, y0, x1, y1) over all rings."""
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def interior_point(rings: Column) -> tuple[Column, Column]:
    """A point that is inside: the middle of the widest span of the mid-height scan line."""
    box = bbox(rings)
    y = (box["y0"] + box["y1"]) / 2
    cuts = F.array_sort(F.flatten(F.transform(rings, lambda r: F.transform(
        F.filter(ring_edges(r), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)),
        lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))))
    # Even-odd rule: spans run between cuts 1-2, 3-4, ...
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size(cuts) / 2).cast("int") - 1), lambda i: F.struct(
        (F.get(cuts, i * 2 + 1) - F.get(cuts, i * 2)).alias("w"),
        ((F.get(cuts, i * 2 + 1) + F.get(cuts, i * 2)) / 2).alias("x")))
    return F.array_max(spans)["x"], y


def circle(lon, lat, radius_m, vertices: int = 32) -> Column:
    """Closed ring of `vertices` points around a centre."""
    lon, lat, radius_m = _c(lon), _c(lat), _c(radius_m)
    step = 2 * math.pi / vertices
    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda i: F.struct(
        (lon + radius_m * F.cos((i % vertices) * step) / (F.cos(F.radians(lat)) * METRES_PER_DEGREE)).alias("x"),
        (lat + radius_m * F.sin((i % vertices) * step) / METRES_PER_DEGREE).alias("y")))


def kept_vertices(x, y, tol: float) -> list[int]:
    """Indices of the vertices that Douglas-Peucker keeps.

    A vertex farther than `tol` from the chord of its stretch splits it, the
    farthest first. The chord of a closed ring is its first point. A ring keeps
    a triangle at least, so that it stays one.
    """
    n = len(x)
    if n < 3:
        return list(range(n))

    def farthest(a, b):
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        long = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / long, 0, 1) if long > 0 else 0.0
        off = (px - t * dx) ** 2 + (py - t * dy) ** 2
        at = int(off.argmax())
        return float(off[at]), a + 1 + at

    keep, todo = {0, n - 1}, [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            off, at = farthest(a, b)
            if off > tol * tol:
                keep.add(at)
                todo += [(a, at), (at, b)]
    while len(keep) < 4 and x[0] == x[-1] and y[0] == y[-1]:
        ends = sorted(keep)
        off, at = max((farthest(a, b) for a, b in zip(ends, ends[1:]) if b - a > 1), default=(0.0, 0))
        if off == 0:
            break
        keep.add(at)
    return sorted(keep)


def simplify(rings: Column, tol: float) -> Column:
    """Every ring reduced to the vertices `kept_vertices` names."""

    @F.pandas_udf("array<array<int>>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [kept_vertices(np.asarray(x, float), np.asarray(y, float), tol) for x, y in zip(a, b)] for a, b in zip(xs, ys)])

    axis = lambda name: F.transform(rings, lambda r: F.transform(r, lambda p: p[name]))
    return F.zip_with(rings, kept(axis("x"), axis("y")), lambda r, k: F.transform(k, lambda i: F.get(r, i)))
