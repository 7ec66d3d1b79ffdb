"""Distance, nearest-neighbour and point-in-polygon joins as equi joins on grid cells.

No join here compares all pairs: the sides meet only in the same grid cell.
Points that share a location are handled once, so copies of one hot location
cost one lookup; what remains skewed is split by Spark's skew-join handling.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import spatial as sp
from plotwise.operators.neighbours import Leaves, sphere, take
from plotwise.operators.ranking import join_on
from plotwise.session import stage

MAX_LAT, CELL_DEG = 15.0, 2.0**-7
_SLACK = 0.95  # chord/arc margin, safe for cells up to thousands of km


def cell_xy(lon, lat, size_m, max_lat: float = MAX_LAT) -> tuple[Column, Column]:
    """Integer cell of a point; points within `size_m` metres differ by at most one per axis.

    Rows beyond `max_lat` would break that promise, so they fail loudly.
    """
    lon, lat = sp._c(lon), sp._c(lat)
    size = size_m if isinstance(size_m, Column) else F.lit(float(size_m))
    ok = F.when(F.abs(lat) > max_lat, F.raise_error(F.lit(f"latitude beyond max_lat={max_lat}")).cast("double")).otherwise(lat)
    return (F.floor(lon * (sp.METRES_PER_DEGREE * _SLACK * math.cos(math.radians(max_lat))) / size),
            F.floor(ok * (sp.METRES_PER_DEGREE * _SLACK) / size))


def around(i: Column, reach: int = 1) -> Column:
    return F.explode(F.sequence(i - reach, i + reach))


def spread(df: DataFrame, names: list[str], reach: int = 1) -> DataFrame:
    """Copy each row into the block of neighbouring cells."""
    for n in names:
        df = df.withColumn(n, around(F.col(n), reach))
    return df


def locations(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Distinct non-null locations."""
    return points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        F.col(lon).alias("lon"), F.col(lat).alias("lat")).distinct()


def radius_classes(df: DataFrame, col: str, most: int = 64) -> list[float]:
    """The distinct radii of a layer table; a few by nature, and checked."""
    radii = sorted(float(r[0]) for r in df.select(F.col(col).cast("double")).distinct().limit(most + 1).collect())
    if len(radii) > most:
        raise ValueError(f"more than {most} distinct radii; round them to classes first")
    return radii or [1.0]


def radius_pairs(left: DataFrame, right: DataFrame, radius, max_lat: float = MAX_LAT, planar: bool = False) -> DataFrame:
    """All (left, right) rows within `radius` metres, with `dist`.

    `left` needs lon/lat; `right` needs flon/flat and other names of its own.
    `radius` is metres, or a column of `right` holding a few distinct radii:
    each radius then gets its own grid, so short radii do not pay for long ones.
    `planar` measures in the local metre frame and adds the Manhattan distance.
    """
    if isinstance(radius, str):
        radii = radius_classes(right, radius)
        right = right.withColumn("_r", F.col(radius).cast("double"))
    else:
        radii = [float(radius)]
        right = right.withColumn("_r", F.lit(float(radius)))
    left = left.withColumn("_r", F.lit(radii[0]) if len(radii) == 1 else F.explode(F.lit(radii)))
    # The planar frame may differ from the sphere by a few per mille.
    size = F.col("_r") * (1.05 if planar else 1.0)
    lx, ly = cell_xy("lon", "lat", size, max_lat)
    rx, ry = cell_xy("flon", "flat", size, max_lat)
    # Left rows stream through the join; copies of right rows would be held, and Spark's estimate of a side it broadcasts leaves copies out.
    a = spread(left.where("lon is not null and lat is not null").withColumns({"_x": lx, "_y": ly}), ["_x", "_y"])
    b = right.where("flon is not null and flat is not null").withColumns({"_x": rx, "_y": ry})
    pairs = a.join(b, ["_r", "_x", "_y"])
    if planar:
        (px, py), (fx, fy) = sp.local_xy("lon", "lat"), sp.local_xy("flon", "flat")
        pairs = pairs.withColumns({"dist": F.sqrt(F.pow(px - fx, 2) + F.pow(py - fy, 2)), "manhattan": F.abs(px - fx) + F.abs(py - fy)})
    else:
        pairs = pairs.withColumn("dist", sp.haversine("lon", "lat", "flon", "flat"))
    return pairs.where(F.col("dist") <= F.col("_r")).drop("_r", "_x", "_y")


def as_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.withColumnsRenamed({lon: "flon", lat: "flat"})


def stack_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse features that share keys and location into one row with a count `mult`."""
    return as_features(df).groupBy(*keys, "flon", "flat").agg(F.count("*").alias("mult"))


def per_location(points: DataFrame, fn, fill: dict | None = None) -> DataFrame:
    """Run `fn(distinct locations)` (one row per lon/lat out) and attach the result to every point."""
    res = fn(locations(points))
    out = join_on(points, res, ["lon", "lat"], "left")
    return out.fillna(fill) if fill else out


def radius_aggregate(points: DataFrame, features: DataFrame, radius, aggs: dict[str, Column], keys: list[str] = (),
                     fill: dict | None = None, planar: bool = False) -> DataFrame:
    """Aggregates over the features around every point.

    `aggs` may use `dist`, `mult` (features at that spot), the `keys` columns and,
    with `planar`, `manhattan`. Sums happen on the map side: pairs are not kept.
    """
    extra = [radius] if isinstance(radius, str) else []
    feats = stack_features(features, [*keys, *extra])

    def fn(locs):
        pairs = radius_pairs(locs, feats, radius, planar=planar)
        return pairs.groupBy("lon", "lat").agg(*[c.alias(n) for n, c in aggs.items()])

    return per_location(points, fn, fill)


def neighbour_average(points: DataFrame, features: DataFrame, col: str, radius: float, out: str, default: float | None = None) -> DataFrame:
    """Mean of a feature column within the radius; values at one spot are added up first."""
    f = as_features(features.where(F.col(col).isNotNull())).groupBy("flon", "flat").agg(
        F.sum(col).alias("_s"), F.count(col).alias("_k"))

    def fn(locs):
        return radius_pairs(locs, f, radius).groupBy("lon", "lat").agg((F.sum("_s") / F.sum("_k")).alias(out))

    return per_location(points, fn, {out: default} if default is not None else None)


# ------------------------------------------------------------------ nearest


def _coarse(name: str, levels: int, base: int) -> Column:
    """Cell at level `_lv`; the top level is one cell that holds everything."""
    return F.when(F.col("_lv") >= levels - 1, F.lit(0)).otherwise(F.floor(F.col(name) / F.pow(F.lit(base), F.col("_lv")))).cast("long")


def _blocks(cells: DataFrame, names: list[str], levels: int, by: list[str], base: int) -> DataFrame:
    """Number of features in the 3-wide block around each cell, for every level."""
    lv = cells.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    lv = lv.select(*by, "_lv", *[_coarse(n, levels, base).alias(n) for n in names], "_n")
    lv = lv.groupBy(*by, "_lv", *names).agg(F.sum("_n").alias("_n"))
    return spread(lv, names).groupBy(*by, "_lv", *names).agg(F.sum("_n").alias("_n"))


def grid_nearest(points: DataFrame, features: DataFrame, k: int, *, pcell: list[Column], fcell: list[Column],
                 dist: Column, levels: int, level_for, ident: list[str], order: list, by: list[str] = (),
                 where: Column | None = None, within: float | None = None, spare: int | None = None, base: int = 2) -> DataFrame:
    """Exact k nearest features per point with a pyramid of grids.

    `pcell`/`fcell` are finest-level integer cells. Level `l` has cells base**l as
    wide and the top level is a single cell, so nothing is out of reach;
    `level_for(dist)` names the first level whose 3-wide block surely holds
    everything within `dist`. Each point first looks in the smallest block with
    at least k features, which bounds its k-th distance, and then in the block
    that bound asks for. `ident` identifies a point; `order` ranks candidates;
    `where` drops pairs (such as a point with itself); `within` caps the distance
    of an answer. With a selective `where`, a larger
    `spare` (candidates wanted in the first block) makes the first look succeed
    more often; points it fails for search the whole of the top level.
    """
    by = list(by)
    names = [f"_c{i}" for i in range(len(pcell))]
    p = points.withColumns(dict(zip(names, pcell)))
    f = features.withColumns({n: c for n, c in zip(names, fcell)})
    spare = spare or k + (1 if where is not None else 0)
    counts = f.groupBy(*by, *names).agg(F.count("*").alias("_n"))
    blocks = _blocks(counts, names, levels, by, base)
    # Level per occupied finest cell, not per point.
    pc = p.select(*by, *names).distinct().withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    up = lambda n: _coarse(n, levels, base)
    look = pc.select(*by, "_lv", *[F.col(n).alias(f"{n}f") for n in names], *[up(n).alias(n) for n in names])
    start = (look.join(blocks, by + ["_lv"] + names).where(F.col("_n") >= spare)
             .groupBy(*by, *[f"{n}f" for n in names]).agg(F.min("_lv").alias("_lv"))
             .withColumnsRenamed({f"{n}f": n for n in names}))
    p = p.join(start, by + names, "left").withColumn("_lv", F.coalesce("_lv", F.lit(levels - 1)))
    if within is not None:
        p = p.withColumn("_lv", F.least("_lv", F.greatest(F.lit(0), level_for(F.lit(float(within)))).cast("int")))
    fl = f.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    fl = fl.withColumns({n: up(n) for n in names})

    def candidates(pts):
        q = spread(pts.withColumns({n: up(n) for n in names}), names)
        c = q.join(fl, by + ["_lv"] + names).withColumn("dist", dist)
        if where is not None:
            c = c.where(where)
        return c if within is None else c.where(F.col("dist") <= within)

    # First look: an upper bound of the k-th distance.
    w = Window.partitionBy(*ident).orderBy(*order)
    first = candidates(p).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    bound = first.groupBy(*ident).agg(F.max("_rn").alias("_got"), F.max("dist").alias("_kth"))
    # Points with fewer than k answers so far look as far as an answer may lie.
    far = F.lit(levels - 1) if within is None else F.least(F.lit(levels - 1), F.greatest(F.lit(0), level_for(F.lit(float(within)))))
    q = join_on(p, bound, ident, "left").withColumn("_lv", F.when(
        F.col("_got") >= k, F.least(far, F.greatest(F.lit(0), level_for(F.col("_kth"))))).otherwise(far).cast("int"))
    best = candidates(q.drop("_got", "_kth")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return best.drop("_lv", *names)


def nearest(points: DataFrame, features: DataFrame, k: int = 1, *, fid: str, by: list[str] = (), finest_m: float = 50.0,
            levels: int = 13, max_lat: float = MAX_LAT, exclude_self: str | None = None, within: float | None = None) -> DataFrame:
    """k nearest features (great-circle) for each distinct location of `points`, ties by `fid`.

    `points` needs lon/lat, `features` flon/flat and `fid`. With `exclude_self`
    naming an id column of `points`, a feature of the same id is not a neighbour
    and results are per point instead of per location.
    """
    by = list(by)
    ident = by + ["lon", "lat"] + ([exclude_self] if exclude_self else [])
    pts = points.where("lon is not null and lat is not null").select(*ident).distinct()
    feats = features.where("flon is not null and flat is not null")
    # No more than k (+ itself) features of one spot can be among the k nearest.
    spare = k + (1 if exclude_self else 0)
    spot = Window.partitionBy(*by, "flon", "flat").orderBy(fid)
    feats = feats.withColumn("_rn", F.row_number().over(spot)).where(F.col("_rn") <= spare).drop("_rn")
    # Distances are told apart to the millimetre; closer ties go to the smaller id.
    level_for = lambda d: F.ceil(F.log2((d + 0.001) / finest_m))
    return grid_nearest(
        pts, feats, k, pcell=list(cell_xy("lon", "lat", finest_m, max_lat)),
        fcell=list(cell_xy("flon", "flat", finest_m, max_lat)), dist=F.round(sp.haversine("lon", "lat", "flon", "flat"), 3),
        levels=levels, level_for=level_for, ident=ident, order=["dist", fid], by=by,
        where=(F.col(exclude_self) != F.col(fid)) if exclude_self else None, within=within)


def nearest_per_key(points: DataFrame, features: DataFrame, k: int, *, ident: str, fid: str, key: str, within: float) -> DataFrame:
    """ident, key, `fid`, dist: up to k nearest features of every key within `within` metres of each point."""
    here = stage(points.where("lon is not null and lat is not null").crossJoin(features.select(key).distinct()), "points")
    leaves = Leaves(features, ["flon", "flat"], fid, [key])
    metres, least = sphere("lon", "lat", "flon", "flat")
    exact = lambda c: sp.haversine(c("lon"), c("lat"), c("flon"), c("flat"))
    near = leaves.nearest(here.select(key, "lon", "lat").distinct(), ["lon", "lat"], k, measure=metres, lower=least, dist=lambda c: F.round(exact(c), 3), slack=2e-3, where=lambda c: exact(c) <= within, most=within)
    return take(here, near, [key, "lon", "lat"], ident, k, fid, False).select(ident, key, fid, "dist")


def nearest_others(points: DataFrame, features: DataFrame, k: int, *, ident: str) -> DataFrame:
    """ident, `_f`, dist: the k nearest features of another id for every point, ties by id."""
    f = features.select(F.col(ident).alias("_f"), F.col("lon").alias("flon"), F.col("lat").alias("flat"))
    leaves = Leaves(f, ["flon", "flat"], "_f")
    metres, least = sphere("lon", "lat", "flon", "flat")
    near = leaves.nearest(points.select("lon", "lat").distinct(), ["lon", "lat"], k + leaves.same_id(), measure=metres, lower=least, dist=lambda c: F.round(sp.haversine(c("lon"), c("lat"), c("flon"), c("flat")), 3), slack=2e-3)
    return take(points, near, ["lon", "lat"], ident, k, "_f", True).select(ident, "_f", "dist")


# ----------------------------------------------------------------- polygons


def polygon_cells(polys: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """One row per grid cell touched by the bounding box of `rings`, grown by `pad` degrees."""
    b = polys.withColumn("_box", sp.bbox(F.col("rings")))
    cells = lambda a, z: F.explode(F.sequence(F.floor((F.col(f"_box.{a}") - pad) / size), F.floor((F.col(f"_box.{z}") + pad) / size)))
    return b.withColumn("_gx", cells("x0", "x1")).withColumn("_gy", cells("y0", "y1")).drop("_box")


def polygons_within(locs: DataFrame, polys: DataFrame, radius_m: float, size: float = 0.01, max_lat: float = MAX_LAT) -> DataFrame:
    """(location, polygon) pairs no farther apart than `radius_m`; `dist` is zero inside."""
    pad = radius_m * 1.02 / (sp.METRES_PER_DEGREE * math.cos(math.radians(max_lat)))
    a = locs.withColumns({"_gx": F.floor(F.col("lon") / size), "_gy": F.floor(F.col("lat") / size)})
    j = a.join(polygon_cells(polys, size, pad), ["_gx", "_gy"])
    d = F.when(sp.inside(F.col("rings"), "lon", "lat"), 0.0).otherwise(sp.edge_distance(F.col("rings"), "lon", "lat"))
    return j.withColumn("dist", d).where(F.col("dist") <= radius_m).drop("_gx", "_gy", "rings")


def clipped_cells(polys: DataFrame, size: float = CELL_DEG) -> DataFrame:
    """Polygons as grid cells, each with what a point in it needs: `_edges`, `_odd`, no rings.

    A cell keeps the edges that meet it and the parity of its lower left corner,
    the number of borders right of it on the cell's lower side. Cells wholly
    inside keep no edges. All other columns of `polys` stay. `size` is rounded
    to a power of two, so that cell borders are exact numbers.
    """
    size = 2.0 ** round(math.log2(size))
    # Staged: the ids have to be the same each time they are read.
    p = stage(polys.where("rings is not null").withColumn("_pid", F.monotonically_increasing_id()), "polygons")
    edge = F.explode(F.flatten(F.transform("rings", sp.ring_edges)))
    e = p.select("_pid", edge.alias("e")).select("_pid", *[F.col(f"e.{q}.{x}").cast("double").alias(f"{q}{x}") for q in "ab" for x in "xy"])
    e = e.where("ax <> bx or ay <> by")
    at = lambda v: F.floor(v / size)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    e = e.withColumn("_gy", F.explode(F.sequence(at(low), at(high)))).withColumn("_yb", F.col("_gy") * size)
    # Where the edge enters and leaves the row, a hair wider.
    x_of = lambda y: F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    inner = lambda y, other: F.when(F.col("ay") == F.col("by"), F.col(other)).otherwise(x_of(y))
    x1, x2 = inner(F.greatest(low, F.col("_yb")), "ax"), inner(F.least(high, F.col("_yb") + size), "bx")
    first = F.greatest(F.least("ax", "bx"), F.least(x1, x2) - 1e-9)
    last = F.least(F.greatest("ax", "bx"), F.greatest(x1, x2) + 1e-9)
    crosses = (F.col("ay") > F.col("_yb")) != (F.col("by") > F.col("_yb"))
    e = e.withColumn("_xb", F.when(crosses, x_of(F.col("_yb")))).withColumn("_gx", F.explode(F.sequence(at(first), at(last))))
    here = F.coalesce(at(F.col("_xb")) == F.col("_gx"), F.lit(False))
    right = here & (F.col("_xb") > F.col("_gx") * size)
    touched = e.groupBy("_pid", "_gx", "_gy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_edges"), F.count(F.when(here, 1)).alias("_all"), F.count(F.when(right, 1)).alias("_right"))
    row = Window.partitionBy("_pid", "_gy").orderBy(F.desc("_gx"))
    beyond = F.coalesce(F.sum("_all").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    touched = touched.withColumns({"_beyond": beyond, "_next": F.lag("_gx").over(row)})
    whole = touched.where((F.col("_beyond") % 2 == 1) & (F.col("_next") > F.col("_gx") + 1)).select(
        "_pid", F.explode(F.sequence(F.col("_gx") + 1, F.col("_next") - 1)).alias("_gx"), "_gy", F.array().cast(touched.schema["_edges"].dataType).alias("_edges"), F.lit(True).alias("_odd"))
    cells = touched.select("_pid", "_gx", "_gy", "_edges", ((F.col("_beyond") + F.col("_right")) % 2 == 1).alias("_odd")).unionByName(whole)
    return cells.join(p.drop("rings"), "_pid").drop("_pid").withColumn("_size", F.lit(size))


def in_cell() -> Column:
    """Whether a point (lon, lat) of a clipped cell is inside: borders met on the way from the corner up and then right change the parity."""
    x, y, left, base = F.col("lon"), F.col("lat"), F.col("_gx") * F.col("_size"), F.col("_gy") * F.col("_size")

    def up(e):
        at = e["ay"] + (left - e["ax"]) * (e["by"] - e["ay"]) / F.nullif(e["bx"] - e["ax"], F.lit(0.0))
        return ((e["ax"] > left) != (e["bx"] > left)) & (at > base) & (at <= y)

    def along(e):
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return ((e["ay"] > y) != (e["by"] > y)) & (at > left) & (at <= x)

    met = F.aggregate("_edges", F.lit(0), lambda n, e: n + F.when(up(e), 1).otherwise(0) + F.when(along(e), 1).otherwise(0))
    return (met % 2 == 1) != F.col("_odd")


def point_in_polygon(points: DataFrame, polys: DataFrame, *, size: float = CELL_DEG, closed: bool = False) -> DataFrame:
    """(location, polygon) pairs with the point inside; `closed` counts the border as inside.

    `points` needs lon/lat, `polys` a `rings` column; the result has one row per
    distinct location and containing polygon. A location meets only the edges
    of its own cell (`clipped_cells`).
    """
    cells = clipped_cells(polys, size)
    locs = locations(points).withColumn("_size", F.lit(2.0 ** round(math.log2(size))))
    locs = locs.select("lon", "lat", F.floor(F.col("lon") / F.col("_size")).alias("_gx"), F.floor(F.col("lat") / F.col("_size")).alias("_gy"))
    hit = in_cell()
    if closed:
        pairs = F.transform("_edges", lambda e: F.array(F.struct(e["ax"].alias("x"), e["ay"].alias("y")), F.struct(e["bx"].alias("x"), e["by"].alias("y"))))
        hit = hit | sp.on_boundary(pairs, "lon", "lat")
    return locs.join(cells, ["_gx", "_gy"]).where(hit).drop("_gx", "_gy", "_edges", "_odd", "_size")


def one_polygon(points: DataFrame, polys: DataFrame, pick: str, keep: list[str], **kw) -> DataFrame:
    """Attach the columns `keep` of the containing polygon with the smallest `pick`; null where none."""
    hits = point_in_polygon(points, polys, **kw).groupBy("lon", "lat").agg(
        F.min_by(F.struct(*keep), pick).alias("_p"))
    return join_on(points, hits, ["lon", "lat"], "left").select(*points.columns, *[F.col(f"_p.{k}").alias(k) for k in keep])


def nearest_polygon(locs: DataFrame, polys: DataFrame, *, poly_id: str, step_m: float = 1000.0, max_lat: float = MAX_LAT) -> DataFrame:
    """Nearest polygon by edge distance for locations outside all polygons.

    The nearest polygon *sample point* gives an upper bound of the edge
    distance; every polygon with an edge closer than that bound is then found by
    matching the location's search box against the polygons' grid cells.
    """
    verts = polys.select(poly_id, F.explode(F.flatten(F.col("rings"))).alias("v")).select(
        poly_id, F.col("v.x").alias("flon"), F.col("v.y").alias("flat"))
    up = nearest(locs, verts, 1, fid=poly_id, max_lat=max_lat).select("lon", "lat", F.col("dist").alias("_ub"))
    size = step_m / sp.METRES_PER_DEGREE
    # The bound is widened a little: edges are measured in a tangent plane.
    reach = F.col("_ub") * 1.02 / (sp.METRES_PER_DEGREE * F.cos(F.radians(F.lit(max_lat))))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    probe = up.withColumn("_gx", span("lon")).withColumn("_gy", span("lat"))
    cand = probe.join(polygon_cells(polys, size), ["_gx", "_gy"]).dropDuplicates(["lon", "lat", poly_id])
    cand = cand.withColumn("dist", F.round(sp.edge_distance(F.col("rings"), "lon", "lat"), 3))
    return cand.groupBy("lon", "lat").agg(F.min_by(F.struct(poly_id, "dist"), F.struct("dist", poly_id)).alias("_p")).select(
        "lon", "lat", F.col(f"_p.{poly_id}").alias(poly_id), F.col("_p.dist").alias("dist"))


def grid_counts(features: DataFrame, keys: dict[str, Column], step: float, x0: float, y0: float, nx: int, ny: int) -> DataFrame:
    """Counts per square cell of a fixed extent; empty cells stay with zeros."""
    cells = features.select(F.floor((F.col("lon") - x0) / step).alias("gx"), F.floor((F.col("lat") - y0) / step).alias("gy"),
                            *[c.alias(n) for n, c in keys.items()])
    agg = cells.groupBy("gx", "gy").agg(F.count("*").alias("total"),
                                        *[F.count(F.when(F.col(n), 1)).alias(n) for n in keys])
    # The frame is nx * ny generated rows, fixed by the caller.
    frame = features.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("gx"), F.floor(F.col("id") / nx).alias("gy"))
    return frame.join(agg, ["gx", "gy"], "left").fillna(0)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def assign_zones(points: DataFrame, polys: DataFrame, poly_id: str, carry: list[str] = ()) -> DataFrame:
    """Containing polygon, else the nearest one; `path` tells which, null for points without location."""
    keep = [poly_id, *carry]
    inside = point_in_polygon(points, polys).groupBy("lon", "lat").agg(F.min(poly_id).alias(poly_id))
    locs = locations(points)
    left = locs.join(inside.select("lon", "lat"), ["lon", "lat"], "left_anti")
    near = nearest_polygon(left, polys, poly_id=poly_id).select("lon", "lat", poly_id)
    both = inside.withColumn("path", F.lit("inside")).unionByName(near.withColumn("path", F.lit("nearest")))
    out = join_on(points.drop(*[k for k in keep if k in points.columns]), both, ["lon", "lat"], "left")
    return out.join(polys.select(*keep).distinct(), poly_id, "left") if carry else out


def zone_parents(inner: DataFrame, outer: DataFrame, inner_id: str, keep: list[str], pick: str) -> DataFrame:
    """Outer polygon holding an interior point of each inner polygon."""
    x, y = sp.interior_point(F.col("rings"))
    pts = inner.select(inner_id, x.alias("lon"), y.alias("lat"))
    return one_polygon(pts, outer, pick, keep).drop("lon", "lat")


def simplified(polys: DataFrame, tol: float) -> DataFrame:
    """Polygons with rings simplified by Douglas-Peucker; `tol` in the units of the coordinates."""
    return polys.withColumn("rings", sp.simplify(F.col("rings"), tol))
