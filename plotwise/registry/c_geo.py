"""Spatial joins and grids."""

import math

from pyspark.sql import functions as F

from plotwise.fixtures import sql_haversine
from plotwise.functions import spatial as sp
from plotwise.operators import geo
from plotwise.operators.ranking import row_numbers
from plotwise.registry.core import query

c = F.col
HAV = sql_haversine("a", "b")
# A box that surely holds everything within `m` metres in the study area.
BOX = lambda m: f"b.lat BETWEEN a.lat-{m / 110000} AND a.lat+{m / 110000} AND b.lon BETWEEN a.lon-{m / 110000} AND a.lon+{m / 110000}"
KX, KY = "(cos(radians(4.65e0))*pi()*6371000.0e0/180)", "(pi()*6371000.0e0/180)"
PLAN = f"sqrt(pow((b.lon-a.lon)*{KX},2)+pow((b.lat-a.lat)*{KY},2))"
MANH = f"(abs((b.lon-a.lon)*{KX})+abs((b.lat-a.lat)*{KY}))"
INSIDE = "a.lon >= b.x0 AND a.lon < b.x1 AND a.lat >= b.y0 AND a.lat < b.y1"


@query("dist_1_haversine", f"SELECT a.id, b.station_id, round({HAV}, 3) AS metres FROM listing a JOIN station b ON true WHERE a.lon IS NOT NULL AND {HAV} <= 3000")
def _(v):
    s = geo.as_features(v.station.select("station_id", "lon", "lat"))
    return geo.radius_pairs(v.listing.select("id", "lon", "lat"), s, 3000).select("id", "station_id", F.round("dist", 3).alias("metres"))


@query("dist_2_planar", f"SELECT a.id, b.station_id, round({PLAN}, 3) AS straight, round({MANH}, 3) AS manhattan FROM listing a JOIN station b ON true WHERE a.lon IS NOT NULL AND {PLAN} <= 2000")
def _(v):
    s = geo.as_features(v.station.select("station_id", "lon", "lat"))
    return geo.radius_pairs(v.listing.select("id", "lon", "lat"), s, 2000, planar=True).select(
        "id", "station_id", F.round("dist", 3).alias("straight"), F.round("manhattan", 3).alias("manhattan"))


@query("cen_1_centroids", "SELECT barrio_id, round((x0+x1)/2, 9) AS cx, round((y0+y1)/2, 9) AS cy, round((x0+x1)/2, 9) AS px, round((y0+y1)/2, 9) AS py, round((x1-x0)*(y1-y0), 12) AS area FROM barrio")
def _(v):
    cx, cy = sp.ring_centroid(F.get("rings", 0))
    px, py = sp.interior_point(c("rings"))
    r = lambda e, n, d=9: F.round(e, d).alias(n)
    return v.barrio.select("barrio_id", r(cx, "cx"), r(cy, "cy"), r(px, "px"), r(py, "py"), r(sp.ring_area(F.get("rings", 0)), "area", 12))


@query("buf_1_circles", """SELECT poi_id, i AS vertex, round(lon + 250*cos((i%32)*2*pi()/32)/(cos(radians(lat))*pi()*6371000.0e0/180), 9) AS x,
  round(lat + 250*sin((i%32)*2*pi()/32)/(pi()*6371000.0e0/180), 9) AS y FROM poi, range(33) r(i) WHERE category='parque'""")
def _(v):
    d = v.poi.where("category = 'parque'").select("poi_id", F.posexplode(sp.circle("lon", "lat", F.lit(250.0))).alias("vertex", "p"))
    return d.select("poi_id", c("vertex").cast("long").alias("vertex"), F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query("pip_1_point_in_zone", f"SELECT a.id, b.zone_id FROM listing a JOIN zone b ON {INSIDE}")
def _(v):
    hits = geo.point_in_polygon(v.listing, v.zone.select("zone_id", "rings"))
    return v.listing.select("id", "lon", "lat").join(hits, ["lon", "lat"]).select("id", "zone_id")


@query("pip_1_closed_border", "SELECT a.id, b.zone_id FROM listing a JOIN zone b ON a.lon >= b.x0 AND a.lon <= b.x1 AND a.lat >= b.y0 AND a.lat <= b.y1")
def _(v):
    hits = geo.point_in_polygon(v.listing, v.zone.select("zone_id", "rings"), closed=True)
    return v.listing.select("id", "lon", "lat").join(hits, ["lon", "lat"]).select("id", "zone_id")


@query("pip_2_one_polygon", f"SELECT a.id, min(b.poly_id) AS poly_id FROM listing a LEFT JOIN (SELECT * FROM pot WHERE layer='treatment') b ON {INSIDE} GROUP BY a.id")
def _(v):
    return geo.one_polygon(v.listing.select("id", "lon", "lat"), v.pot.where("layer = 'treatment'"), "poly_id", ["poly_id"]).select("id", "poly_id")


_GAP = f"""sqrt(pow(greatest(b.x0-a.lon, 0, a.lon-b.x1)*cos(radians(a.lat))*{KY},2)+pow(greatest(b.y0-a.lat, 0, a.lat-b.y1)*{KY},2))"""


@query("pip_3_nearest_fallback", f"""i AS (SELECT a.id, min(b.barrio_id) AS barrio_id FROM listing a JOIN barrio b ON {INSIDE} GROUP BY 1),
  n AS (SELECT a.id, b.barrio_id FROM listing a JOIN barrio b ON true WHERE a.lon IS NOT NULL AND a.id NOT IN (SELECT id FROM i) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({_GAP},3), barrio_id)=1)
  SELECT id, barrio_id, 'inside' AS path FROM i UNION ALL SELECT id, barrio_id, 'nearest' FROM n UNION ALL SELECT id, NULL, NULL FROM listing WHERE lon IS NULL""")
def _(v):
    return geo.assign_zones(v.listing.select("id", "lon", "lat"), v.barrio, "barrio_id").select("id", "barrio_id", "path")


@query("pip_4_two_level_snap", f"""p AS (SELECT a.barrio_id, b.zone_id FROM (SELECT barrio_id, (x0+x1)/2 AS lon, (y0+y1)/2 AS lat FROM barrio) a JOIN zone b ON {INSIDE}),
  b1 AS (SELECT a.id, min(b.barrio_id) AS barrio_id FROM listing a JOIN barrio b ON {INSIDE} GROUP BY 1), z1 AS (SELECT a.id, min(b.zone_id) AS zone_id FROM listing a JOIN zone b ON {INSIDE} GROUP BY 1)
  SELECT l.id, b1.barrio_id, coalesce(p.zone_id, z1.zone_id) AS zone_id FROM listing l LEFT JOIN b1 USING (id) LEFT JOIN p ON p.barrio_id=b1.barrio_id LEFT JOIN z1 ON z1.id=l.id""")
def _(v):
    parents = geo.zone_parents(v.barrio, v.zone, "barrio_id", ["zone_id"], "zone_id").withColumnRenamed("zone_id", "_pz")
    d = geo.one_polygon(v.listing.select("id", "lon", "lat"), v.barrio, "barrio_id", ["barrio_id"]).join(parents, "barrio_id", "left")
    d = geo.one_polygon(d, v.zone, "zone_id", ["zone_id"])
    return d.select("id", "barrio_id", F.coalesce("_pz", "zone_id").alias("zone_id"))


@query("pip_5_zoning_overlay", "SELECT a.id, " + ", ".join(f"arg_min(b.value, b.poly_id) FILTER (b.layer='{n}') AS {n}" for n in ("treatment", "buildability", "activity"))
       + ", min(z.zone_id) AS unit FROM listing a LEFT JOIN pot b ON " + INSIDE + " LEFT JOIN zone z ON a.lon >= z.x0 AND a.lon < z.x1 AND a.lat >= z.y0 AND a.lat < z.y1 GROUP BY a.id")
def _(v):
    from plotwise.operators.indicators import zoning_overlay

    layers = v.pot.unionByName(v.zone.select(F.lit("unit").alias("layer"), c("zone_id").alias("poly_id"), c("zone_id").cast("string").alias("value"), "rings"), allowMissingColumns=True)
    d = zoning_overlay(v.listing.select("id", "lon", "lat"), layers, ["treatment", "buildability", "activity", "unit"])
    return d.select("id", "treatment", "buildability", "activity", c("unit").cast("long").alias("unit"))


@query("rng_1_pairs_within", f"SELECT a.id, b.poi_id, round({HAV}, 3) AS dist FROM listing a JOIN poi b ON {BOX(800)} WHERE {HAV} <= 800")
def _(v):
    p = geo.as_features(v.poi.select("poi_id", "lon", "lat"))
    return geo.radius_pairs(v.listing.select("id", "lon", "lat"), p, 800).select("id", "poi_id", F.round("dist", 3).alias("dist"))


_CTX = {"health": ("ips", "farmacia"), "education": ("colegio", "universidad"), "recreation": ("parque", "cancha")}


@query("rng_2_context_counts", "SELECT l.id, " + ", ".join(f"coalesce({g}, 0) AS {g}" for g in _CTX) + ", coalesce(t, 0) AS transit FROM listing l LEFT JOIN (SELECT a.id, "
       + ", ".join(f"count(*) FILTER (b.category IN {cs}) AS {g}" for g, cs in _CTX.items()) + f" FROM listing a JOIN poi b ON {BOX(500)} WHERE {HAV} <= 500 GROUP BY 1) x ON x.id=l.id"
       + f" LEFT JOIN (SELECT a.id, count(*) AS t FROM listing a JOIN station b ON {BOX(500)} AND b.layer='transmilenio' WHERE {HAV} <= 500 GROUP BY 1) y ON y.id=l.id")
def _(v):
    feats = v.poi.select("category", "lon", "lat").unionByName(v.station.select(c("layer").alias("category"), "lon", "lat"))
    cnt = lambda cs: F.coalesce(F.sum(F.when(c("category").isin(*cs), c("mult"))), F.lit(0))
    aggs = {g: cnt(cs) for g, cs in _CTX.items()} | {"transit": cnt(["transmilenio"])}
    return geo.radius_aggregate(v.listing.select("id", "lon", "lat"), feats, 500, aggs, ["category"], {g: 0 for g in aggs}).drop("lon", "lat")


@query("rng_3_category_summary", f"SELECT a.id, b.category, count(*) AS n, round(min({HAV}), 3) AS closest FROM listing a JOIN poi b ON {BOX(1000)} WHERE {HAV} <= 1000 GROUP BY 1,2")
def _(v):
    f = geo.stack_features(v.poi, ["category"])
    near = geo.radius_pairs(geo.locations(v.listing), f, 1000).groupBy("lon", "lat", "category").agg(F.sum("mult").alias("n"), F.round(F.min("dist"), 3).alias("closest"))
    return v.listing.select("id", "lon", "lat").join(near, ["lon", "lat"]).drop("lon", "lat")


@query("rng_4_nearby_per_category", f"SELECT a.study_id, b.category, b.poi_id, round({HAV}, 3) AS dist FROM study a JOIN poi b ON {BOX(3000)} WHERE {HAV} <= 3000 QUALIFY row_number() OVER (PARTITION BY a.study_id, b.category ORDER BY round({HAV},3), b.poi_id) <= 10")
def _(v):
    f = geo.as_features(v.poi.select("poi_id", "category", "lon", "lat"))
    p = geo.nearest_per_key(v.study.select("study_id", "lon", "lat"), f, 10, ident="study_id", fid="poi_id", key="category", within=3000.0)
    return row_numbers(p, ["study_id", "category"], ["dist", "poi_id"], limit=10).select("study_id", "category", "poi_id", "dist")


@query("rng_5_neighbour_average", f"""SELECT a.study_id, round(coalesce(avg(s.security), 3.0), 9) AS security, round(any_value(coalesce(h.d, 3.0)), 9) AS dwelling FROM study a LEFT JOIN scored s ON
  s.lat BETWEEN a.lat-0.0095 AND a.lat+0.0095 AND s.lon BETWEEN a.lon-0.0095 AND a.lon+0.0095 AND {sql_haversine('a', 's')} <= 1000 AND s.security IS NOT NULL
  LEFT JOIN (SELECT a.study_id, avg(b.dwelling) AS d FROM study a JOIN scored b ON {BOX(500)} WHERE {HAV} <= 500 GROUP BY 1) h ON h.study_id=a.study_id GROUP BY a.study_id""")
def _(v):
    d = geo.neighbour_average(v.study.select("study_id", "lon", "lat"), v.scored, "security", 1000.0, "security", 3.0)
    d = geo.neighbour_average(d, v.scored, "dwelling", 500.0, "dwelling", 3.0)
    return d.select("study_id", F.round("security", 9).alias("security"), F.round("dwelling", 9).alias("dwelling"))


@query("knn_1_nearest_station", f"SELECT a.id, b.station_id, round({HAV}, 3) AS dist FROM listing a JOIN station b ON true WHERE a.lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({HAV},3), station_id)=1")
def _(v):
    near = geo.nearest(v.listing, geo.as_features(v.station.select("station_id", "lon", "lat")), 1, fid="station_id").select("lon", "lat", "station_id", "dist")
    return v.listing.select("id", "lon", "lat").join(near, ["lon", "lat"]).select("id", "station_id", "dist")


@query("knn_2_k_nearest_in_radius", f"SELECT a.id, b.poi_id, round({HAV}, 3) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round({HAV},3), poi_id) AS rn FROM listing a JOIN poi b ON {BOX(1500)} WHERE {HAV} <= 1500 QUALIFY rn <= 10")
def _(v):
    f = geo.as_features(v.poi.select("poi_id", "lon", "lat"))
    near = geo.nearest(v.listing, f, 10, fid="poi_id", within=1500.0, levels=7).select("lon", "lat", "poi_id", "dist", c("rn").cast("long").alias("rn"))
    return v.listing.select("id", "lon", "lat").join(near, ["lon", "lat"]).select("id", "poi_id", "dist", "rn")


@query("knn_3_neighbour_price_ratio", f"""d AS (SELECT id, lon, lat, price/area AS x FROM listing WHERE lon IS NOT NULL AND area > 0),
  n AS (SELECT a.id, a.x, b.x AS y, row_number() OVER (PARTITION BY a.id ORDER BY round({HAV},3), b.id) AS rn FROM d a JOIN d b ON {BOX(5500)})
  SELECT id, round(any_value(x)/avg(y), 6) AS ratio, round(least(5.0e0, greatest(0.0e0, 5-(any_value(x)/avg(y)-1)*5)), 6) AS dwelling_gap FROM n WHERE rn <= 20 GROUP BY id""")
def _(v):
    from plotwise.operators.indicators import price_gap_score

    return price_gap_score(v.listing).select("id", F.round("ratio", 6).alias("ratio"), F.round("dwelling_gap", 6).alias("dwelling_gap"))


@query("grd_1_square_grid", """SELECT g AS gx, h AS gy, count(poi_id) AS total, count(*) FILTER (category IN ('ips','farmacia')) AS health, count(*) FILTER (category IN ('colegio','universidad')) AS education
  FROM range(20) a(g) CROSS JOIN range(50) b(h) LEFT JOIN poi ON CAST(floor((lon+74.2e0)/0.01e0) AS BIGINT)=g AND CAST(floor((lat-4.4e0)/0.01e0) AS BIGINT)=h GROUP BY 1,2""")
def _(v):
    keys = {"health": c("category").isin("ips", "farmacia"), "education": c("category").isin("colegio", "universidad")}
    return geo.grid_counts(v.poi, keys, 0.01, -74.2, 4.4, 20, 50)


# A circle of 64 chords keeps every fourth vertex at a tolerance between the sagittas of two and four chords' halves.
@query("simp_1_circles", f"""SELECT poi_id, i AS vertex, round(lon + 400*cos(((4*i)%64)*2*pi()/64)/(cos(radians(lat))*{KY}), 9) AS x, round(lat + 400*sin(((4*i)%64)*2*pi()/64)/{KY}, 9) AS y FROM poi, range(17) r(i) WHERE category='parque'""")
def _(v):
    ring = v.poi.where("category = 'parque'").select("poi_id", F.array(sp.circle("lon", "lat", F.lit(400.0), 64)).alias("rings"))
    d = geo.simplified(ring, 400 * (1 - math.cos(math.pi / 16)) * 1.2 / sp.METRES_PER_DEGREE).select("poi_id", F.posexplode(F.get("rings", 0)).alias("vertex", "p"))
    return d.select("poi_id", c("vertex").cast("long").alias("vertex"), F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


# Zone outlines with eight points a side that leave it by less than the tolerance: the corners stay.
@query("simp_1_simplified_zones", "SELECT zone_id, i AS vertex, round(CASE WHEN i IN (1, 2) THEN x1 ELSE x0 END, 9) AS x, round(CASE WHEN i IN (2, 3) THEN y1 ELSE y0 END, 9) AS y FROM zone, range(5) r(i)")
def _(v):
    box = sp.bbox(c("rings"))
    z = v.zone.select("zone_id", box.alias("b"))
    at = lambda i, x, y, dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    w, h, k = c("b.x1") - c("b.x0"), c("b.y1") - c("b.y0"), F.lit(0.0002)
    off = lambda i: (i % 3 - 1) * k * (i % 8 != 0).cast("int")
    side = lambda i: F.floor(i / 8)
    part = lambda i: (i % 8) / 8.0
    point = lambda i: (F.when(side(i) == 0, at(i, c("b.x0"), c("b.y0"), w * part(i), off(i))).when(side(i) == 1, at(i, c("b.x1"), c("b.y0"), off(i), h * part(i)))
                       .when(side(i) == 2, at(i, c("b.x1"), c("b.y1"), -w * part(i), off(i))).when(side(i) == 3, at(i, c("b.x0"), c("b.y1"), off(i), -h * part(i))).otherwise(at(i, c("b.x0"), c("b.y0"), F.lit(0.0), F.lit(0.0))))
    ring = z.select("zone_id", F.array(F.transform(F.sequence(F.lit(0), F.lit(32)), point)).alias("rings"))
    d = geo.simplified(ring, 0.0005).select("zone_id", F.posexplode(F.get("rings", 0)).alias("vertex", "p"))
    return d.select("zone_id", c("vertex").cast("long").alias("vertex"), F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))
