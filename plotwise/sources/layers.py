"""City layers from GeoJSON, ESRI JSON and CSV files, and their way back out.

Files with one feature per line are split and read in parallel; a document that
holds a whole FeatureCollection is read by one task, as its format demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwise.functions import spatial as sp
from plotwise.operators.geo import union_all

# Property keys tried for a name, columns tried for coordinates, bounds, tag filters.
NAME_KEYS = ["nombre", "NOMBRE", "name", "Nombre_IPS", "NOMBRE_SEDE", "NOMBRE_BIBLORED", "NOMBRE_PARQUE"]
SCHOOL_KEYS = ["NOMBRE_EST", "NOMBRE_SED", "nombre"]
LAT_COLUMNS = ["latitud", "Latitud", "LAT"]
LON_COLUMNS = ["longitud", "Longitud", "LON"]
CSV_NAMES = ["nombre", "NOMBRE", "Nombre"]
NO_NAME = "Sin nombre"
BOUNDS = {"lat": (3.0, 6.0), "lon": (-75.0, -73.0)}
OSM_VIEWS = {
    "education": [("amenity", ["school", "university", "college", "kindergarten"], "both")],
    "health": [("amenity", ["hospital", "clinic", "doctors", "pharmacy", "dentist"], "both")],
    "transport": [("highway", ["bus_stop"], "point"), ("railway", ["station", "subway_entrance"], "point"), ("amenity", ["bus_station"], "both"), ("railway", ["station"], "polygon")],
    "parks": [("leisure", ["park", "garden", "pitch", "playground", "sports_centre", "stadium"], "polygon"), ("landuse", ["grass", "recreation_ground"], "polygon")],
    "commercial": [("shop", ["supermarket", "mall", "department_store"], "both"), ("amenity", ["marketplace"], "both")],
    "roads": [("highway", ["motorway", "trunk", "primary", "secondary", "tertiary"], "line")]}

_FEATURE = "struct<properties:map<string,string>,attributes:map<string,string>,geometry:struct<type:string,coordinates:string,rings:string,x:double,y:double>>"
_RING = "array<array<double>>"


def read_features(spark: SparkSession, path: str, per_line: bool = True) -> DataFrame:
    """(props, geometry) rows of a GeoJSON or ESRI layer."""
    inner = _FEATURE[len("struct<"):-1]
    if per_line:
        d = spark.read.schema(T._parse_datatype_string(_FEATURE)).json(path)
    else:
        whole = T._parse_datatype_string(f"struct<features:array<struct<{inner}>>>")
        d = spark.read.option("multiLine", True).schema(whole).json(path).select(F.explode("features").alias("f")).select("f.*")
    return d.select(F.coalesce("properties", "attributes").alias("props"), "geometry")


def first_key(keys: list[str]) -> Column:
    """First non-empty property of the list."""
    return F.coalesce(*[F.when(F.try_element_at("props", F.lit(k)) != "", F.try_element_at("props", F.lit(k))) for k in keys])


def with_rings(features: DataFrame) -> DataFrame:
    """Rings of polygons and multi-polygons of either dialect; null for points."""
    pts = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    g = F.col("geometry")
    poly = F.from_json(F.coalesce(g["rings"], F.when(g["type"] == "Polygon", g["coordinates"])), f"array<{_RING}>")
    multi = F.flatten(F.from_json(F.when(g["type"] == "MultiPolygon", g["coordinates"]), f"array<array<{_RING}>>"))
    return features.withColumn("rings", pts(F.coalesce(poly, multi)))


def with_points(features: DataFrame) -> DataFrame:
    """lon/lat of points, or of the centroid of the largest ring."""
    d = with_rings(features)
    g = F.col("geometry")
    xy = F.from_json(F.when(g["type"] == "Point", g["coordinates"]), "array<double>")
    # The ring with the most area stands for the polygon.
    d = d.withColumn("_ring", F.element_at(F.array_sort(F.transform("rings", lambda r: F.struct(F.abs(sp.ring_area(r)).alias("a"), r.alias("r")))), -1)["r"])
    cx, cy = sp.ring_centroid(F.col("_ring"))
    return d.withColumns({"lon": F.coalesce(F.get(xy, 0), g["x"], cx), "lat": F.coalesce(F.get(xy, 1), g["y"], cy)}).drop("_ring")


def reproject(d: DataFrame, crs: str) -> DataFrame:
    """Points to lon/lat. `auto` treats large coordinates as the city grid."""
    if crs == "lonlat":
        return d
    if crs == "mercator":
        lon, lat = sp.mercator_to_lonlat("lon", "lat")
        return d.withColumns({"lon": lon, "lat": lat})
    lon, lat = sp.CITY_GRID.inverse("lon", "lat")
    big = F.abs("lon") > 1000 if crs == "auto" else F.lit(True)
    return d.withColumns({"lon": F.when(big, lon).otherwise(F.col("lon")), "lat": F.when(big, lat).otherwise(F.col("lat"))})


def reproject_rings(d: DataFrame) -> DataFrame:
    """Rings to lon/lat where their coordinates are too large for degrees."""
    def point(p):
        lon, lat = sp.CITY_GRID.inverse(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    big = F.abs(F.get(F.get("rings", 0), 0)["x"]) > 1000
    return d.withColumn("rings", F.when(big, F.transform("rings", lambda r: F.transform(r, point))).otherwise(F.col("rings")))


def checked(d: DataFrame) -> DataFrame:
    """`ok`: the point is inside the country's rough bounds."""
    inside = [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in BOUNDS.items()]
    return d.withColumn("ok", F.coalesce(inside[0] & inside[1], F.lit(False)))


def poi_layer(features: DataFrame, category: str, source: str, keys: list[str] = NAME_KEYS, crs: str = "lonlat", missing: str = NO_NAME) -> DataFrame:
    """Points of interest with their check; keep `ok` rows, report the others."""
    d = checked(reproject(with_points(features), crs))
    return d.select(F.coalesce(first_key(keys), F.lit(missing)).alias("name"), F.lit(category).alias("category"), F.lit(source).alias("source"), "props", "lon", "lat", "ok")


def csv_layer(spark: SparkSession, path: str, category: str, source: str, lat: str, lon: str, name: str, encoding: str = "UTF-8", keep: list[str] = ()) -> DataFrame:
    """Points from a CSV with decimal commas and varying column names."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)

    def first(cols):
        have = [c for c in cols if c in raw.columns]
        return F.coalesce(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in have]) if have else F.lit(None).cast("string")

    num = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    d = raw.select(F.coalesce(first([name, *CSV_NAMES]), F.lit(NO_NAME)).alias("name"), F.lit(category).alias("category"), F.lit(source).alias("source"),
                   num(first([lon, *LON_COLUMNS])).alias("lon"), num(first([lat, *LAT_COLUMNS])).alias("lat"), *[F.col(f"`{k}`") for k in keep])
    return checked(d)


def polygon_layer(features: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Polygons with chosen attributes, each from the first of its keys."""
    d = reproject_rings(with_rings(features)).where(F.size("rings") > 0)
    return d.select(*[first_key(keys).alias(n) for n, keys in columns.items()], "rings")


def osm_view(objects: DataFrame, view: str) -> DataFrame:
    """Thematic view over tagged objects; `shape` is point, line or polygon."""
    parts = []
    for tag, values, shape in OSM_VIEWS[view]:
        m = F.col(tag).isin(values)
        m = m & (F.col("shape").isin("point", "polygon") if shape == "both" else F.col("shape") == shape)
        parts.append(F.coalesce(m, F.lit(False)))
    hit = parts[0]
    for p in parts[1:]:
        hit = hit | p
    return objects.where(hit)


def park_buffers(points: DataFrame, radius: str) -> DataFrame:
    """Circle polygons around park points."""
    return points.withColumn("rings", F.array(sp.circle("lon", "lat", F.col(radius))))


# --------------------------------------------------------------------- out


def feature_json(df: DataFrame, props: list[str], geometry: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry")))


def point_geometry(lon: str = "lon", lat: str = "lat") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def ring_geometry(rings: str = "rings") -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def write_features(df: DataFrame, props: list[str], geometry: Column, path: str) -> None:
    """One feature per line, written in parallel; the form for large layers."""
    df.select(feature_json(df, props, geometry).alias("value")).write.mode("overwrite").text(path)


def feature_collections(df: DataFrame, key: Column, props: list[str], geometry: Column, most: int = 10_000) -> DataFrame:
    """One FeatureCollection document per key, split into documents of at most about `most` features.

    The parts keep a document small enough for one task whatever the key's size.
    """
    f = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))
    d = df.withColumn("_key", key)
    sizes = d.groupBy("_key").agg(F.ceil(F.count("*") / most).alias("_parts"))
    d = d.join(sizes, "_key").withColumn("_part", F.pmod(F.xxhash64(*props), F.col("_parts")))
    docs = d.groupBy("_key", "_part").agg(F.sort_array(F.collect_list(F.struct(F.struct(*props).alias("o"), f.alias("f")))).alias("fs"))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features")))
    return docs.select(F.col("_key").alias("key"), F.col("_part").alias("part"), F.size("fs").alias("n"), doc.alias("geojson"))


def replace_layer(df: DataFrame, path: str, layer: str) -> None:
    """Truncate-and-replace of one layer, the other layers untouched."""
    df.withColumn("layer", F.lit(layer)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def load_if_empty(spark: SparkSession, df: DataFrame, path: str, layer: str) -> bool:
    """Load a layer unless it already has rows; tells whether it did."""
    try:
        full = not spark.read.parquet(path).where(F.col("layer") == layer).isEmpty()
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        full = False
    if not full:
        replace_layer(df, path, layer)
    return not full


def layer_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("layer").agg(F.count("*").alias("n"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["union_all"]
