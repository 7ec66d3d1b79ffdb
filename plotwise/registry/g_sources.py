"""Sources, sinks, streams, and the whole job."""

from pyspark.sql import functions as F

from plotwise.fixtures import SCORES, pick
from plotwise.functions import spatial as sp
from plotwise.operators import geo
from plotwise.operators import indicators as ind
from plotwise.operators import upsert as up
from plotwise.registry.core import query
from plotwise.registry.d_indicators import sectors, zone_mass  # noqa: F401
from plotwise.session import fresh_path, stage
from plotwise.sources import layers as ly
from plotwise.sources import listings as ls
from plotwise.streaming import jobs as st

c = F.col
R = lambda n, d=6: F.round(c(n), d).alias(n)

# --------------------------------------------------------------- documents

KINDS_RAW = ["Apartamento", "casa campestre", "LOTE", "Oficina", "local comercial"]


def raw_documents(v):
    """Every listing as a raw document of one of the seven shapes."""
    l = v.listing
    kind = pick(KINDS_RAW, F.substring("kind", 1, 1).cast("int") - 1)
    p = c("price")
    dots = F.concat(F.lit("$ "), F.regexp_replace(F.format_number(p, 0), ",", "."))
    m2 = F.concat(F.regexp_replace(c("area").cast("string"), r"\.", ","), F.lit(" m²"))
    code = c("code")
    s = lambda **kw: F.to_json(F.struct(*[x.alias(n) for n, x in kw.items()]))
    shapes = [
        s(codigo_fr=code, precio=dots, area_construida=m2, habitaciones=c("rooms"), banos=c("baths"), garajes=c("garages"), estrato=c("stratum"), tipo_de_inmueble=kind, ubicacion=c("place"), latitud=c("lat"), longitud=c("lon"), caracteristicas=F.array(F.lit("Piscina"), F.lit("Gas"))),
        F.to_json(F.struct(code.alias("codigo_fr"), p.alias("precio"), c("area").alias("Área Construida"), c("rooms").alias("Habitaciones"), c("baths").alias("Baños"), c("stratum").cast("string").alias("Estrato"), kind.alias("Tipo de Inmueble"), c("place").alias("ubicacion"), c("lat").alias("lat"), c("lon").alias("lon"))),
        s(codigo_habi=code, precio=dots, area=c("area"), habitaciones=F.concat(c("rooms").cast("string"), F.lit(" alcobas")), banos=c("baths"), estrato=c("stratum"), ascensor=F.lit("Si"), piscina=F.lit("No"), lugar=c("place"), latitud=c("lat"), longitud=c("lon")),
        s(id=code, price=F.floor(p / 4200), currency=F.lit("USD"), surface_covered_in_m2=c("area"), bedrooms=c("rooms"), bathrooms=c("baths"), property_type=F.lit("house"), operation=F.lit("sell"), place_with_parent_names=F.concat(c("place"), F.lit(" | X")), lat=c("lat"), lon=c("lon")),
        s(codigo=code, precio_venta=p, area=c("area"), habitaciones=c("rooms"), banos=c("baths"), garajes=c("garages"), estrato=c("stratum"), tipo=kind, ciudad=c("city"), barrio=F.lit("centro"), lat=c("lat"), lon=c("lon")),
        s(codigo_sae=code, precio_base=dots, area=m2, habitaciones=c("rooms"), banos=c("baths"), tipo=kind, ubicacion=c("place"), lat=c("lat").cast("string"), lon=c("lon").cast("string")),
        s(codigo_ciencuadras=code, precio=p, area=c("area"), habitaciones=c("rooms"), banos=c("baths"), garajes=c("garages"), estrato=c("stratum"), tipo_inmueble=kind, tipo_operacion=F.lit("Arriendo"), ubicacion=c("place"), lat=c("lat"), lon=c("lon")),
    ]
    doc = None
    for i, x in enumerate(shapes):
        doc = F.when(c("id") % 7 == i, x) if doc is None else doc.when(c("id") % 7 == i, x)
    return stage(l.select("id", doc.alias("doc"), pick(ls.FORMATS, c("id") % 7).alias("fmt"), c("listed").alias("at")), "documents")


_SITE = "(['finca_raiz','finca_raiz','habi','properati','bancolombia_reo','sae','ciencuadras'])[CAST(id%7 AS INT)+1]"
_KN = "(['Apartamento','Casa','Lote','Oficina','Local'])[CAST(substr(kind,1,1) AS INT)]"


@query("cln_1_listing_normalizer", f"""SELECT code, {_SITE} AS site, CASE id%7 WHEN 3 THEN price//4200*4200 ELSE price END AS price, area, rooms, baths, CASE id%7 WHEN 0 THEN nullif(garages, 0) WHEN 4 THEN garages WHEN 6 THEN garages END AS garages, CASE WHEN id%7 NOT IN (3,5) THEN stratum END AS stratum,
  CASE id%7 WHEN 2 THEN 'Apartamento' WHEN 3 THEN 'Casa' ELSE {_KN} END AS kind, (['Venta','Venta','Venta','Venta','REO','Subasta','Arriendo'])[CAST(id%7 AS INT)+1] AS operation, CASE id%7 WHEN 4 THEN concat(city, ', centro') ELSE place END AS place,
  lat, lon, CASE id%7 WHEN 0 THEN 'Piscina,Gas' WHEN 2 THEN 'Ascensor' ELSE '' END AS amenities FROM listing""")
def _(v):
    d = ls.normalize_all(raw_documents(v))
    return d.select("code", "site", "price", "area", "rooms", "baths", "garages", "stratum", "kind", "operation", "place", "lat", "lon", F.array_join("amenities", ",").alias("amenities"))


_COLL = ["apartamentos_venta", "casas_arriendo", "habi_newera", "properati_raw", "reo_raw", "sae_raw", "bogota_locales_venta"]


@query("src_9_collections", "SELECT (['apartamentos_venta','casas_arriendo','habi_newera','properati_raw','reo_raw','sae_raw','bogota_locales_venta'])[CAST(id%7 AS INT)+1] AS collection, CASE id%7 WHEN 0 THEN 'Apartamento' WHEN 1 THEN 'Casa' WHEN 2 THEN 'Apartamento' END AS source_type, "
       "CASE WHEN id%7 IN (0,6) THEN 'Venta' WHEN id%7=1 THEN 'Arriendo' ELSE '' END AS operation, 'city' AS database, count(*) AS n FROM listing GROUP BY ALL")
def _(v):
    root = fresh_path(v.spark, "collections")
    d = raw_documents(v).select("doc", pick(_COLL, c("id") % 7).alias("collection"))
    for name in _COLL:  # seven fixed collections
        d.where(c("collection") == name).select(c("doc").alias("value")).write.text(f"{root}/city/{name}")
    return ls.read_collections(v.spark, root).groupBy("collection", "source_type", "operation", "database").agg(F.count("*").alias("n"))


@query("src_10_warehouse_newest", "SELECT id, price FROM listing WHERE city='city_1' AND kind='2-HIGH' AND site='F' ORDER BY listed DESC, id LIMIT 10000")
def _(v):
    return ls.newest(v.listing, (c("city") == "city_1") & (c("kind") == "2-HIGH") & (c("site") == "F"), "listed", "id").select("id", "price")


@query("src_11_survey_rows", "SELECT locality, stratum, count(*) AS n, sum(score)::BIGINT AS total FROM survey WHERE sex = 2 GROUP BY 1,2")
def _(v):
    path = fresh_path(v.spark, "survey")
    v.survey.write.option("header", True).csv(path)
    d = v.spark.read.schema(v.survey.schema).option("header", True).csv(path)
    return d.where("sex = 2").groupBy("locality", "stratum").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("src_12_freshness", "SELECT id%7 AS source, count(*) AS n, strftime(max(listed), '%Y-%m-%d') AS latest, strftime((SELECT max(listed) FROM listing), '%Y-%m-%d') AS latest_overall FROM listing GROUP BY 1")
def _(v):
    d = ls.freshness(v.listing.withColumn("source", c("id") % 7), ["source"], "listed")
    return d.select("source", "n", F.date_format("latest", "yyyy-MM-dd").alias("latest"), F.date_format("latest_overall", "yyyy-MM-dd").alias("latest_overall"))


# ------------------------------------------------------------------- layers


def written_points(v, lon="lon", lat="lat"):
    path = fresh_path(v.spark, "points")
    d = v.poi.withColumns({"NOMBRE_SEDE": F.when(c("poi_id") % 5 != 0, c("name")), "lon": F.when(c("poi_id") % 31 == 0, c("lon") + 10).otherwise(c("lon"))})
    ly.write_features(d, ["poi_id", "category", "NOMBRE_SEDE"], ly.point_geometry(), path)
    return path


@query("src_1_geojson_points", "SELECT poi_id, CASE WHEN poi_id%5<>0 THEN name ELSE 'Sin nombre' END AS name, round(CASE WHEN poi_id%31=0 THEN lon+10 ELSE lon END, 9) AS lon, round(lat, 9) AS lat, poi_id%31<>0 AS ok FROM poi")
def _(v):
    d = ly.poi_layer(ly.read_features(v.spark, written_points(v)), "any", "points.geojson")
    return d.select(c("props")["poi_id"].cast("long").alias("poi_id"), "name", R("lon", 9), R("lat", 9), "ok")


@query("src_1_geojson_polygons", "SELECT barrio_id, round((x0+x1)/2, 9) AS lon, round((y0+y1)/2, 9) AS lat FROM barrio")
def _(v):
    path = fresh_path(v.spark, "polygons")
    docs = ly.feature_collections(v.barrio, F.lit("all"), ["barrio_id", "barrio_name"], ly.ring_geometry())
    docs.select("geojson").write.text(path)
    d = ly.poi_layer(ly.read_features(v.spark, path, per_line=False), "barrio", "barrios.geojson")
    return d.select(c("props")["barrio_id"].cast("long").alias("barrio_id"), R("lon", 9), R("lat", 9))


@query("src_2_csv_points", "SELECT poi_id::VARCHAR AS poi_id, name, round(lon, 5) AS lon, round(lat, 5) AS lat, true AS ok FROM poi")
def _(v):
    path = fresh_path(v.spark, "csv")
    comma = lambda n: F.regexp_replace(F.round(n, 5).cast("decimal(12,5)").cast("string"), r"\.", ",")
    v.poi.select("poi_id", c("name").alias("Nombre"), comma("lat").alias("Latitud"), comma("lon").alias("Longitud")).write.option("header", True).csv(path)
    return ly.csv_layer(v.spark, path, "any", "points.csv", "LATITUD_X", "LONGITUD_X", "NAME", keep=["poi_id"]).select("poi_id", "name", "lon", "lat", "ok")


@query("src_3_mercator_and_esri", "SELECT poi_id, CASE WHEN category='colegio' THEN name ELSE 'Sin nombre' END AS name, round(lon, 7) AS lon, round(lat, 7) AS lat FROM poi WHERE category IN ('colegio','teatro')")
def _(v):
    x, y = sp.lonlat_to_mercator("lon", "lat")
    d = v.poi.withColumns({"x": x, "y": y, "NOMBRE_EST": c("name")})
    a, b = fresh_path(v.spark, "mercator"), fresh_path(v.spark, "esri")
    ly.write_features(d.where("category = 'colegio'"), ["poi_id", "NOMBRE_EST"], ly.point_geometry("x", "y"), a)
    esri = F.to_json(F.struct(F.struct("poi_id").alias("attributes"), F.struct("x", "y").alias("geometry")))
    d.where("category = 'teatro'").select(esri.alias("value")).write.text(b)
    parts = [ly.poi_layer(ly.read_features(v.spark, a), "colegio", "a", ly.SCHOOL_KEYS, "mercator"), ly.poi_layer(ly.read_features(v.spark, b), "teatro", "b", crs="mercator")]
    return geo.union_all(parts).select(c("props")["poi_id"].cast("long").alias("poi_id"), "name", R("lon", 7), R("lat", 7))


@query("src_4_esri_polygons", "SELECT layer, poly_id, value, round((x0+x1)/2, 6) AS cx, round((y0+y1)/2, 6) AS cy FROM pot WHERE layer='activity'")
def _(v):
    def grid(p):
        x, y = sp.CITY_GRID.forward(p["x"], p["y"])
        return F.array(x, y)

    path = fresh_path(v.spark, "esri_polygons")
    rings = F.transform("rings", lambda r: F.transform(r, grid))
    doc = F.to_json(F.struct(F.struct("layer", "poly_id", "value").alias("attributes"), F.struct(rings.alias("rings")).alias("geometry")))
    v.pot.where("layer = 'activity'").select(doc.alias("value")).write.text(path)
    d = ly.polygon_layer(ly.read_features(v.spark, path), {"layer": ["layer"], "poly_id": ["poly_id"], "value": ["value"]})
    b = sp.bbox(c("rings"))
    return d.select("layer", c("poly_id").cast("long").alias("poly_id"), "value", F.round((b["x0"] + b["x1"]) / 2, 6).alias("cx"), F.round((b["y0"] + b["y1"]) / 2, 6).alias("cy"))


@query("src_5_zone_polygons_upsert", "SELECT barrio_id, concat(barrio_name, '!') AS barrio_name, CASE WHEN barrio_id >= 50 THEN 'updated' ELSE 'inserted' END AS action FROM barrio")
def _(v):
    path = fresh_path(v.spark, "zones")
    ly.write_features(v.barrio.withColumn("barrio_name", F.concat("barrio_name", F.lit("!"))), ["barrio_id", "barrio_name"], ly.ring_geometry(), path)
    new = ly.polygon_layer(ly.read_features(v.spark, path), {"barrio_id": ["barrio_id"], "barrio_name": ["barrio_name"]}).withColumn("barrio_id", c("barrio_id").cast("long"))
    now = F.lit("2024-01-01").cast("timestamp")
    cur = v.barrio.where("barrio_id >= 50").select("barrio_id", "barrio_name", "rings").withColumns({"first_seen": now, "last_seen": now, "scrapes": F.lit(1)})
    return up.upsert(cur, new, ["barrio_id"], ["barrio_name"], now, c("barrio_name")).select("barrio_id", "barrio_name", "action")


@query("src_6_crime_layer", "SELECT zone_id, click::DOUBLE AS click, error::DOUBLE AS error, round(area_km2, 4) AS area_km2 FROM crime")
def _(v):
    path = fresh_path(v.spark, "crime")
    ly.write_features(v.crime.join(v.zone, "zone_id"), ["zone_id", "click", "error", "area_km2"], ly.ring_geometry(), path)
    d = ly.read_features(v.spark, path)
    num = lambda k: c("props")[k].try_cast("double")
    return d.select(c("props")["zone_id"].cast("long").alias("zone_id"), num("click").alias("click"), num("error").alias("error"), F.round(num("area_km2"), 4).alias("area_km2"))


def tagged(v):
    k = c("poi_id")
    tag = lambda cats, val: F.when(c("category").isin(*cats), F.lit(val))
    return v.poi.select(k, F.coalesce(tag(["colegio", "jardin"], "school"), tag(["universidad"], "university"), tag(["ips"], "clinic"), tag(["farmacia"], "pharmacy"), tag(["plaza_mercado"], "marketplace")).alias("amenity"),
                        tag(["supermercado"], "supermarket").alias("shop"), tag(["parque"], "park").alias("leisure"), F.lit(None).cast("string").alias("landuse"), tag(["cancha"], "bus_stop").alias("highway"),
                        F.lit(None).cast("string").alias("railway"), F.when(c("category") == "parque", "polygon").otherwise("point").alias("shape"))


_VIEW = {"education": ("colegio", "jardin", "universidad"), "health": ("ips", "farmacia"), "transport": ("cancha",), "parks": ("parque",), "commercial": ("supermercado", "plaza_mercado")}


@query("src_7_osm_views", " UNION ALL ".join(f"SELECT '{n}' AS view, poi_id FROM poi WHERE category IN {cs if len(cs) > 1 else '(' + repr(cs[0]) + ')'}" for n, cs in _VIEW.items()))
def _(v):
    t = tagged(v)
    return geo.union_all([ly.osm_view(t, n).select(F.lit(n).alias("view"), "poi_id") for n in ly.OSM_VIEWS])


@query("src_8_park_buffers", "SELECT poi_id, 33 AS vertices, round(lon, 7) AS cx, round(lat, 7) AS cy FROM poi WHERE category='parque'")
def _(v):
    d = ly.park_buffers(v.poi.where("category = 'parque'").withColumn("r", F.lit(120.0)), "r")
    cx, cy = sp.ring_centroid(F.get("rings", 0))
    return d.select("poi_id", F.size(F.get("rings", 0)).alias("vertices"), F.round(cx, 7).alias("cx"), F.round(cy, 7).alias("cy"))


@query("snk_1_replace_layer", "SELECT 'poi' AS layer, count(*) AS n FROM poi WHERE category<>'ips' UNION ALL SELECT 'station', count(*) FROM station")
def _(v):
    path = fresh_path(v.spark, "layers")
    ly.replace_layer(v.poi.select(c("poi_id").alias("fid"), "lon", "lat"), path, "poi")
    ly.replace_layer(v.station.select(c("station_id").alias("fid"), "lon", "lat"), path, "station")
    ly.replace_layer(v.poi.where("category <> 'ips'").select(c("poi_id").alias("fid"), "lon", "lat"), path, "poi")
    return ly.layer_counts(v.spark, path)


@query("snk_2_feature_collections", "SELECT category AS key, count(*) AS n FROM poi GROUP BY 1")
def _(v):
    d = ly.feature_collections(v.poi, c("category"), ["poi_id", "name"], ly.point_geometry(), 50)
    return d.groupBy("key").agg(F.sum(F.size(F.from_json("geojson", "struct<features:array<struct<type:string>>>")["features"])).alias("n"))


@query("snk_3_result_documents", "SELECT kind, count(*) AS n, avg(price) AS avg_price FROM listing GROUP BY 1")
def _(v):
    path = fresh_path(v.spark, "report")
    d = v.listing.groupBy("kind").agg(F.count("*").alias("n"), F.avg("price").alias("avg_price"))
    d.write.json(path)
    return v.spark.read.schema(d.schema).json(path)


@query("snk_4_load_if_empty", "SELECT 'poi' AS layer, count(*) AS n FROM poi")
def _(v):
    path = fresh_path(v.spark, "idempotent")
    d = v.poi.select("poi_id", "lon", "lat")
    ly.load_if_empty(v.spark, d, path, "poi")
    ly.load_if_empty(v.spark, d.unionByName(d), path, "poi")  # second load is skipped
    return ly.layer_counts(v.spark, path)


# ------------------------------------------------------------------ streams


def scrape_stream(v):
    l = st.table_stream(v.spark, v.dir, "lineitem.parquet")
    return l.select(F.concat_ws("-", c("l_partkey"), c("l_suppkey")).alias("key"), c("l_shipdate").alias("ts"), F.round(c("l_extendedprice") * 100).cast("long").alias("price"),
                    c("l_returnflag").alias("state"), c("l_quantity").alias("area"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")


_ORD = ["ts", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"]
_AUD = "w AS (SELECT key, ts, price, state, area, lag(price) OVER o AS pp, lag(state) OVER o AS ps, lag(area) OVER o AS pa, row_number() OVER o AS rn FROM scrape WINDOW o AS (PARTITION BY key ORDER BY ts, s1, s2, s3, s4, s5))"


@query("str_1_change_audit_stream", f"{_AUD} " + " UNION ALL ".join(f"SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\", '{f}' AS field, CAST({o} AS VARCHAR) AS old, CAST({f} AS VARCHAR) AS new FROM w WHERE rn > 1 AND {f} IS DISTINCT FROM {o}" for f, o in (("price", "pp"), ("state", "ps"), ("area", "pa"))))
def _(v):
    d = st.change_audit(scrape_stream(v), "key", ["price", "state", "area"], _ORD)
    return d.where("action = 'updated'").select("key", F.unix_seconds("ts").alias("at"), "field", "old", "new")


@query("str_2_created_updated_events", f"{_AUD} SELECT 'created' AS action, '' AS field, count(*) AS n FROM w WHERE rn=1 UNION ALL SELECT 'updated', 'price', count(*) FROM w WHERE rn>1 AND price<>pp UNION ALL SELECT 'updated', 'state', count(*) FROM w WHERE rn>1 AND state<>ps UNION ALL SELECT 'updated', 'area', count(*) FROM w WHERE rn>1 AND area<>pa")
def _(v):
    d = st.change_audit(scrape_stream(v), "key", ["price", "state", "area"], _ORD, "changes")
    return d.groupBy("action", F.coalesce("field", F.lit("")).alias("field")).agg(F.count("*").alias("n"))


@query("str_3_incremental_scoring", "SELECT a.study_id, count(b.poi_id) AS n_poi, round(least(5.0e0, count(b.poi_id)*0.05e0), 2) AS services FROM study a LEFT JOIN poi b ON b.lat BETWEEN a.lat-0.0096 AND a.lat+0.0096 AND b.lon BETWEEN a.lon-0.0096 AND a.lon+0.0096 AND "
       + __import__("plotwise.fixtures", fromlist=["x"]).sql_haversine("a", "b") + " <= 1000 GROUP BY 1")
def _(v):
    from plotwise.fixtures import grid_point

    k = c("c_custkey")
    lon, lat = grid_point(k, 7919, 30011)
    s = st.table_stream(v.spark, v.dir, "customer.parquet").select(k.alias("study_id"), lon.alias("lon"), lat.alias("lat"))
    poi = stage(v.poi)
    return st.drain_batches(s, "scores", lambda b, i: ind.simple_services(b, poi).select("study_id", "n_poi", "services"), "study_id long, n_poi long, services double")


@query("str_4_snapshot_append", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(price)::BIGINT AS total FROM scrape GROUP BY 1")
def _(v):
    d = st.drain(scrape_stream(v).select("key", "ts", "price"), "snapshots")
    return d.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("str_5_window_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1,2")
def _(v):
    d = st.drain(st.window_counts(st.table_stream(v.spark, v.dir, "events.parquet"), "ts", "event_type"), "counts")
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("str_5_recent_by_type", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def _(v):
    return st.recent_by_type(v.table("events"), "event_type", "ts", "event_id", 100).select("event_type", "event_id")


@query("str_6_batch_coverage", "SELECT count(*) AS total, count(access) AS with_access, count(security) AS with_security, round(avg(access),6) AS avg_access, round(avg(security),6) AS avg_security FROM scored")
def _(v):
    return st.coverage(v.scored).withColumns({"avg_access": F.round("avg_access", 6), "avg_security": F.round("avg_security", 6)})


# One arrival after the other per key: the count and the start of the pause are set back when a run is due.
@query("str_7_run_triggers", """RECURSIVE e AS (SELECT event_type AS key, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
  r(key, rn, ts, n, last, enough, pause) AS (SELECT key, rn, ts, 1, ts, false, false FROM e WHERE rn=1 UNION ALL
   SELECT key, rn, ts, n, last, n >= 30, epoch(ts) - epoch(last) >= 7*86400 FROM (SELECT e.key, e.rn, e.ts, CASE WHEN r.enough OR r.pause THEN 1 ELSE r.n+1 END AS n, CASE WHEN r.enough OR r.pause THEN r.ts ELSE r.last END AS last FROM r JOIN e ON e.key=r.key AND e.rn=r.rn+1))
  SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(n AS BIGINT) AS n_new, concat_ws(',', CASE WHEN enough THEN 'new_rows' END, CASE WHEN pause THEN 'days_without_run' END) AS reasons FROM r WHERE enough OR pause""")
def _(v):
    d = st.drain(st.run_triggers(st.table_stream(v.spark, v.dir, "events.parquet"), "event_type", "ts", "event_id"), "triggers")
    return d.select("key", F.unix_seconds("ts").alias("at"), "n_new", "reasons")


_SES = """g AS (SELECT conv_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS b FROM turns), s AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)"""


@query("str_8_sessions", f"{_SES} SELECT conv_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_at, count(*) AS turns FROM s GROUP BY conv_id, sid HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM turns) - INTERVAL 1 HOUR")
def _(v):
    t = st.table_stream(v.spark, v.dir, "conversations.parquet")
    secs = c("turn") * 600 + F.floor(c("turn") / 5) * 25 * 3600
    t = t.select("conv_id", "turn", F.timestamp_seconds(F.lit(1704067200) + secs).alias("ts"))
    return st.drain(st.sessions(t, "conv_id", "ts", late="1 hour"), "sessions").select("conv_id", F.unix_seconds("start").alias("start_at"), "turns")


@query("str_8_sessions_batch", f"{_SES} SELECT conv_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_at, count(*) AS turns FROM s GROUP BY conv_id, sid")
def _(v):
    return st.sessions(v.turns, "conv_id", "ts").select("conv_id", F.unix_seconds("start").alias("start_at"), "turns")


@query("str_9_duplicate_suppression", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(v):
    path = fresh_path(v.spark, "redelivered")
    e = v.table("events")
    e.write.parquet(path)
    e.where("event_type = 'error'").write.mode("append").parquet(path)  # delivered twice
    s = v.spark.readStream.schema(e.schema).parquet(path)
    return st.drain(st.deduplicated(s, ["event_id"], "ts", "40 days"), "unique").groupBy("event_type").agg(F.count("*").alias("n"))


@query("str_10_full_refresh")
def _(v):
    from plotwise.plans.refresh import refresh

    now = F.lit("2030-01-01").cast("timestamp")
    _, report = refresh(raw_documents(v), None, stations=v.station.where("layer = 'transmilenio'"), pois=v.poi, zones=zone_mass(v), barrios=v.barrio, layers=v.pot, now=now)
    return report.select("stage", "metric", F.round("value", 4).alias("value"))
