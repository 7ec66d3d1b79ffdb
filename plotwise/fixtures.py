"""Listing-domain views over the star-schema tables, in Spark and as SQL text.

Both forms use the same integer arithmetic, so results agree exactly.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
POI_CATEGORIES = ["ips", "farmacia", "colegio", "universidad", "jardin", "centro_comercial",
                  "supermercado", "plaza_mercado", "biblioteca", "teatro", "parque", "cancha"]
STATION_LAYERS = ["transmilenio", "sitp", "vias", "cai"]
AMENITIES = ["Piscina", "Gimnasio", "Parqueadero", "Vigilancia 24h", "Ascensor", "Zona BBQ", "Depósito"]
TREATMENTS = ["renovacion", "desarrollo", "consolidacion", "mejoramiento", "conservacion", "otro"]
BUILD_RANGES = ["4C", "3", "2", "1", "x"]
ACTIVITY_CODES = ["AAERAE", "AAGSM", "AAERVIS", "AAPGSU", "AAPRSU", "PEMP", "x"]
OFFENCES = ["click", "error", "purchase", "signup", "view"]

KIND_WORDS = ["apartamento", "casa", "lote", "oficina", "local comercial", "apto"]
POI_WORDS = ["hospital", "colegio", "parque", "transmilenio", "supermercado", "cai", "biblioteca", "farmacia", "teatro"]
PLACE_WORDS = ["Suba", "Usme", "Chapinero", "Kennedy", "Bosa"]
CHAT_WORDS = ["¿Qué es el índice?", "promedio de precios por localidad", "comparar suba vs usme", "Gracias!"]
# Query templates; {n} parts are filled from the row key.
QUERY_TEMPLATES = [
    "Busco {kind} cerca de {poi} a {metres} m",
    "{kind} menos de {mill} millones con {rooms} habitaciones y {baths} baños",
    "entre 200 y {mill}M en {place}, zona muy seguro",
    "a {mins} minutos caminando de {poi}, índice > {idx}.5",
    "{kind} más de {area} m2 con gimnasio y piscina, bien conectado",
    "Calle {street} # {mins}-{area} {kind} a {idx},5 km",
    "{chat}",
    "ahora con {poi} pegado a la zona y vigilancia",
]
# Name -> (multiplier, modulus, offset) of the numbers in a query.
QUERY_NUMBERS = {"metres": (100, 60, 100), "mill": (1, 900, 100), "rooms": (1, 12, 0), "baths": (1, 5, 1), "mins": (1, 40, 0),
                 "idx": (1, 6, 0), "area": (1, 100, 50), "street": (1, 180, 1)}
QUERY_WORDS = {"kind": (KIND_WORDS, 7), "poi": (POI_WORDS, 11), "place": (PLACE_WORDS, 13), "chat": (CHAT_WORDS, 17)}

LON0, LAT0 = -74.20, 4.45
KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SCORES = ["access", "security", "dwelling", "services", "zoning"]


def pick(values: list[str], index) -> "F.Column":
    """Element `index` (0-based column) of a literal list."""
    return F.element_at(F.lit(values), (index + 1).cast("int"))


def grid_point(key, mx: int, my: int):
    lon = F.lit(LON0) + ((key * mx) % 20000) / F.lit(100000.0)
    lat = F.lit(LAT0) + ((key * my) % 40000) / F.lit(100000.0)
    return lon, lat


def _ring(x0, y0, x1, y1):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))


class Views:
    """Lazy access to the driver tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return df

    @cached_property
    def listing(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
            F.sum("l_quantity").alias("area"), F.count("*").alias("rooms"))
        o = self.table("orders").withColumnRenamed("o_orderkey", "id").join(lines, "id", "left")
        k, c = F.col("id"), F.col("o_custkey")
        lon, lat = grid_point(k, 7919, 104729)
        located = k % 29 != 0
        return o.select(
            "id",
            F.round(F.col("o_totalprice") * 1000).cast("long").alias("price"),
            "area",
            F.coalesce("rooms", F.lit(0)).cast("long").alias("rooms"),
            F.when(k % 17 != 0, k % 4 + 1).alias("baths"),
            (k % 3).alias("garages"),
            F.when(k % 23 != 0, c % 6 + 1).alias("stratum"),
            F.col("o_orderpriority").alias("kind"),
            F.col("o_orderstatus").alias("site"),
            k.cast("string").alias("code"),
            F.col("o_orderdate").alias("listed"),
            F.when(located, lon).alias("lon"),
            F.when(located, lat).alias("lat"),
            F.concat(F.lit("city_"), (c % 3).cast("string")).alias("city"),
            F.concat(F.lit("b"), (c % 100).cast("string"), F.lit(", city_"), (c % 3).cast("string"),
                     F.lit(", d")).alias("place"),
            (k % 61 == 0).alias("is_outlier"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Listings with stored sub-scores, composite, zone and neighbourhood."""
        k = F.col("id")
        raw = lambda m, a: ((k * m + a) % 501) / F.lit(100.0)
        df = self.listing.withColumns({
            "zone_id": F.floor((F.col("lon") - LON0) / 0.04) + 5 * F.floor((F.col("lat") - LAT0) / 0.08),
            "access": F.when(k % 31 != 0, raw(37, 0)),
            "security": F.when(k % 37 != 0, raw(53, 11)),
            "services": raw(71, 5),
            "zoning": F.when(k % 41 != 0, raw(89, 3)),
            "dwelling": F.round(F.least(F.lit(5.0), F.lit(0.4) * F.col("rooms")
                                        + F.lit(0.5) * F.coalesce("baths", F.lit(0))
                                        + F.least(F.coalesce("area", F.lit(0.0)) / 50, F.lit(3.0))), 2),
        })
        total = sum((F.coalesce(s, F.lit(0.0)) for s in SCORES[1:]), F.coalesce(SCORES[0], F.lit(0.0)))
        return df.withColumn("composite", F.round(F.lit(0.2) * total, 2))

    @cached_property
    def poi(self) -> DataFrame:
        k = F.col("p_partkey")
        lon, lat = grid_point(k, 6151, 30011)
        return self.table("part").select(k.alias("poi_id"), pick(POI_CATEGORIES, k % 12).alias("category"),
                                         F.col("p_name").alias("name"), lon.alias("lon"), lat.alias("lat"))

    @cached_property
    def station(self) -> DataFrame:
        k = F.col("s_suppkey")
        lon, lat = grid_point(k, 7919, 52361)
        return self.table("supplier").select(k.alias("station_id"), pick(STATION_LAYERS, k % 4).alias("layer"),
                                             lon.alias("lon"), lat.alias("lat"))

    def _rects(self, df, k, per_row, w, h, *cols):
        i, j = k % per_row, F.floor(k / per_row)
        x0, y0 = F.lit(LON0) + F.lit(w) * i, F.lit(LAT0) + F.lit(h) * j
        x1, y1 = F.lit(LON0) + F.lit(w) * (i + 1), F.lit(LAT0) + F.lit(h) * (j + 1)
        return df.select(*cols, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).withColumn(
            "rings", F.array(_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))

    @cached_property
    def zone(self) -> DataFrame:
        k = F.col("n_nationkey").cast("long")
        return self._rects(self.table("nation"), k, 5, 0.04, 0.08, k.alias("zone_id"), F.col("n_name").alias("zone_name"))

    @cached_property
    def barrio(self) -> DataFrame:
        """Neighbourhood rectangles, two by two in every zone; some are missing on purpose."""
        base = self.table("nation").select(F.explode(F.sequence(
            F.col("n_nationkey").cast("long") * 4, F.col("n_nationkey").cast("long") * 4 + 3)).alias("k"))
        k = F.col("k")
        return self._rects(base.where(k % 11 != 0), k, 10, 0.02, 0.04, k.alias("barrio_id"),
                           F.concat(F.lit("b"), k.cast("string")).alias("barrio_name"))

    @cached_property
    def pot(self) -> DataFrame:
        """Three zoning layers; two treatment rectangles overlap."""
        z = self.table("nation")
        k = F.col("n_nationkey").cast("long")
        lay = lambda name, vals, shift: self._rects(
            z, k + shift, 5, 0.04, 0.08, F.lit(name).alias("layer"), k.alias("poly_id"),
            pick(vals, k % len(vals)).alias("value"))
        return lay("treatment", TREATMENTS, 0).unionByName(
            lay("treatment", TREATMENTS, 1).where("poly_id in (3, 7)")).unionByName(
            lay("buildability", BUILD_RANGES, 0).where("poly_id % 6 <> 5")).unionByName(
            lay("activity", ACTIVITY_CODES, 0).where("poly_id % 9 <> 4"))

    @cached_property
    def study(self) -> DataFrame:
        """Points to study that are not listings."""
        k = F.col("c_custkey")
        lon, lat = grid_point(k, 7919, 30011)
        return self.table("customer").select(k.alias("study_id"), lon.alias("lon"), lat.alias("lat"), pick(KINDS, k % 5).alias("kind"),
                                             (k % 180 + 20).cast("double").alias("area"), (k % 7 + 1).alias("rooms"))

    @cached_property
    def crime(self) -> DataFrame:
        e = self.table("events").withColumn("zone_id", F.col("user_id") % 25)
        return e.groupBy("zone_id").agg(
            *[F.count(F.when(F.col("event_type") == o, 1)).alias(o) for o in OFFENCES],
            F.lit(0.04 * 0.08 * 12364.3).alias("area_km2"))

    @cached_property
    def survey(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return self.table("events").select(
            e.alias("resp_id"), (u % 19 + 1).alias("locality"), (u % 6 + 1).alias("stratum"),
            (e % 3 + 1).alias("sex"), (e % 7 + 1).alias("age"), (e % 2 + 1).alias("p102"),
            F.when(F.col("event_type") == "error", 1).otherwise(2).cast("long").alias("p203"),
            (F.get_json_object("props", "$.k").cast("long") % 7).alias("score"),
            F.col("event_type").alias("answer_a"),
            pick(OFFENCES, (e % 5)).alias("answer_b"))

    @cached_property
    def amenity(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("id"), pick(AMENITIES, F.col("l_linenumber") % 7).alias("name"),
            (F.col("l_linestatus") == "O").alias("has"))

    @cached_property
    def scrape(self) -> DataFrame:
        """Repeated sightings of a key; `seq` makes the order total."""
        return self.table("lineitem").select(
            F.concat_ws("-", F.col("l_partkey"), F.col("l_suppkey")).alias("key"),
            F.col("l_shipdate").alias("ts"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
            F.col("l_returnflag").alias("state"), F.col("l_quantity").alias("area"),
            F.struct(F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"),
                     F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_returnflag")).alias("seq"))

    @cached_property
    def query_log(self) -> DataFrame:
        """Search texts built from the order keys, plus every document as a long text."""
        k = F.col("o_orderkey")

        def part(name):
            if name in QUERY_NUMBERS:
                m, mod, off = QUERY_NUMBERS[name]
                return (F.floor(k / 8) % mod * m + off).cast("string")
            words, div = QUERY_WORDS[name]
            return pick(words, F.floor(k / div) % len(words))

        text = None
        for i, tpl in enumerate(QUERY_TEMPLATES):
            pieces = [part(x[1:-1]) if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", tpl) if x]
            line = F.concat(*pieces)
            text = F.when(k % 8 == i, line) if text is None else text.when(k % 8 == i, line)
        short = self.table("orders").select(k.alias("qid"), text.alias("q"))
        return short.unionByName(self.table("documents").select((-F.col("doc_id") - 1).alias("qid"), F.col("text").alias("q")))

    @cached_property
    def turns(self) -> DataFrame:
        t = F.col("turn")
        secs = t * 600 + F.floor(t / 5) * 25 * 3600
        return self.table("conversations").select(
            "conv_id", "turn", "role", "text",
            F.timestamp_seconds(F.lit(1704067200) + secs).alias("ts"))


# ---------------------------------------------------------------- SQL text


def _case(values: list[str], idx: str) -> str:
    lit = ", ".join("'" + v + "'" for v in values)
    return f"([{lit}])[CAST({idx} AS INT) + 1]"


def _pt(key: str, mx: int, my: int) -> tuple[str, str]:
    return (f"(-74.20e0 + (({key}*{mx})%20000)/100000.0e0)", f"(4.45e0 + (({key}*{my})%40000)/100000.0e0)")


_llon, _llat = _pt("o_orderkey", 7919, 104729)
_plon, _plat = _pt("p_partkey", 6151, 30011)
_slon, _slat = _pt("s_suppkey", 7919, 52361)


def _rect(k: str, per: int, w: str, h: str) -> str:
    return (f"-74.20e0+{w}*({k}%{per}) AS x0, 4.45e0+{h}*({k}//{per}) AS y0, "
            f"-74.20e0+{w}*(({k}%{per})+1) AS x1, 4.45e0+{h}*(({k}//{per})+1) AS y1")


def _layer(name: str, vals: list[str], shift: int, cond: str) -> str:
    return (f"SELECT '{name}' AS layer, n_nationkey::BIGINT AS poly_id, {_case(vals, f'n_nationkey % {len(vals)}')} AS value, "
            f"{_rect(f'(n_nationkey+{shift})', 5, '0.04e0', '0.08e0')} FROM nation WHERE {cond}")


def _query_text() -> str:
    def part(name):
        if name in QUERY_NUMBERS:
            m, mod, off = QUERY_NUMBERS[name]
            return f"CAST((o_orderkey//8)%{mod}*{m}+{off} AS VARCHAR)"
        words, div = QUERY_WORDS[name]
        return _case(words, f"((o_orderkey//{div})%{len(words)})")

    whens = []
    for i, tpl in enumerate(QUERY_TEMPLATES):
        pieces = [part(x[1:-1]) if x[:1] == "{" else f"'{x}'" for x in re.split(r"(\{\w+\})", tpl) if x]
        whens.append(f"WHEN {i} THEN concat({', '.join(pieces)})")
    return "CASE o_orderkey%8 " + " ".join(whens) + " END"


SQL_VIEWS = {
    "query_log": f"SELECT o_orderkey AS qid, {_query_text()} AS q FROM orders UNION ALL SELECT -doc_id-1 AS qid, text AS q FROM documents",
    "listing": f"""SELECT o_orderkey AS id, CAST(round(o_totalprice*1000) AS BIGINT) AS price, l.area AS area,
  coalesce(l.n, 0)::BIGINT AS rooms, CASE WHEN o_orderkey%17<>0 THEN o_orderkey%4+1 END AS baths, o_orderkey%3 AS garages,
  CASE WHEN o_orderkey%23<>0 THEN o_custkey%6+1 END AS stratum, o_orderpriority AS kind, o_orderstatus AS site,
  CAST(o_orderkey AS VARCHAR) AS code, o_orderdate AS listed,
  CASE WHEN o_orderkey%29<>0 THEN {_llon} END AS lon, CASE WHEN o_orderkey%29<>0 THEN {_llat} END AS lat,
  concat('city_', o_custkey%3) AS city, concat('b', o_custkey%100, ', city_', o_custkey%3, ', d') AS place, o_orderkey%61 = 0 AS is_outlier
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS area, count(*) AS n FROM lineitem GROUP BY 1) l
  ON l_orderkey = o_orderkey""",
    "scored0": """SELECT *, CAST(floor((lon+74.20e0)/0.04e0) + 5*floor((lat-4.45e0)/0.08e0) AS BIGINT) AS zone_id,
  CASE WHEN id%31<>0 THEN (id*37%501)/100.0e0 END AS access, CASE WHEN id%37<>0 THEN ((id*53+11)%501)/100.0e0 END AS security,
  ((id*71+5)%501)/100.0e0 AS services, CASE WHEN id%41<>0 THEN ((id*89+3)%501)/100.0e0 END AS zoning,
  round(least(5.0e0, 0.4e0*rooms + 0.5e0*coalesce(baths,0) + least(coalesce(area,0)/50, 3.0e0)), 2) AS dwelling FROM listing""",
    "scored": """SELECT *, round(0.2e0*(coalesce(access,0)+coalesce(security,0)+coalesce(dwelling,0)+coalesce(services,0)
  +coalesce(zoning,0)), 2) AS composite FROM scored0""",
    "poi": f"""SELECT p_partkey AS poi_id, {_case(POI_CATEGORIES, 'p_partkey%12')} AS category, p_name AS name,
  {_plon} AS lon, {_plat} AS lat FROM part""",
    "station": f"""SELECT s_suppkey AS station_id, {_case(STATION_LAYERS, 's_suppkey%4')} AS layer, {_slon} AS lon, {_slat} AS lat
  FROM supplier""",
    "zone": f"SELECT n_nationkey::BIGINT AS zone_id, n_name AS zone_name, {_rect('n_nationkey', 5, '0.04e0', '0.08e0')} FROM nation",
    "barrio": f"""SELECT k AS barrio_id, concat('b', k) AS barrio_name, {_rect('k', 10, '0.02e0', '0.04e0')}
  FROM (SELECT n_nationkey::BIGINT*4 + j AS k FROM nation, range(4) r(j)) WHERE k%11<>0""",
    "pot": " UNION ALL ".join([
        _layer("treatment", TREATMENTS, 0, "true"), _layer("treatment", TREATMENTS, 1, "n_nationkey IN (3,7)"),
        _layer("buildability", BUILD_RANGES, 0, "n_nationkey%6<>5"),
        _layer("activity", ACTIVITY_CODES, 0, "n_nationkey%9<>4")]),
    "study": f"""SELECT c_custkey AS study_id, {_pt('c_custkey', 7919, 30011)[0]} AS lon, {_pt('c_custkey', 7919, 30011)[1]} AS lat, {_case(KINDS, 'c_custkey%5')} AS kind,
  (c_custkey%180+20)::DOUBLE AS area, c_custkey%7+1 AS rooms FROM customer""",
    "crime": "SELECT user_id%25 AS zone_id, " + ", ".join(
        f"count(*) FILTER (event_type='{o}') AS {o}" for o in OFFENCES)
        + ", 0.04e0*0.08e0*12364.3e0 AS area_km2 FROM events GROUP BY 1",
    "survey": f"""SELECT event_id AS resp_id, user_id%19+1 AS locality, user_id%6+1 AS stratum, event_id%3+1 AS sex,
  event_id%7+1 AS age, event_id%2+1 AS p102, CASE WHEN event_type='error' THEN 1 ELSE 2 END::BIGINT AS p203,
  CAST(json_extract_string(props,'$.k') AS BIGINT)%7 AS score, event_type AS answer_a,
  {_case(OFFENCES, 'event_id%5')} AS answer_b FROM events""",
    "amenity": f"SELECT l_orderkey AS id, {_case(AMENITIES, 'l_linenumber%7')} AS name, l_linestatus='O' AS has FROM lineitem",
    "scrape": """SELECT concat_ws('-', l_partkey, l_suppkey) AS key, l_shipdate AS ts, CAST(round(l_extendedprice*100) AS BIGINT) AS price,
  l_returnflag AS state, l_quantity AS area, l_orderkey AS s1, l_linenumber AS s2, l_extendedprice AS s3, l_quantity AS s4,
  l_returnflag AS s5 FROM lineitem""",
    "turns": """SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_seconds(turn*600 + (turn//5)*90000) AS ts FROM conversations""",
}
_DEPS = {"scored": ["scored0"], "scored0": ["listing"]}
SCRAPE_ORDER = "ts, s1, s2, s3, s4, s5"


def with_views(body: str) -> str:
    """Prefix `body` with the views it mentions.

    `body` is a query, or `name AS (...), ... SELECT ...` without the WITH; it may start with RECURSIVE.
    """
    need: list[str] = []

    def add(v: str) -> None:
        for d in _DEPS.get(v, []):
            add(d)
        if v not in need:
            need.append(v)

    for v in SQL_VIEWS:
        if re.search(rf"\b{v}\b", body):
            add(v)
    body = body.strip()
    word = "WITH"
    if body[:10].lower() == "recursive ":
        word, body = "WITH RECURSIVE", body[10:].strip()
    starts = body[:6].lower()
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in need)
    if starts == "select" or body[:1] == "(":
        return f"{word} {ctes} {body}" if need else body
    return f"{word} {ctes}, {body}" if need else f"{word} {body}"


def sql_haversine(a: str, b: str) -> str:
    return (f"(2*6371000.0e0*asin(sqrt(least(1.0e0, pow(sin(radians({b}.lat-{a}.lat)/2),2) + cos(radians({a}.lat))*"
            f"cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2)))))")
