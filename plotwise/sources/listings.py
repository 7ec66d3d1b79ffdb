"""Raw listing documents of seven shapes into one listing schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions import text as tx
from plotwise.functions.labels import lookup

# Amenity fields, type and operation maps, the dollar rate of the foreign source.
HABI_AMENITIES = ["parqueadero", "ascensor", "vigilancia", "gimnasio", "piscina", "zonas verdes", "salon comunal", "terraza", "balcon",
                  "deposito", "gas", "porteria", "elevadores", "zona de lavanderia"]
HABI_NO = ["no", "false", "0", "nan", "no tiene"]
PROPERATI_TYPES = {"apartment": "Apartamento", "house": "Casa", "store": "Local", "land": "Lote", "PH": "Apartamento", "office": "Oficina"}
PROPERATI_OPS = {"sell": "Venta", "rent": "Arriendo"}
USD_RATE = 4200
FORMATS = ["finca_raiz", "finca_raiz_legacy", "habi", "properati", "bancolombia_reo", "sae", "ciencuadras"]


def read_collections(spark: SparkSession, root: str) -> DataFrame:
    """Documents under root/<database>/<collection>/, one per line, with labels from the path."""
    d = spark.read.text(root, recursiveFileLookup=True).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("_p"))
    d = d.withColumns({"database": F.regexp_extract("_p", r"/([^/]+)/[^/]+/[^/]+$", 1), "collection": F.regexp_extract("_p", r"/([^/]+)/[^/]+$", 1)}).drop("_p")
    prefix = F.get(F.split("collection", "_"), 0)
    return d.withColumns({"source_type": lookup(tx.COLLECTION_TYPES, prefix), "operation": F.initcap(F.regexp_extract("collection", r"_(venta|arriendo)$", 1))})


class Doc:
    """Typed access to one variant column."""

    def __init__(self, col: str = "v"):
        self.col = col

    def raw(self, key: str) -> Column:
        return F.try_variant_get(self.col, f"$['{key}']", "variant")

    def text(self, key: str) -> Column:
        return F.try_variant_get(self.col, f"$['{key}']", "string")

    def number(self, key: str) -> Column:
        """Number stored as a number; null for text."""
        return F.when(F.schema_of_variant(self.raw(key)) != "STRING", F.try_variant_get(self.col, f"$['{key}']", "double"))

    def truthy(self, key: str) -> Column:
        t = self.text(key)
        return F.coalesce((t != "") & ~((F.schema_of_variant(self.raw(key)) != "STRING") & t.isin("0", "false", "null")), F.lit(False))

    def chain(self, fn, keys: list[str]) -> Column:
        """fn of the first key with a usable value, else of the last one."""
        out = None
        for k in keys[:-1]:
            out = F.when(self.truthy(k), fn(k)) if out is None else out.when(self.truthy(k), fn(k))
        return fn(keys[-1]) if out is None else out.otherwise(fn(keys[-1]))

    def any_text(self, *keys):
        return self.chain(self.text, list(keys))

    def price(self, *keys):
        return self.chain(lambda k: F.coalesce(F.floor(self.number(k)).cast("bigint"), tx.price_of_text(self.text(k))), list(keys))

    def area(self, *keys):
        return self.chain(lambda k: F.coalesce(self.number(k), tx.area_of_text(self.text(k))), list(keys))

    def integer(self, *keys):
        return self.chain(lambda k: F.coalesce(F.floor(self.number(k)).cast("bigint"), tx.first_int(self.text(k))), list(keys))

    def coord(self, *keys):
        return self.chain(lambda k: tx.coordinate(self.text(k)), list(keys))

    def first_of(self, fn, keys):
        """First key whose converted value is neither null nor zero, else the last conversion."""
        vals = [fn(k) for k in keys]
        return F.coalesce(*[F.when(x != 0, x) for x in vals[:-1]], vals[-1])


def _row(**kw) -> list[Column]:
    base = dict.fromkeys(["site", "code", "price", "area", "rooms", "baths", "garages", "stratum", "kind", "operation", "place", "address", "lat", "lon", "agency", "amenities"])
    types = {"price": "bigint", "area": "double", "rooms": "bigint", "baths": "bigint", "garages": "bigint", "stratum": "bigint", "lat": "double", "lon": "double", "amenities": "array<string>"}
    out = []
    for n in base:
        v = kw.get(n)
        v = F.lit(None) if v is None else v
        out.append(v.cast(types.get(n, "string")).alias(n))
    return out


def _list(d: Doc, key="caracteristicas"):
    return F.coalesce(F.try_variant_get(d.col, f"$['{key}']", "array<string>"), F.array().cast("array<string>"))


def normalize(docs: DataFrame, fmt: str) -> DataFrame:
    """Documents of one source (`doc` JSON text) in the common schema."""
    d = Doc()
    v = docs.withColumn("v", F.try_parse_json("doc")).where("v is not null")
    op = F.col("operation") if "operation" in docs.columns else F.lit(None).cast("string")
    op = F.coalesce(F.when(op != "", op), F.lit("Venta"))
    if fmt in ("finca_raiz", "finca_raiz_legacy"):
        old = fmt.endswith("legacy")
        kinds = ["tipo_de_inmueble", "tipo_inmueble"] + (["Tipo de Inmueble"] if old else [])
        twice = lambda fn, a, b: d.first_of(fn, [a, b]) if old else fn(a)
        strat = tx.valid_stratum(d.integer("estrato"))
        if old:
            strat = F.coalesce(strat, tx.valid_stratum(d.integer("Estrato")))
        cols = _row(site=F.coalesce(d.text("pagina"), F.lit("finca_raiz")), code=F.coalesce(d.text("codigo_fr"), F.lit("")), price=d.price("precio"),
                    area=d.first_of(d.area, ["area_construida", "Área Construida", "area"]) if old else d.area("area_construida"),
                    rooms=twice(d.integer, "habitaciones", "Habitaciones"), baths=twice(d.integer, "banos", "Baños"),
                    garages=d.integer("garajes", *(["Garajes"] if old else []), "parqueaderos"), stratum=strat, kind=tx.canonical_type(d.any_text(*kinds)), operation=op,
                    place=d.text("ubicacion"), address=d.text("direccion"), lat=d.coord("latitud", "lat"), lon=d.coord("longitud", "lon"), agency=d.text("inmobiliaria"), amenities=_list(d))
    elif fmt == "habi":
        has = [F.when(d.truthy(k) & ~F.lower(d.text(k)).isin(HABI_NO), F.lit(" ".join(w.capitalize() for w in k.split()))) for k in HABI_AMENITIES]
        kind = d.any_text("tipo de inmueble", "tipo_inmueble")
        cols = _row(site=F.lit("habi"), code=d.any_text("codigo_habi", "code"), price=d.price("precio"), area=d.area("area", "area construida"), rooms=d.integer("habitaciones"),
                    baths=d.integer("banos", "baños"), garages=d.integer("garajes", "parqueadero_count"), stratum=tx.valid_stratum(d.integer("estrato")),
                    kind=F.coalesce(tx.canonical_type(kind), F.lit("Apartamento")), operation=op, place=d.any_text("ubicacion", "lugar", "ciudad"), address=d.text("direccion"),
                    lat=d.coord("latitud"), lon=d.coord("longitud"), agency=F.lit("Habi"), amenities=F.array_compact(F.array(*has)))
    elif fmt == "properati":
        p = d.price("price")
        place = F.trim(F.get(F.split(d.text("place_with_parent_names"), r"\|"), 0))
        cols = _row(site=F.lit("properati"), code=F.coalesce(d.any_text("id", "id_properati"), F.lit("")), price=F.when(d.text("currency") == "USD", p * USD_RATE).otherwise(p),
                    area=d.area("surface_covered_in_m2"), rooms=d.integer("bedrooms"), baths=d.integer("bathrooms"), kind=lookup(PROPERATI_TYPES, d.text("property_type")),
                    operation=lookup(PROPERATI_OPS, d.text("operation"), "Venta"), place=F.coalesce(F.when(d.truthy("place_with_parent_names"), place), d.text("place_name")), lat=d.coord("lat"), lon=d.coord("lon"),
                    amenities=F.array().cast("array<string>"))
    elif fmt in ("bancolombia_reo", "sae"):
        reo = fmt == "bancolombia_reo"
        join = F.concat_ws(", ", F.coalesce(d.text("ciudad"), F.lit("")), F.coalesce(d.text("barrio" if reo else "departamento"), F.lit("")))
        place = F.when(d.truthy("ubicacion"), d.text("ubicacion")).otherwise(F.regexp_replace(join, r"^[, ]+|[, ]+$", ""))
        cols = _row(site=F.lit(fmt), code=F.coalesce(d.any_text("codigo_bancolombia" if reo else "codigo_sae", "codigo"), F.lit("")),
                    price=d.price("precio", "precio_venta") if reo else d.price("precio_base", "precio"), area=d.area("area"), rooms=d.integer("habitaciones"), baths=d.integer("banos"),
                    garages=d.integer("garajes") if reo else None, stratum=tx.valid_stratum(d.integer("estrato")) if reo else None, kind=tx.canonical_type(d.any_text("tipo_inmueble", "tipo")),
                    operation=F.lit("REO" if reo else "Subasta"), place=place, address=d.text("direccion"), lat=d.coord("lat", "latitud"), lon=d.coord("lon", "longitud"),
                    agency=F.lit("Bancolombia" if reo else "SAE - Gobierno"), amenities=F.array().cast("array<string>"))
    elif fmt == "ciencuadras":
        cols = _row(site=F.lit(fmt), code=F.coalesce(d.any_text("codigo_ciencuadras", "codigo"), F.lit("")), price=d.price("precio"), area=d.area("area_construida", "area"),
                    rooms=d.integer("habitaciones"), baths=d.integer("banos"), garages=d.integer("garajes"), stratum=tx.valid_stratum(d.integer("estrato")),
                    kind=tx.canonical_type(d.any_text("tipo_inmueble", "tipo")), operation=F.coalesce(d.text("tipo_operacion"), F.lit("Venta")), place=d.text("ubicacion"),
                    address=d.text("direccion"), lat=d.coord("lat", "latitud"), lon=d.coord("lon", "longitud"), agency=d.text("inmobiliaria"), amenities=_list(d))
    else:
        raise ValueError(f"unknown format {fmt}")
    return v.select(*cols)


def normalize_all(docs: DataFrame, fmt: str = "fmt") -> DataFrame:
    """All sources at once; `fmt` names the format column."""
    parts = [normalize(docs.where(F.col(fmt) == f), f) for f in FORMATS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def freshness(docs: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Documents and latest time per collection, with the overall latest."""
    per = docs.groupBy(*by).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))
    top = docs.agg(F.max(ts).alias("t"))
    return per.withColumn("latest_overall", top.select("t").scalar())


def newest(df: DataFrame, where: Column, ts: str, ident: str, most: int | None = None) -> DataFrame:
    """Filtered rows, newest first, only `most` of them if the caller says so; the filter reaches the scan."""
    rows = df.where(where).orderBy(F.desc(ts), ident)
    return rows if most is None else rows.limit(most)
