"""Search over listings: intents from query text, ranked proximity search, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import requests as rq
from plotwise.functions import text as tx
from plotwise.functions.labels import lookup


def parse_queries(log: DataFrame, qid: str, text: str) -> DataFrame:
    """Search features of every query text as columns."""
    w, n, said = F.col("_w"), F.col("_n"), F.col("_said")
    read = rq.dealt(log.select(qid, F.trim(F.col(text)).alias("_q")), [qid, "_q"]).withColumn("_w", rq.words(F.col("_q")))
    read = read.withColumns({"_n": rq.numbers(w), "_said": rq.heard(w)})
    q = F.col("_q")
    return read.select(qid, rq.distance(said, n).alias("max_m"), tx.query_categories(q).alias("categories"), rq.kinds(said).alias("kinds"),
                       *[x.alias(k) for k, x in rq.amounts(n).items()], tx.query_locality(q).alias("locality"),
                       *[x.alias(k) for k, x in rq.index_floors(said, n).items()],
                       tx.query_amenities(q).alias("amenities"), rq.address(w).alias("address"))


def merge_previous(turns: DataFrame, session: list[str], order: str, text: str) -> DataFrame:
    """Append the previous turn's filters to turns that refine it.

    Sessions are bounded (one dialogue within its expiry), so a window per session is safe.
    """
    q = F.col(text)
    w = Window.partitionBy(*session).orderBy(order)
    words, numbers, said = F.col("_w"), F.col("_n"), F.col("_said")
    filters = rq.amounts(numbers)
    d = rq.dealt(turns, session).withColumn("_w", rq.words(q)).withColumns({"_n": rq.numbers(words), "_said": rq.heard(words)})
    d = d.withColumns({"_k": rq.kinds(said), "_c": tx.query_categories(q), "_hi": filters["price_max"],
                       "_lo": filters["price_min"], "_ix": rq.index_floors(said, numbers)["composite_min"]}).drop("_w", "_n", "_said")
    d = d.withColumns({f"{x}p": F.lag(x).over(w) for x in ("_k", "_c", "_hi", "_lo", "_ix")})
    bits = F.concat(
        F.when(F.size("_kp") > 0, F.array(F.lower(F.array_join("_kp", ", ")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(F.coalesce("_cp", F.array().cast("array<string>")), 1, 3),
                    lambda k: F.concat(F.lit("cerca a "), lookup(tx.CATEGORY_LABELS, k))),
        F.array_compact(F.array(
            F.when(F.col("_hip") > 0, F.concat(F.lit("menos de "), F.floor(F.col("_hip") / 1_000_000).cast("string"), F.lit("M"))),
            F.when(F.col("_lop") > 0, F.concat(F.lit("más de "), F.floor(F.col("_lop") / 1_000_000).cast("string"), F.lit("M"))),
            F.when(F.col("_ixp") > 0, F.concat(F.lit("índice > "), F.col("_ixp").cast("string"))))))
    refine = tx.is_refinement(q)
    merged = F.when(refine & (F.size(bits) > 0), F.concat(q, F.lit(" (filtros previos: "), F.array_join(bits, "; "), F.lit(")"))).otherwise(q)
    return d.withColumns({"refine": refine, "merged": merged}).drop("_k", "_c", "_hi", "_lo", "_ix", "_kp", "_cp", "_hip", "_lop", "_ixp")


# ------------------------------------------------------------ ranked search

# Score weights, walking-hit wording.
SCORE_WEIGHTS = {"index": 0.45, "proximity": 0.40, "anchor": 0.15}
INTENT = ("intent string, text string, kinds array<string>, categories array<string>, max_m int, price_min bigint, price_max bigint, area_min double, area_max double, "
          "rooms_min int, baths_min int, locality string, composite_min double, access_min double, security_min double, dwelling_min double, services_min double, "
          "zoning_min double, amenities array<string>, anchor_lon double, anchor_lat double, anchor_m int")
FLOORS = ["composite", "access", "security", "dwelling", "services", "zoning"]


def intents_of(log: DataFrame, qid: str, text: str, default_m: int = 600) -> DataFrame:
    """Parsed queries in the shape the ranked search reads."""
    p = parse_queries(log, qid, text).join(log.select(qid, F.trim(F.col(text)).alias("text")), qid)
    p = p.withColumns({"intent": F.col(qid).cast("string"), "max_m": F.coalesce("max_m", F.lit(default_m)), "anchor_lon": F.lit(None).cast("double"),
                       "anchor_lat": F.lit(None).cast("double"), "anchor_m": F.coalesce("max_m", F.lit(500))})
    return p.select(*[c.split(" ")[0] for c in INTENT.replace(", ", "\n").split("\n")])


def poi_distances(points: DataFrame, features: DataFrame, wanted: list[str]) -> DataFrame:
    """Map of the nearest distance (whole metres) per requested category.

    `features` has fid, category, lon, lat; a category is served by its members.
    """
    from plotwise.operators.indicators import nearest_layer_distances

    parts = None
    for cat in wanted:
        one = features.where(F.col("category").isin(tx.CATEGORY_MEMBERS.get(cat, [cat]))).withColumn("_cat", F.lit(cat))
        parts = one if parts is None else parts.unionByName(one)
    d = nearest_layer_distances(points, parts, "_cat", wanted, "fid")
    flat = [x for c in wanted for x in (F.lit(c), F.bround(F.col(f"d_{c}")).cast("int"))]
    return d.withColumn("near", F.create_map(*flat)).drop(*[f"d_{c}" for c in wanted])


BANDS, SALTS = 63, 64
ANY = "*"


def _band(price: Column) -> Column:
    """Number of the price's power of two; null without a price."""
    return F.when(price.isNotNull(), F.floor(F.log2(F.greatest(price.cast("double"), F.lit(1.0)))).cast("int"))


def _filed(intents: DataFrame) -> DataFrame:
    """Requests under the keys their listings have: kind, locality, price band; what a request leaves open is filed as such."""
    asked = intents.select(F.struct(*intents.columns).alias("q"))
    q = lambda n: F.col(f"q.{n}")
    kinds = F.when(F.coalesce(F.size(q("kinds")), F.lit(0)) > 0, F.array_distinct(q("kinds"))).otherwise(F.array(F.lit(ANY)))
    open_ = q("price_min").isNull() & q("price_max").isNull()
    low, high = F.coalesce(_band(q("price_min")), F.lit(0)), F.coalesce(_band(q("price_max")), F.lit(BANDS))
    bands = F.when(open_, F.array(F.lit(-1))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return asked.withColumn("_kind", F.explode(kinds)).withColumn("_place", F.coalesce(q("locality"), F.lit(ANY))).withColumn("_band", F.explode(bands))


def ranked_search(listings: DataFrame, features: DataFrame, intents: DataFrame, k: int = 20) -> DataFrame:
    """Best k listings per intent by index, closeness to the requested categories and to an anchor.

    Intents are a table of any size. They meet the listings by join on kind,
    locality and price band: a request lies under the bands its price range
    covers, an open bound under one band of its own, and every listing looks
    under its own values and under the open ones. Best rows are kept per part of
    an intent's listings first, so no intent is ranked in one place. Hard matches
    (every requested category within reach) are preferred; an intent without
    any is answered with soft ones (`relaxed`). `met` tells for each requested
    category whether it is within reach. `listings` needs kind, locality,
    amenities (array) and the scores.
    """
    # Names of categories come from a fixed vocabulary, so they are few.
    wanted = sorted(r[0] for r in intents.select(F.explode("categories")).distinct().limit(10_000).collect())
    base = listings.where("lon is not null and lat is not null and composite is not null")
    # A missing price is no placeholder: the row stays.
    base = base.where(~F.coalesce(F.col("kind").isin("Casa", "Apartamento", "Apartaestudio") & (F.col("price") < 30_000_000), F.lit(False)))
    base = poi_distances(base, features, wanted) if wanted else base.withColumn("near", F.lit(None).cast("map<string,int>"))
    look = base.withColumn("_kind", F.explode(F.array(F.lit(ANY), F.col("kind")))).withColumn("_place", F.explode(F.array(F.lit(ANY), F.upper("locality")))).withColumn("_band", F.explode(F.array(F.lit(-1), _band(F.col("price")))))
    d = look.join(_filed(intents), ["_kind", "_place", "_band"]).drop("_kind", "_place", "_band")
    q = lambda n: F.col(f"q.{n}")
    ok = F.lit(True)
    for lo, col in (("price_min", "price"), ("area_min", "area"), ("rooms_min", "rooms"), ("baths_min", "baths"), *[(f"{f}_min", f) for f in FLOORS]):
        ok = ok & (q(lo).isNull() | F.coalesce(F.col(col) >= q(lo), F.lit(False)))
    for hi, col in (("price_max", "price"), ("area_max", "area")):
        ok = ok & (q(hi).isNull() | F.coalesce(F.col(col) <= q(hi), F.lit(False)))
    if "amenities" in listings.columns:
        ok = ok & ((F.coalesce(F.size(q("amenities")), F.lit(0)) <= 0) | (F.size(F.array_except(q("amenities"), F.col("amenities"))) == 0))
    from plotwise.functions.spatial import haversine

    d = d.withColumn("d_anchor", F.when(q("anchor_lat").isNotNull(), F.bround(haversine("lon", "lat", q("anchor_lon"), q("anchor_lat"))).cast("int")))
    d = d.where(ok & (q("anchor_lat").isNull() | (F.col("d_anchor") <= q("anchor_m"))))
    reach = F.transform(q("categories"), lambda c: F.when(F.try_element_at(F.col("near"), c) <= q("max_m"), F.try_element_at(F.col("near"), c)))
    d = d.withColumn("dists", reach).withColumn("n_req", F.coalesce(F.size(q("categories")), F.lit(0)))
    close = F.aggregate("dists", F.lit(0.0), lambda a, x: a + F.coalesce(F.greatest(F.lit(0.0), 1 - x / q("max_m")), F.lit(0.0)))
    score = F.col("composite") / 5.0 * SCORE_WEIGHTS["index"]
    score = score + F.when(F.col("n_req") > 0, close / F.col("n_req") * SCORE_WEIGHTS["proximity"]).otherwise(0.0)
    score = score + F.when(q("anchor_lat").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("d_anchor") / q("anchor_m")) * SCORE_WEIGHTS["anchor"]).otherwise(0.0)
    hard = (F.col("n_req") == 0) | (F.size(F.array_compact("dists")) == F.col("n_req"))
    d = d.withColumns({"intent": q("intent"), "score": F.round(score, 9), "hard": hard, "met": F.transform("dists", lambda x: x.isNotNull()), "_salt": F.pmod(F.xxhash64("id"), F.lit(SALTS))})
    best = [F.desc("hard"), F.desc("score"), "id"]
    part = d.withColumn("_rn", F.row_number().over(Window.partitionBy("intent", "_salt").orderBy(*best))).where(F.col("_rn") <= k).drop("_rn", "_salt")
    top = part.withColumn("rn", F.row_number().over(Window.partitionBy("intent").orderBy(*best))).where(F.col("rn") <= k)
    any_hard = F.max("hard").over(Window.partitionBy("intent"))
    return top.withColumn("_any", any_hard).where(F.col("hard") | ~F.col("_any")).withColumn("relaxed", ~F.col("_any")).drop("_any", "near")


def explain_hits(hits: DataFrame) -> DataFrame:
    """Human wording of why a listing matched, one string per hit."""
    from plotwise.functions.labels import lookup, walking_minutes

    q = lambda n: F.col(f"q.{n}")
    filt = F.when((F.coalesce(F.size(q("kinds")), F.lit(0)) > 0) | q("area_min").isNotNull() | q("rooms_min").isNotNull(),
                  F.concat_ws(" · ", F.col("kind"), F.concat(F.col("area").cast("int").cast("string"), F.lit(" m²")), F.concat(F.col("rooms").cast("string"), F.lit(" habs"))))
    near = F.transform(F.arrays_zip(q("categories").alias("c"), F.col("dists").alias("d")), lambda e: F.when(e["d"].isNotNull(), F.concat(
        F.lit("a "), e["d"].cast("string"), F.lit(" m del "), lookup(tx.CATEGORY_LABELS, e["c"]), F.lit(" más cercano · ~"), walking_minutes(e["d"]).cast("string"), F.lit(" min a pie"))))
    index = F.concat(F.lit("Índice "), F.format_number("composite", 2), F.lit("/5"), F.when(q("security_min").isNotNull() & F.col("security").isNotNull(), F.concat(
        F.lit(" · Seguridad "), F.format_number("security", 2))).otherwise(""))
    return hits.withColumn("explanation", F.concat_ws(" | ", filt, F.array_join(F.array_compact(F.coalesce(near, F.array().cast("array<string>"))), " | "), index, F.col("locality")))


def suggestions(intents: DataFrame, hits: DataFrame) -> DataFrame:
    """Up to four ways to refine every intent, from its filters and its number of hits."""
    n = hits.groupBy("intent").agg(F.count("*").alias("n"), F.min_by("locality", F.col("rn")).alias("top_locality"))
    d = intents.join(n, "intent", "left").fillna(0, ["n"])
    first = F.get("categories", 0)
    low_kind = F.lower(F.get("kinds", 0))
    alt = F.when(F.get("kinds", 0) == "Apartamento", "casa").otherwise("apartamento")
    opts = F.array_compact(F.array(
        F.when((F.col("n") < 3) & first.isNotNull(), F.concat(F.lit("Ampliar radio a "), F.least(F.col("max_m") + 500, F.lit(2500)).cast("string"), F.lit(" m"))),
        F.when((F.col("n") >= 5) & F.col("composite_min").isNull(), F.lit("Solo zonas con buen índice (≥ 3.5)")),
        F.when(F.col("price_max").isNull() & F.col("price_min").isNull(), F.lit("Limitar presupuesto a 500M")),
        F.when(F.col("locality").isNull() & F.col("top_locality").isNotNull(), F.concat(F.lit("Sólo en "), F.initcap("top_locality"))),
        F.when(F.size("kinds") == 1, F.concat(F.lit("Comparar con "), alt, F.lit("s"))),
        F.when(F.col("security_min").isNull() & ~F.lower("text").contains("seguridad"), F.lit("Priorizar zonas muy seguras"))))
    opts = F.when(F.size(opts) == 0, F.array(F.lit("Ver más resultados similares"))).otherwise(F.slice(opts, 1, 4))
    return d.select("intent", "n", F.array_join(opts, "|").alias("suggestions"))


def near_any(listings: DataFrame, pois: DataFrame, categories: list[str], radius: float) -> DataFrame:
    """Listings with a POI of one of the categories within the radius."""
    from plotwise.operators import geo

    f = geo.as_features(pois.where(F.col("category").isin(categories)).select("lon", "lat")).distinct()
    hit = geo.radius_pairs(geo.locations(listings), f, radius).select("lon", "lat").distinct()
    return listings.join(hit, ["lon", "lat"], "left_semi")


# ------------------------------------------------------------------ vectors


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per label."""
    long = vectors.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def cache_upkeep(uses: DataFrame, key: list[str], ts: str, now: Column, days: int = 7) -> DataFrame:
    """Hits and last use per entry, and whether it stays."""
    a = uses.groupBy(*key).agg(F.count("*").alias("hits"), F.max(ts).alias("last_used"))
    return a.withColumn("keep", F.col("last_used") >= now - F.make_interval(days=F.lit(days)))
