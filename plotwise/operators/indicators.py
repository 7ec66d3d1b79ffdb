"""The five sub-indices, the composite index and the opportunity table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import labels as lb
from plotwise.operators import geo
from plotwise.operators.ranking import exact_quantiles, join_on, percent_score, with_ranks

# Radii, weights, defaults and profiles.
TRANSIT_RADII = {"transmilenio": 1000, "sitp": 500, "vias": 500, "metro": 1500}
AMENITY_RADII = {"parque": 800, "ips": 1500, "colegio": 1000, "universidad": 2000}
SERVICE_GROUPS = {
    "health": (["farmacia", "ips", "hospital", "clinica"], 1000, 0.20),
    "education": (["colegio", "universidad", "jardin"], 1500, 0.20),
    "supply": (["centro_comercial", "supermercado", "plaza_mercado", "tienda"], 800, 0.25),
    "culture": (["biblioteca", "teatro", "museo"], 2000, 0.15),
    "recreation": (["parque", "cancha", "escenario_deportivo"], 1500, 0.20)}
CLASS_GROUPS = {
    "health": (["ips", "farmacia"], 1000), "education": (["colegio", "universidad"], 800),
    "commerce": (["centro_comercial", "plaza_mercado"], 1500), "culture": (["biblioteca", "teatro"], 2000),
    "recreation": (["parque", "cancha_futbol"], 500)}
PROFILES = {
    "equilibrado": {"health": 0.20, "education": 0.20, "commerce": 0.20, "culture": 0.20, "recreation": 0.20},
    "familiar": {"health": 0.30, "education": 0.30, "commerce": 0.15, "culture": 0.10, "recreation": 0.15},
    "urbano": {"health": 0.15, "education": 0.10, "commerce": 0.30, "culture": 0.30, "recreation": 0.15},
    "deportivo": {"health": 0.20, "education": 0.10, "commerce": 0.15, "culture": 0.10, "recreation": 0.45}}
SECURITY_WEIGHTS = {"posts": 0.35, "crime": 0.45, "sector": 0.20}
SECURITY_PROFILES = {"equilibrado": (0.34, 0.33, 0.33), "recomendado": (0.40, 0.30, 0.30), "objetivo": (0.30, 0.50, 0.20),
                     "percepcion": (0.25, 0.25, 0.50)}
POSTS_CAP = 2.0
ZONING_WEIGHTS = {"treatment": (0.4, 2.5), "buildability": (0.4, 2.5), "activity": (0.2, 3.0)}
COMPOSITE_FOUR = {"access": 0.25, "security": 0.20, "dwelling": 0.25, "zoning": 0.30}
COMPOSITE_PRESETS = {
    "equal": {"access": 0.25, "security": 0.25, "dwelling": 0.25, "zoning": 0.25},
    "investment": {"access": 0.20, "security": 0.15, "dwelling": 0.20, "zoning": 0.45},
    "residential": {"access": 0.30, "security": 0.30, "dwelling": 0.30, "zoning": 0.10}}
FIVE = ["access", "security", "services", "dwelling", "zoning"]
CRIME_WEIGHTS = (0.45, 0.25, 0.20, 0.10)
DECAY_LAYERS = {"sitp": 800, "cai": 800}


def _add(parts):
    return reduce(lambda a, b: a + b, parts)


def layered(features: DataFrame, layer: str, radii: dict[str, float]) -> DataFrame:
    """Features of the named layers with their radius class."""
    return features.where(F.col(layer).isin(list(radii))).withColumn("radius", lb.lookup({k: float(v) for k, v in radii.items()}, F.col(layer)))


def gravity_scores(points: DataFrame, features: DataFrame, layer: str, radii: dict[str, float]) -> DataFrame:
    """Per layer: sum of max(0, 1 - Manhattan/radius) over features whose straight distance is within the radius."""
    aggs = {}
    for name, r in radii.items():
        part = F.when(F.col(layer) == name, F.col("mult") * F.greatest(F.lit(0.0), 1 - F.col("manhattan") / float(r)))
        aggs[f"g_{name}"] = F.coalesce(F.sum(part), F.lit(0.0))
        aggs[f"n_{name}"] = F.coalesce(F.sum(F.when(F.col(layer) == name, F.col("mult"))), F.lit(0))
    out = geo.radius_aggregate(points, layered(features, layer, radii), "radius", aggs, keys=[layer], planar=True)
    return out.fillna(0.0, [f"g_{n}" for n in radii]).fillna(0, [f"n_{n}" for n in radii])


def weighted_final(df: DataFrame, weights: dict[str, float], by: str, out: str) -> DataFrame:
    """Weighted raw score scaled per group to 0-5 by its own range; 2.5 where a group has no range."""
    d = df.withColumn("pc1", _add([F.col(c) * w for c, w in weights.items()]))
    rng = d.groupBy(by).agg(F.min("pc1").alias("_mn"), F.max("pc1").alias("_mx"))
    span = F.col("_mx") - F.col("_mn")
    score = F.when(span > 0, lb.clip(5 * (F.col("pc1") - F.col("_mn")) / F.nullif(span, F.lit(0.0)))).otherwise(2.5)
    return join_on(d, rng, [by], "left").withColumn(out, score).drop("_mn", "_mx")


def station_access(points: DataFrame, stations: DataFrame, fid: str, out: str = "access") -> DataFrame:
    """clip(5 - metres to the nearest station / 500), two decimals."""
    near = geo.nearest(points, geo.as_features(stations.select(fid, "lon", "lat")), 1, fid=fid)
    score = lb.half_up(lb.clip(5 - F.col("dist") / 500.0))
    return join_on(points, near.select("lon", "lat", score.alias(out)), ["lon", "lat"], "left")


# ------------------------------------------------------------------ security


def security_raw(points: DataFrame, posts: DataFrame, zones: DataFrame, zone_id: str, mass: str, sectors: DataFrame) -> DataFrame:
    """Police-post gravity within 800 m, crime mass of the containing zone, closeness to a priority sector."""
    cai = geo.radius_aggregate(points, posts, 800.0, {
        "posts": F.sum(F.col("mult") * F.greatest(F.lit(0.0), 1 - F.col("dist") / 800.0)), "n_posts": F.sum("mult")}, planar=True)
    cai = cai.fillna(0.0, ["posts"]).fillna(0, ["n_posts"])
    crime = geo.one_polygon(cai, zones.select(zone_id, F.col(mass).alias("crime"), "rings"), zone_id, [zone_id, "crime"])
    crime = crime.withColumn("crime", F.coalesce("crime", F.lit(0.0)))

    def near_sector(locs):
        d = geo.polygons_within(locs, sectors.select("rings"), 200.0).groupBy("lon", "lat").agg(F.min("dist").alias("_d"))
        return d.select("lon", "lat", F.greatest(F.lit(0.0), 1 - F.col("_d") / 200).alias("sector"), (F.col("_d") == 0).alias("in_sector"))

    return geo.per_location(crime, near_sector).fillna(0.0, ["sector"]).fillna(False, ["in_sector"])


def security_bounds(raw: DataFrame, by: str = "kind") -> DataFrame:
    """Normalization bounds per kind; the post score saturates at two."""
    return raw.groupBy(by).agg(F.min("posts").alias("posts_min"), F.least(F.max("posts"), F.lit(POSTS_CAP)).alias("posts_max"),
                               F.min("crime").alias("crime_min"), F.max("crime").alias("crime_max"), F.count("*").alias("samples"))


def security_final(raw: DataFrame, bounds: DataFrame, by: str = "kind", w: dict[str, float] = SECURITY_WEIGHTS) -> DataFrame:
    d = join_on(raw, bounds, [by])
    posts = 5 * F.least("posts", "posts_max") / F.nullif(F.col("posts_max"), F.lit(0.0))
    span = F.col("crime_max") - F.col("crime_min")
    crime = 5 * F.when(span > 0, (F.col("crime") - F.col("crime_min")) / F.nullif(span, F.lit(0.0))).otherwise(0.5)
    sector = 5 * F.col("sector")
    # A kind without any post in reach has no post scale; its score is zero, as in the stored view.
    score = F.coalesce(lb.clip(w["posts"] * posts + w["crime"] * (5 - crime) + w["sector"] * (5 - sector)), F.lit(0.0))
    return d.withColumns({"posts_norm": posts, "crime_norm": crime, "sector_norm": sector, "security_micro": score}).drop(
        "posts_min", "posts_max", "crime_min", "crime_max", "samples")


def security_three_dims(micro: DataFrame, zone_scores: DataFrame, key: str, profile: str = "recomendado") -> DataFrame:
    """micro + objective + perceived, both zone scores inverted; zones without scores fall back to micro."""
    wm, wo, ws = SECURITY_PROFILES[profile]
    d = micro.join(zone_scores.select(key, "objective", "subjective"), key, "left")
    inv = lambda c: F.coalesce(5.0 - lb.clip(F.col(c)), F.col("security_micro"))
    d = d.withColumns({"objective": inv("objective"), "subjective": inv("subjective")})
    return d.withColumn("security", lb.clip(wm * F.col("security_micro") + wo * F.col("objective") + ws * F.col("subjective")))


def zone_security(mass: Column) -> Column:
    """5 (1 - crime mass), half where the zone has none; two decimals."""
    return lb.half_up(lb.clip(5 * (1 - F.coalesce(mass, F.lit(0.5)))))


# ------------------------------------------------------------------ services


def _grouped(pois: DataFrame, groups: dict) -> DataFrame:
    member = {c: g for g, v in groups.items() for c in v[0]}
    radius = {g: float(v[1]) for g, v in groups.items()}
    d = pois.where(F.col("category").isin(list(member))).withColumn("grp", lb.lookup(member, F.col("category")))
    return d.withColumn("radius", lb.lookup(radius, F.col("grp")))


def service_scores(points: DataFrame, pois: DataFrame, groups: dict = SERVICE_GROUPS) -> DataFrame:
    """Per group: sum of 1/max(d, 50) inside its radius, its count, and the weighted total `services_raw`."""
    aggs = {}
    for g in groups:
        mine = F.col("grp") == g
        aggs[f"s_{g}"] = F.coalesce(F.sum(F.when(mine, F.col("mult") * lb.inverse_decay(F.col("dist")))), F.lit(0.0))
        aggs[f"n_{g}"] = F.coalesce(F.sum(F.when(mine, F.col("mult"))), F.lit(0))
    out = geo.radius_aggregate(points, _grouped(pois, groups), "radius", aggs, keys=["grp"])
    out = out.fillna(0.0, [f"s_{g}" for g in groups]).fillna(0, [f"n_{g}" for g in groups])
    return out.withColumn("services_raw", _add([F.col(f"s_{g}") * v[2] for g, v in groups.items()]))


def service_percentile(points: DataFrame, pois: DataFrame, by: str = "kind") -> DataFrame:
    """Services recomputed for all points and scaled by percentile within the kind."""
    from plotwise.session import stage

    raw = stage(service_scores(points, pois))
    return percent_score(raw, "services_raw", "services", [by])


def simple_services(points: DataFrame, pois: DataFrame, radius: float = 1000.0, per_poi: float = 0.05) -> DataFrame:
    """min(5, 0.05 n) of POIs within the radius, two decimals."""
    d = geo.radius_aggregate(points, pois, radius, {"n_poi": F.sum("mult")}).fillna(0, ["n_poi"])
    return d.withColumn("services", F.round(F.least(F.lit(5.0), F.col("n_poi") * F.lit(per_poi)), 2))


def class_counts(points: DataFrame, pois: DataFrame, groups: dict = CLASS_GROUPS) -> DataFrame:
    aggs = {f"n_{g}": F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("mult"))), F.lit(0)) for g in groups}
    return geo.radius_aggregate(points, _grouped(pois, groups), "radius", aggs, keys=["grp"]).fillna(0, list(aggs))


def profile_services(counts: DataFrame, profiles: dict[str, dict[str, float]] = PROFILES) -> DataFrame:
    """One row per point and weight profile: weighted mean of min(5, count)."""
    score = lambda w: lb.half_up(_add([F.least(F.lit(5.0), F.col(f"n_{g}").cast("double")) * x for g, x in w.items()]) / sum(w.values()))
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), score(w).alias("score")) for p, w in profiles.items()])
    return counts.withColumn("_e", F.explode(rows)).select("*", "_e.profile", "_e.score").drop("_e")


# ------------------------------------------------------- dwelling and zoning


def rule_dwelling() -> Column:
    """clip(0.4 rooms + 0.5 baths + min(area/50, 3)), two decimals."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.round(lb.clip(z("rooms") * 0.4 + z("baths") * 0.5 + F.least(z("area") / 50.0, F.lit(3.0))), 2)


def hedonic_raw(df: DataFrame, coefs: DataFrame, features: list[str], by: str = "kind") -> DataFrame:
    """Linear model score per kind and the residual of ln(price/m²); null without area or model."""
    d = join_on(df, coefs.select(by, F.col("intercept"), *[F.col(f).alias(f"_b_{f}") for f in features]), [by], "left")
    score = F.col("intercept") + _add([F.coalesce(F.col(f"_b_{f}"), F.lit(0.0)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    d = d.withColumn("hedonic", F.when(F.col("area") > 0, score))
    return d.withColumn("residual", F.when((F.col("area") > 0) & (F.col("price") > 0), F.ln(F.col("price") / F.nullif(F.col("area"), F.lit(0.0)))) - F.col("hedonic")).drop(
        "intercept", *[f"_b_{f}" for f in features])


def dimension_pc1(df: DataFrame, loadings: DataFrame, features: list[str], by: str = "kind") -> DataFrame:
    """First size component per kind from stored loadings, means and deviations; missing values add nothing."""
    d = join_on(df, loadings.select(by, *[F.col(f"{p}_{f}").alias(f"_{p}_{f}") for f in features for p in ("phi", "mean", "sd")]), [by], "left")
    z = lambda f: F.when((F.col(f"_sd_{f}") > 0) & F.col(f).isNotNull(), (F.col(f) - F.col(f"_mean_{f}")) / F.nullif(F.col(f"_sd_{f}"), F.lit(0.0))).otherwise(0.0)
    pc = _add([F.coalesce(F.col(f"_phi_{f}"), F.lit(0.0)) * z(f) for f in features])
    known = (F.col(features[0]) > 0) & F.col(f"_phi_{features[0]}").isNotNull()
    return d.withColumn("pc1", F.when(known, pc)).drop(*[f"_{p}_{f}" for f in features for p in ("phi", "mean", "sd")])


def combined_dwelling(dimension: Column, amenity: Column) -> Column:
    """0.7 size + 0.3 amenities; null if either is missing."""
    return dimension * 0.7 + amenity * 0.3


def price_gap_score(points: DataFrame, k: int = 20) -> DataFrame:
    """clip(5 - 5 (own price/m² over the mean of the k nearest listings, itself among them - 1))."""
    d = points.where("lon is not null and area > 0 and price > 0").withColumn("ppm2", F.col("price") / F.col("area"))
    feats = geo.as_features(d.select(F.col("id").alias("fid"), "lon", "lat", F.col("ppm2").alias("fppm2")))
    near = geo.nearest(d, feats, k, fid="fid").groupBy("lon", "lat").agg(F.avg("fppm2").alias("around"))
    out = join_on(d, near, ["lon", "lat"]).withColumn("ratio", F.col("ppm2") / F.col("around"))
    return out.withColumn("dwelling_gap", lb.clip(5.0 - (F.col("ratio") - 1.0) * 5.0))


def zoning_potential(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Best score per zoning layer at the point, defaults where none, weighted 0.4/0.4/0.2."""
    score = F.when(F.col("layer") == "treatment", lb.treatment_score(F.col("value"))).when(
        F.col("layer") == "buildability", lb.build_score(F.col("value"))).when(F.col("layer") == "activity", lb.activity_score(F.col("value")))
    polys = layers.select("layer", score.alias("score"), "rings")

    def fn(locs):
        return geo.point_in_polygon(locs, polys).groupBy("lon", "lat").agg(
            *[F.max(F.when(F.col("layer") == n, F.col("score"))).alias(f"z_{n}") for n in ZONING_WEIGHTS])

    d = geo.per_location(points, fn)
    total = _add([F.coalesce(F.col(f"z_{n}"), F.lit(dflt)) * w for n, (w, dflt) in ZONING_WEIGHTS.items()])
    return d.withColumn("zoning", F.when(F.col("lon").isNotNull(), lb.clip(total)))


def zoning_overlay(points: DataFrame, layers: DataFrame, names: list[str]) -> DataFrame:
    """Value of every layer at the point; the smallest polygon id decides where several overlap."""

    def fn(locs):
        hits = geo.point_in_polygon(locs, layers.select("layer", "poly_id", "value", "rings"))
        return hits.groupBy("lon", "lat").agg(*[F.min_by("value", F.when(F.col("layer") == n, F.struct("poly_id", "value"))).alias(n) for n in names])

    return geo.per_location(points, fn)


# ----------------------------------------------------------------- composite


def composite(mode: str = "five", weights: dict[str, float] | None = None, least: int = 2) -> Column:
    """Composite index.

    five: mean of five, missing = 0. skip: weighted mean of the present ones, null
    below `least` of them. neutral: table weights, missing = 2.5, three decimals.
    """
    if mode == "five":
        return lb.half_up(_add([F.coalesce(F.col(c), F.lit(0.0)) for c in FIVE]) * 0.20)
    if mode == "skip":
        w = weights or COMPOSITE_FOUR
        n = _add([F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in w])
        num = _add([F.coalesce(F.col(c) * x, F.lit(0.0)) for c, x in w.items()])
        den = _add([F.when(F.col(c).isNotNull(), F.lit(x)).otherwise(0.0) for c, x in w.items()])
        return F.when((n >= least) & (den > 0), lb.clip(lb.half_up(num / F.nullif(den, F.lit(0.0)))))
    if mode in ("neutral", "unit"):
        w = weights or {c: 1.0 for c in FIVE}
        miss = 2.5 if mode == "neutral" else 0.0
        return lb.half_up(_add([F.coalesce(F.col(c), F.lit(miss)) * x for c, x in w.items()]) / sum(w.values()), 3)
    raise ValueError(mode)


def price_per_point(price: str = "price", index: str = "composite") -> Column:
    ok = (F.col(index) > 0) & (F.col(price) > 0)
    return F.when(ok, lb.half_up(F.col(price) / F.nullif(F.col(index), F.lit(0.0))))


def opportunity_class(index: Column, pct: Column) -> Column:
    return lb.chain([((index >= 4.0) & (pct <= 0.25), "Excelente Oportunidad"), ((index >= 3.5) & (pct <= 0.33), "Muy Buena Oportunidad"),
                     ((index >= 3.0) & (pct <= 0.50), "Buena Oportunidad"), (pct <= 0.50, "Oportunidad Razonable"),
                     (pct >= 0.75, "Sobrevalorado")], "Precio Justo")


def opportunity_table(df: DataFrame, by: str = "kind") -> DataFrame:
    """Price per index point, its percentile overall and within the kind, and the opportunity class."""
    d = df.withColumn("ratio", price_per_point()).where(F.col("ratio").isNotNull())
    d = with_ranks(d, {"a_": ("ratio", [], False), "k_": ("ratio", [by], False)})
    return d.withColumns({
        "pct_ratio": lb.half_up(F.col("a_pct_rank") * 100, 1), "pct_ratio_kind": lb.half_up(F.col("k_pct_rank") * 100, 1),
        "price_m2": lb.half_up(F.try_divide(F.col("price").cast("double"), F.nullif(F.col("area"), F.lit(0.0))), 0),
        "class": opportunity_class(F.col("composite"), F.col("a_pct_rank")),
    }).drop(*[f"{p}_{x}" for p in "ak" for x in ("rank", "avg_rank", "pct_rank", "n")])


def propagate_zone_scores(points: DataFrame, barrios: DataFrame, zones: DataFrame, scores: list[str]) -> DataFrame:
    """Scores from the neighbourhood, missing ones from its zone; own dwelling score kept; index recomputed."""
    filled = barrios.join(zones.select("zone_id", *[F.col(s).alias(f"_z_{s}") for s in scores]), "zone_id", "left")
    filled = filled.select("barrio_id", *[F.coalesce(s, f"_z_{s}").alias(f"_s_{s}") for s in scores], F.lit(True).alias("_has"))
    d = points.join(filled, "barrio_id", "left")
    d = d.withColumns({s: F.when(F.col("_has"), F.col(f"_s_{s}")).otherwise(F.col(s)) for s in scores}).drop("_has", *[f"_s_{s}" for s in scores])
    return d.withColumn("composite", composite("unit"))


def point_study(points: DataFrame, stations: DataFrame, listings: DataFrame, layers: DataFrame) -> DataFrame:
    """Indices at arbitrary coordinates: stop gravity, neighbour means, zoning, composite."""
    g = gravity_scores(points, stations, "layer", {"sitp": 800, "transmilenio": 1500})
    g = g.withColumn("access", lb.half_up(F.col("g_sitp") + F.col("g_transmilenio"))).drop("g_sitp", "g_transmilenio", "n_sitp", "n_transmilenio")
    g = geo.neighbour_average(g, listings, "security", 1000.0, "security", 3.0)
    g = geo.neighbour_average(g, listings, "dwelling", 500.0, "dwelling", 3.0)
    g = zoning_potential(g.withColumns({"security": lb.half_up(F.col("security")), "dwelling": lb.half_up(F.col("dwelling"))}), layers)
    known = F.col("z_treatment").isNotNull() & F.col("z_buildability").isNotNull() & F.col("z_activity").isNotNull()
    g = g.withColumn("zoning", F.when(known, lb.half_up(F.col("zoning")))).drop("z_treatment", "z_buildability", "z_activity")
    return g.withColumn("composite", composite("skip", COMPOSITE_FOUR, 1))


def study_valuation(studies: DataFrame, listings: DataFrame, most: int = 50) -> DataFrame:
    """Estimated price: mean price/m² of the first `most` (by id) listings of the same kind and rooms with area within 20 %, times the area.

    Only the `most` smallest ids of each exact area can count, so every area is
    trimmed to that before the band join; areas meet through logarithmic bins.
    """
    import math

    from pyspark.sql import Window

    width = -math.log(0.8) * 1.000001
    cell = lambda a: F.floor(F.ln(a) / width)
    trim = Window.partitionBy("kind", "rooms", "_a").orderBy("id")
    l = listings.where("area > 0 and price is not null and composite is not null").select("id", "kind", "rooms", F.col("area").alias("_a"), "price")
    l = l.withColumn("_rn", F.row_number().over(trim)).where(F.col("_rn") <= most).drop("_rn")
    l = l.withColumn("_b", F.explode(F.sequence(cell(F.col("_a")) - 1, cell(F.col("_a")) + 1)))
    s = studies.where("area > 0").select("kind", "rooms", "area").distinct().withColumn("_b", cell(F.col("area")))
    j = s.join(l, ["kind", "rooms", "_b"]).where(F.col("_a").between(F.col("area") * 0.8, F.col("area") * 1.2))
    w = Window.partitionBy("kind", "rooms", "area").orderBy("id")
    j = j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    est = j.groupBy("kind", "rooms", "area").agg(F.avg(F.col("price") / F.col("_a")).alias("price_m2"), F.count("*").alias("n_similar"))
    out = studies.join(est, ["kind", "rooms", "area"], "left")
    return out.withColumn("estimate", lb.half_up(F.col("price_m2") * F.col("area"), 0).cast("bigint")).fillna(0, ["n_similar"])


def market_comparison(studies: DataFrame, table: DataFrame, half_width: float = 0.5) -> DataFrame:
    """Count, mean price and mean ratio of same-kind listings whose index is within the half width.

    Listings are summed per index value (two decimals), so the band join runs over
    at most a few hundred values per kind.
    """
    t = table.groupBy("kind", F.col("composite").alias("_c")).agg(F.count("*").alias("_n"), F.sum("price").alias("_p"), F.sum("ratio").alias("_r"))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_c") / half_width) - 1, F.floor(F.col("_c") / half_width) + 1)))
    s = studies.select("kind", "composite").distinct().withColumn("_b", F.floor(F.col("composite") / half_width))
    near = s.join(t, ["kind", "_b"]).where(F.col("_c").between(F.col("composite") - half_width, F.col("composite") + half_width))
    agg = near.groupBy("kind", "composite").agg(F.sum("_n").alias("n_market"), (F.sum("_p") / F.sum("_n")).alias("market_price"),
                                                (F.sum("_r") / F.sum("_n")).alias("market_ratio"))
    return studies.join(agg, ["kind", "composite"], "left").fillna(0, ["n_market"])


def nearest_layer_distances(points: DataFrame, features: DataFrame, layer: str, names: list[str], fid: str) -> DataFrame:
    """Metres to the nearest feature of each layer, in one search keyed by layer."""
    f = geo.as_features(features.where(F.col(layer).isin(names)).select(fid, F.col(layer).alias("_layer"), "lon", "lat"))

    def fn(locs):
        q = locs.withColumn("_layer", F.explode(F.lit(names)))
        near = geo.nearest(q, f, 1, fid=fid, by=["_layer"])
        return near.groupBy("lon", "lat").agg(*[F.min(F.when(F.col("_layer") == n, F.col("dist"))).alias(f"d_{n}") for n in names])

    return geo.per_location(points, fn)


def decay_comparison(points: DataFrame, features: DataFrame, layer: str, radii: dict[str, float]) -> DataFrame:
    """Gaussian, linear and inverse kernel sums per layer, and the relative difference of their totals."""
    aggs, d, m = {}, F.col("dist"), F.col("mult")
    for n, r in radii.items():
        mine = F.col(layer) == n
        for k, e in (("gaussian", lb.gaussian_decay(d, F.lit(lb.calibrated_sigma(r)))), ("linear", lb.linear_decay(d, float(r))), ("inverse", lb.inverse_decay(d))):
            aggs[f"{k}_{n}"] = F.coalesce(F.sum(F.when(mine, m * e)), F.lit(0.0))
    out = geo.radius_aggregate(points, layered(features, layer, radii), "radius", aggs, keys=[layer]).fillna(0.0, list(aggs))
    g, l = _add([F.col(f"gaussian_{n}") for n in radii]), _add([F.col(f"linear_{n}") for n in radii])
    return out.withColumn("difference_pct", F.when(l > 0, (g - l) / F.nullif(l, F.lit(0.0)) * 100).otherwise(0.0))


def ratio_distribution(table: DataFrame) -> DataFrame:
    return exact_quantiles(table, "ratio", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["kind"])
