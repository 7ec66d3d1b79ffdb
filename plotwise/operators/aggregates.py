"""Grouped summaries of listings, amenities, zones and surveys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import labels as lb
from plotwise.operators.ranking import average_ranks, exact_quantiles, join_on

# Amenity patterns of the wide view, amenity weights.
AMENITY_FLAGS = {
    "has_pool": ["%piscina%"], "has_gym": ["%gimnasio%"], "has_parking": ["%parqueadero%", "%garaje%"],
    "has_guard": ["%vigilancia%", "%porter%", "%seguridad privada%"], "has_lift": ["%ascensor%"],
    "has_hall": ["%salon%comunal%", "%salón%comunal%"], "has_bbq": ["%bbq%", "%asadero%"], "has_court": ["%cancha%"],
    "has_spa": ["%jacuzzi%", "%sauna%", "%turco%"], "has_storage": ["%depósito%", "%deposito%"]}
AMENITY_WEIGHTS = {
    "piscina": 2.0, "gimnasio": 2.0, "cancha deportiva": 2.0, "zona de parrilla": 1.8, "salón social": 1.8,
    "ascensor": 1.5, "portería 24 horas": 1.5, "zonas verdes": 1.5, "parqueadero cubierto": 1.5, "parqueadero visitantes": 1.3,
    "balcón": 1.0, "terraza": 1.0, "depósito": 1.0, "cuarto útil": 1.0, "calentador": 1.0,
    "centros comerciales cercanos": 1.2, "acceso pavimentado": 1.0, "área urbana": 0.8,
    "administración": 1.5, "detector de humo": 1.2, "escalera de emergencia": 1.2}
# Readings of the security clusters.
PARADOX_LABELS = {
    "bajo_alto": "PARADOJA: Baja criminalidad pero alta percepcion de inseguridad",
    "alto_bajo": "HABITUACION: Alta criminalidad pero baja percepcion",
    "bajo_bajo": "SEGURO: Baja criminalidad y baja percepcion",
    "alto_alto": "CRITICO: Alta criminalidad y alta percepcion"}


def mean_of(cols: list[str], digits: int = 6, suffix: str = "") -> list[Column]:
    return [F.round(F.avg(x), digits).alias(f"avg_{x}{suffix}") for x in cols]


def zone_statistics(zones: DataFrame, listings: DataFrame, key: str, name: str, scores: list[str], kinds: dict[str, str]) -> DataFrame:
    """Per zone, empty zones kept: counts, price range, score means, counts of chosen kinds."""
    per = listings.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), *mean_of(scores),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{a}") for a, k in kinds.items()])
    return zones.select(key, name).join(per, key, "left").fillna(0, ["n"] + [f"n_{a}" for a in kinds])


def price_distribution(df: DataFrame, by: str = "kind") -> DataFrame:
    base = df.where("price is not null and area is not null")
    agg = base.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.avg("area").alias("avg_area"), F.avg(F.try_divide(F.col("price").cast("double"), F.col("area"))).alias("avg_price_m2"))
    q = exact_quantiles(base, "price", {"p25": 0.25, "median": 0.5, "p75": 0.75}, [by])
    return join_on(agg, q, [by])


def group_averages(df: DataFrame, by: list[str], cols: list[str], at_least: int) -> DataFrame:
    """Means per group, groups below `at_least` rows dropped."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *mean_of(cols)).where(F.col("n") >= at_least)


def score_summary(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """Coverage, mean, spread, range and quartiles of one score."""
    by = list(by)
    agg = df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
        F.min(col).alias("min"), F.max(col).alias("max")).withColumn("cover_pct", F.col("n") * 100.0 / F.col("total"))
    q = exact_quantiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    if by:
        return join_on(agg, q, by, "left")
    one = F.lit(1)
    return agg.withColumn("_k", one).join(q.withColumn("_k", one), "_k", "left").drop("_k")


def share_histogram(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """Rows per label and their share; the window runs over the handful of labels."""
    h = df.groupBy(label.alias(name)).agg(F.count("*").alias("n"))
    return h.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def width_histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    b = F.width_bucket(F.col(col), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))


def box_statistics(df: DataFrame, cols: list[str]) -> DataFrame:
    """Five numbers per column, stacked."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).cast("double").alias("v")) for x in cols])).alias("e"))
    return exact_quantiles(long.select("e.dim", "e.v"), "v", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, ["dim"])


def correlation_pairs(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """Correlation of every column pair in one aggregate; Spearman ranks the columns first."""
    if method == "spearman":
        df = average_ranks(df.dropna(subset=cols), cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r"))
                                          for a, b in pairs])).alias("e")).select("e.*")


# ---------------------------------------------------------------- amenities


def amenity_catalog(am: DataFrame, pattern: str | None = None, at_least: int = 1) -> DataFrame:
    d = am.where("has")
    if pattern:
        d = d.where(F.col("name").ilike(pattern))
    return d.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def amenity_share(listings: DataFrame, am: DataFrame, zone: str, at_least: int = 3) -> DataFrame:
    """Listings with an amenity per zone, and their share of the zone."""
    loc = listings.where(F.col(zone).isNotNull()).select("id", zone)
    total = loc.groupBy(zone).agg(F.count_distinct("id").alias("zone_listings"))
    n = am.where("has").join(loc, "id").groupBy(zone, "name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("listings"))
    return n.where(F.col("n") >= at_least).join(total, zone).withColumn("pct", F.round(100.0 * F.col("n") / F.col("zone_listings"), 1))


def amenity_flags(listings: DataFrame, am: DataFrame) -> DataFrame:
    """One boolean per amenity family and the number of amenities, in one grouped pass."""
    name = F.col("name")
    match = lambda pats: reduce(lambda a, b: a | b, [name.ilike(p) for p in pats])
    wide = am.where("has").groupBy("id").agg(*[F.bool_or(match(p)).alias(f) for f, p in AMENITY_FLAGS.items()], F.count("*").alias("n_amenities"))
    return listings.select("id").join(wide, "id", "left").fillna(False, list(AMENITY_FLAGS)).fillna(0, ["n_amenities"])


def amenity_score(am: DataFrame, weights: dict[str, float] = AMENITY_WEIGHTS, term: Column | None = None) -> DataFrame:
    """Weighted amenities scaled by the sum of all weights to 0-5; unknown amenities weigh one."""
    top = sum(weights.values())
    d = am.where("has").withColumn("_t", term if term is not None else F.col("name")).withColumn("_w", lb.lookup(weights, F.col("_t"), 1.0))
    # Repeats of a term are counted before the list is built, so the list is as long as the vocabulary.
    t = d.groupBy("id", "_t").agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"))
    return t.groupBy("id").agg(F.sum("_w").alias("raw"), F.sum("_n").alias("n"), F.array_sort(F.collect_set("_t")).alias("amenities")).withColumn(
        "score", lb.clip(F.col("raw") * 5.0 / top))


# -------------------------------------------------------------------- health


def health_counters(df: DataFrame, zone: str = "zone_id") -> DataFrame:
    missing = lambda x: F.count(F.when(F.col(x).isNull(), 1))
    return df.groupBy("kind", "site").agg(
        F.count("*").alias("n"), missing(zone).alias("no_zone"), missing("price").alias("no_price"), missing("lon").alias("no_point"),
        missing("composite").alias("no_index"), missing("area").alias("no_area"))


def level_summary(levels: dict[str, DataFrame], col: str) -> DataFrame:
    parts = [d.agg(F.count("*").alias("n"), F.count(col).alias("with_index"), F.avg(col).alias("mean")).withColumn("level", F.lit(n))
             for n, d in levels.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def overview(df: DataFrame, col: str, date: str, today: Column) -> DataFrame:
    """Whole-table figures: quality bands and rows of the last 7 and 30 days."""
    return df.agg(
        F.count("*").alias("n"), F.avg("price").alias("avg_price"), F.avg(col).alias("avg_index"),
        F.count(F.when(F.col(col) >= 4, 1)).alias("high"), F.count(F.when((F.col(col) >= 3) & (F.col(col) < 4), 1)).alias("middle"),
        F.count(F.when(F.col(col) < 3, 1)).alias("low"), F.count_distinct("kind").alias("kinds"),
        F.count(F.when(F.col(date) >= today - F.expr("INTERVAL 7 DAYS"), 1)).alias("last_7"),
        F.count(F.when(F.col(date) >= today - F.expr("INTERVAL 30 DAYS"), 1)).alias("last_30"))


def weighted_crime(crime: DataFrame, weights: dict[str, float], mode: str = "max") -> DataFrame:
    """Crime mass per zone: weights on counts divided by the largest count, or on raw counts."""
    if mode == "raw":
        mass = reduce(lambda a, b: a + b, [F.col(o) * F.lit(w) for o, w in weights.items()])
        return crime.withColumn("crime_mass", mass)
    tops = crime.agg(*[F.max(o).alias(o) for o in weights])  # one row
    part = lambda o, w: F.lit(w) * F.coalesce(F.col(o) / F.nullif(tops.select(o).scalar(), F.lit(0)), F.lit(0.0))
    return crime.withColumn("crime_mass", F.round(reduce(lambda a, b: a + b, [part(o, w) for o, w in weights.items()]), 4))


def security_paradox(zones: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """Cluster reading per zone with listing count and averages."""
    per = listings.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("security"), 6).alias("avg_security"), F.avg("price").alias("avg_price"))
    return zones.join(per, key, "left").withColumn("reading", lb.lookup(PARADOX_LABELS, F.col("profile"), "Sin clasificar")).fillna(0, ["n"])


# -------------------------------------------------------------------- survey


def pct(cond: Column) -> Column:
    return F.round(F.count(F.when(cond, 1)) / F.count("*") * 100, 1)


def valid_mean(col: str, lo: int = 1, hi: int = 5) -> Column:
    """Mean over answers in the valid range, zero when there are none."""
    return F.coalesce(F.round(F.avg(F.when(F.col(col).between(lo, hi), F.col(col))), 2), F.lit(0.0))


def survey_crosstab(df: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    """Unsafe share, mean score and victim share per cell; small cells dropped."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), pct(F.col("p102") == 2).alias("pct_unsafe"), valid_mean("score").alias("mean_score"),
        pct(F.col("p203") == 1).alias("pct_victim")).where(F.col("n") >= at_least)


def survey_margins(df: DataFrame, keys: list[str]) -> DataFrame:
    """The crosstab with all its margins; a null key stands for "all"."""
    return df.cube(*keys).agg(F.count("*").alias("n"), pct(F.col("p102") == 2).alias("pct_unsafe"), valid_mean("score").alias("mean_score"))


def top_answers(df: DataFrame, key: str, answers: list[str], k: int) -> DataFrame:
    """Most frequent values over several answer columns, per key; ties by value."""
    long = df.select(key, F.explode(F.array(*answers)).alias("answer"))
    n = long.groupBy(key, "answer").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "answer")  # over distinct answers only
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def insecurity_index(df: DataFrame, key: str, *, unsafe: Column, score: str, victim: Column, worse: Column, witness: Column) -> DataFrame:
    """Perceived-insecurity index 0-5: five capped parts with fixed weights."""
    share = lambda cond: F.count(F.when(cond, 1)) / F.count("*")
    a = df.groupBy(key).agg(F.count("*").alias("n"), share(unsafe).alias("_u"), valid_mean(score).alias("mean_score"),
                            F.count(F.when(F.col(score).between(1, 5), 1)).alias("_ns"), share(victim).alias("_v"),
                            share(worse).alias("_a"), share(witness).alias("_t"))
    inv = F.when(F.col("_ns") > 0, (5 - F.col("mean_score")) / 4).otherwise(0.5)
    raw = (F.col("_u") * 0.30 + inv * 0.25 + F.least(F.col("_v") * 4, F.lit(1.0)) * 0.20 + F.col("_a") * 0.15
           + F.least(F.col("_t") * 2, F.lit(1.0)) * 0.10)
    return a.select(key, "n", "mean_score", F.round(F.col("_u") * 100, 1).alias("pct_unsafe"),
                    F.round(F.col("_v") * 100, 1).alias("pct_victim"), F.round(F.col("_v") * 1000, 1).alias("victims_per_1000"),
                    F.round(raw * 5, 2).alias("index"))
