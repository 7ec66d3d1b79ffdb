"""Sub-indices, composite index, opportunity table."""

from pyspark.sql import functions as F

from plotwise.fixtures import KINDS, OFFENCES
from plotwise.functions import labels as lb
from plotwise.operators import aggregates as ag
from plotwise.operators import geo
from plotwise.operators import indicators as ind
from plotwise.registry.a_functions import ACT_SQL, BUILD_SQL, TREAT_SQL
from plotwise.registry.b_relational import OPP_SQL
from plotwise.registry.c_geo import BOX, HAV, INSIDE, KX, KY, MANH, PLAN
from plotwise.registry.core import query

c = F.col
R = lambda n, d=6: F.round(c(n), d).alias(n)
_r = lambda x, d=6: f"round({x}, {d})"
# Through text, so the engine rounds the shortest decimal form as Spark does.
dec2s = lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(28,10)), 2) AS DOUBLE)"
dec2 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(24,10)), 2) AS DOUBLE)"


def gravity_sql(feat, layer, radii, extra=""):
    cols = ", ".join(f"coalesce(sum(CASE WHEN b.{layer}='{n}' AND {PLAN} <= {r} THEN greatest(0.0e0, 1-{MANH}/{r}) END), 0) AS g_{n}, "
                     f"count(*) FILTER (b.{layer}='{n}' AND {PLAN} <= {r}) AS n_{n}" for n, r in radii.items())
    return f"SELECT a.id, {cols}{extra} FROM listing a LEFT JOIN {feat} b ON {BOX(1.02 * max(radii.values()))} GROUP BY a.id"


def rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" if n[:2] != "n_" else n for n in names)


_T = {k: r for k, r in ind.TRANSIT_RADII.items() if k != "metro"}
_A = ind.AMENITY_RADII
_gcols = lambda radii: [f"{p}_{n}" for n in radii for p in "gn"]


@query("ind_1_transit_gravity", f"SELECT id, {rounded(_gcols(_T))} FROM ({gravity_sql('station', 'layer', _T)})")
def _(v):
    d = ind.gravity_scores(v.listing.select("id", "lon", "lat"), v.station, "layer", _T)
    return d.select("id", *[R(f"g_{n}") for n in _T], *[f"n_{n}" for n in _T])


@query("ind_2_amenity_gravity", f"SELECT id, {rounded(_gcols(_A))} FROM ({gravity_sql('poi', 'category', _A)})")
def _(v):
    d = ind.gravity_scores(v.listing.select("id", "lon", "lat"), v.poi, "category", _A)
    return d.select("id", *[R(f"g_{n}") for n in _A], *[f"n_{n}" for n in _A])


_W = {"transmilenio": 0.5, "sitp": 0.3, "vias": 0.2}


@query("ind_3_transit_final", f"""g AS ({gravity_sql('station', 'layer', _T)}), p AS (SELECT id, kind, {'+'.join(f'g_{n}*{w}e0' for n, w in _W.items())} AS pc1 FROM g JOIN listing USING (id)),
  r AS (SELECT kind, min(pc1) AS mn, max(pc1) AS mx FROM p GROUP BY 1) SELECT id, round(pc1, 6) AS pc1, round(CASE WHEN mx > mn THEN least(5.0e0, greatest(0.0e0, 5*(pc1-mn)/(mx-mn))) ELSE 2.5e0 END, 6) AS score FROM p JOIN r USING (kind)""")
def _(v):
    g = ind.gravity_scores(v.listing.select("id", "kind", "lon", "lat"), v.station, "layer", _T)
    return ind.weighted_final(g, {f"g_{n}": w for n, w in _W.items()}, "kind", "score").select("id", R("pc1"), R("score"))


_NEAR = f"SELECT a.id, min(round({HAV},3)) AS d FROM listing a JOIN station b ON b.layer='transmilenio' WHERE a.lon IS NOT NULL GROUP BY 1"
ACCESS_SQL = dec2("CASE WHEN d IS NOT NULL THEN least(5.0e0, greatest(0.0e0, 5-d/500)) END")


@query("ind_4_station_access", f"SELECT id, {ACCESS_SQL} AS access FROM listing LEFT JOIN ({_NEAR}) USING (id)")
def _(v):
    return ind.station_access(v.listing.select("id", "lon", "lat"), v.station.where("layer = 'transmilenio'"), "station_id").select("id", "access")


_CW = dict(zip(OFFENCES[1:], ind.CRIME_WEIGHTS))
MASS_SQL = "m AS (SELECT zone_id, CAST(round(CAST(" + "+".join(f"{w}e0*coalesce({o}::DOUBLE/nullif(max({o}) OVER (), 0), 0)" for o, w in _CW.items()) + " AS DECIMAL(18,9)), 4) AS DOUBLE) AS mass FROM crime)"


def zone_mass(v):
    m = ag.weighted_crime(v.crime, _CW).select("zone_id", c("crime_mass").alias("mass"))
    return v.zone.join(m, "zone_id", "left")


def sectors(v):
    return v.pot.where("layer = 'treatment' and value = 'mejoramiento'").select("rings")


def raw_security(v):
    pts = v.listing.select("id", "kind", "lon", "lat")
    return ind.security_raw(pts, v.station.where("layer = 'cai'"), zone_mass(v), "zone_id", "mass", sectors(v))


_GAP = f"sqrt(pow(greatest(b.x0-a.lon, 0, a.lon-b.x1)*cos(radians(a.lat))*{KY},2)+pow(greatest(b.y0-a.lat, 0, a.lat-b.y1)*{KY},2))"
SEC_RAW_SQL = f"""{MASS_SQL}, cai AS (SELECT a.id, sum(greatest(0.0e0, 1-{PLAN}/800)) AS posts, count(*) AS n_posts FROM listing a JOIN station b ON b.layer='cai' AND {BOX(900)} WHERE {PLAN} <= 800 GROUP BY 1),
  cr AS (SELECT a.id, min(b.zone_id) AS zone_id FROM listing a JOIN zone b ON {INSIDE} GROUP BY 1),
  se AS (SELECT a.id, min({_GAP}) AS d FROM listing a JOIN (SELECT * FROM pot WHERE layer='treatment' AND value='mejoramiento') b ON true WHERE a.lon IS NOT NULL AND {_GAP} <= 200 GROUP BY 1),
  raw AS (SELECT l.id, l.kind, coalesce(posts, 0) AS posts, coalesce(n_posts, 0) AS n_posts, zone_id, coalesce(mass, 0) AS crime, coalesce(greatest(0.0e0, 1-d/200), 0) AS sector, coalesce(d=0, false) AS in_sector
  FROM listing l LEFT JOIN cai USING (id) LEFT JOIN cr USING (id) LEFT JOIN m USING (zone_id) LEFT JOIN se USING (id))"""


@query("ind_5_security_raw", SEC_RAW_SQL + " SELECT id, round(posts,6) AS posts, n_posts, zone_id, crime, round(sector,6) AS sector, in_sector FROM raw")
def _(v):
    return raw_security(v).select("id", R("posts"), "n_posts", "zone_id", "crime", R("sector"), "in_sector")


BOUND_SQL = "b AS (SELECT kind, min(posts) AS pmin, least(max(posts), 2.0e0) AS pmax, min(crime) AS cmin, max(crime) AS cmax, count(*) AS samples FROM raw GROUP BY 1)"
MICRO = "least(5.0e0, greatest(0.0e0, 0.35e0*5*least(posts, pmax)/nullif(pmax,0) + 0.45e0*(5-5*CASE WHEN cmax>cmin THEN (crime-cmin)/(cmax-cmin) ELSE 0.5e0 END) + 0.20e0*(5-5*sector)))"


@query("ind_6_security_final", f"{SEC_RAW_SQL}, {BOUND_SQL} SELECT id, round({MICRO}, 6) AS security_micro FROM raw JOIN b USING (kind)")
def _(v):
    raw = raw_security(v)
    return ind.security_final(raw, ind.security_bounds(raw)).select("id", R("security_micro"))


@query("ind_7_security_bounds", f"{SEC_RAW_SQL}, {BOUND_SQL} SELECT kind, round(pmin,6) AS posts_min, round(pmax,6) AS posts_max, cmin AS crime_min, cmax AS crime_max, samples FROM b")
def _(v):
    return ind.security_bounds(raw_security(v)).withColumns({"posts_min": R("posts_min"), "posts_max": R("posts_max")})


@query("ind_8_security_three_dims", f"""{SEC_RAW_SQL}, {BOUND_SQL}, k AS (SELECT id, zone_id, {MICRO} AS micro FROM raw JOIN b USING (kind)),
  z AS (SELECT zone_id, click*5.0e0/max(click) OVER () AS objective, error*5.0e0/max(error) OVER () AS subjective FROM crime),
  f AS (SELECT k.id, micro, coalesce(5-objective, micro) AS o, coalesce(5-subjective, micro) AS s FROM k LEFT JOIN z USING (zone_id))
  SELECT id, round(o,6) AS objective, round(s,6) AS subjective, round(least(5.0e0, greatest(0.0e0, 0.40e0*micro+0.30e0*o+0.30e0*s)), 6) AS security FROM f""")
def _(v):
    raw = raw_security(v)
    micro = ind.security_final(raw, ind.security_bounds(raw))
    tops = v.crime.agg(F.max("click").alias("a"), F.max("error").alias("b"))
    z = v.crime.select("zone_id", (c("click") * 5.0 / tops.select("a").scalar()).alias("objective"), (c("error") * 5.0 / tops.select("b").scalar()).alias("subjective"))
    return ind.security_three_dims(micro, z, "zone_id").select("id", R("objective"), R("subjective"), R("security"))


ZSEC = dec2("least(5.0e0, greatest(0.0e0, 5*(1-coalesce(mass, 0.5e0))))")


@query("ind_9_zone_security", f"{MASS_SQL} SELECT id, {ZSEC} AS security FROM scored LEFT JOIN m USING (zone_id) WHERE lon IS NOT NULL")
def _(v):
    m = ag.weighted_crime(v.crime, _CW).select("zone_id", "crime_mass")
    return v.scored.where("lon is not null").join(m, "zone_id", "left").select("id", ind.zone_security(c("crime_mass")).alias("security"))


@query("ind_10_crime_mass", f"{MASS_SQL} SELECT zone_id, mass, round(" + "+".join(f"{o}*{w}e0" for o, w in _CW.items()) + ", 6) AS raw_mass FROM m JOIN crime USING (zone_id)")
def _(v):
    a = ag.weighted_crime(v.crime, _CW).select("zone_id", c("crime_mass").alias("mass"))
    b = ag.weighted_crime(v.crime, _CW, "raw").select("zone_id", F.round("crime_mass", 6).alias("raw_mass"))
    return a.join(b, "zone_id")


def services_sql():
    cols = []
    for g, (cats, r, w) in ind.SERVICE_GROUPS.items():
        inn = "(" + ",".join(f"'{x}'" for x in cats) + ")"
        cols.append(f"coalesce(sum(CASE WHEN b.category IN {inn} AND {HAV} <= {r} THEN 1.0e0/greatest({HAV}, 50.0e0) END), 0) AS s_{g}, count(*) FILTER (b.category IN {inn} AND {HAV} <= {r}) AS n_{g}")
    tot = "+".join(f"s_{g}*{w}e0" for g, (_, _, w) in ind.SERVICE_GROUPS.items())
    return f"SELECT *, {tot} AS services_raw FROM (SELECT a.id, {', '.join(cols)} FROM listing a LEFT JOIN poi b ON {BOX(2050)} GROUP BY a.id)"


_SG = list(ind.SERVICE_GROUPS)


@query("ind_11_service_scores", f"SELECT id, {', '.join(f'round(s_{g}, 9) AS s_{g}, n_{g}' for g in _SG)}, round(services_raw, 9) AS services_raw FROM ({services_sql()})")
def _(v):
    d = ind.service_scores(v.listing.select("id", "lon", "lat"), v.poi)
    return d.select("id", *[R(f"s_{g}", 9) for g in _SG], *[f"n_{g}" for g in _SG], R("services_raw", 9))


@query("ind_12_service_percentile", f"SELECT id, round(5*percent_rank() OVER (PARTITION BY kind ORDER BY round(services_raw, 12)), 6) AS services FROM ({services_sql()}) JOIN listing USING (id)")
def _(v):
    from plotwise.operators.ranking import percent_score
    from plotwise.session import stage

    raw = stage(ind.service_scores(v.listing.select("id", "kind", "lon", "lat"), v.poi).withColumn("services_raw", F.round("services_raw", 12)))
    return percent_score(raw, "services_raw", "services", ["kind"]).select("id", R("services"))


POI_COUNT = f"SELECT a.id, count(b.poi_id) AS n_poi FROM listing a LEFT JOIN poi b ON {BOX(1050)} AND {HAV} <= 1000 GROUP BY a.id"


@query("ind_13_simple_services", f"SELECT id, n_poi, round(least(5.0e0, n_poi*0.05e0), 2) AS services FROM ({POI_COUNT})")
def _(v):
    return ind.simple_services(v.listing.select("id", "lon", "lat"), v.poi).select("id", "n_poi", "services")


def classes_sql(src, ident):
    cols = ", ".join("count(*) FILTER (b.category IN (" + ",".join(f"'{x}'" for x in cats) + f") AND {HAV} <= {r}) AS n_{g}" for g, (cats, r) in ind.CLASS_GROUPS.items())
    return f"SELECT a.{ident}, {cols} FROM {src} a LEFT JOIN poi b ON {BOX(2050)} GROUP BY a.{ident}"


_pscore = lambda w: dec2("(" + "+".join(f"least(5.0e0, n_{g})*{x}e0" for g, x in w.items()) + f")/{sum(w.values())!r}e0")


@query("ind_14_custom_services", f"SELECT id, score, round(score-services, 6) AS difference FROM (SELECT id, {_pscore(ind.PROFILES['familiar'])} AS score FROM ({classes_sql('listing', 'id')})) JOIN scored USING (id)")
def _(v):
    n = ind.class_counts(v.scored.select("id", "services", "lon", "lat"), v.poi)
    d = ind.profile_services(n, {"familiar": ind.PROFILES["familiar"]})
    return d.select("id", "score", F.round(c("score") - c("services"), 6).alias("difference"))


@query("ind_15_profile_comparison", f"n AS ({classes_sql('study', 'study_id')}) " + " UNION ALL ".join(f"SELECT study_id, '{p}' AS profile, {_pscore(w)} AS score FROM n" for p, w in ind.PROFILES.items()))
def _(v):
    return ind.profile_services(ind.class_counts(v.study.select("study_id", "lon", "lat"), v.poi)).select("study_id", "profile", "score")


_COEF = {"1-URGENT": (15.0, 0.01, 0.02, 0.03), "2-HIGH": (14.5, 0.012, -0.01, 0.05), "5-LOW": (14.0, 0.0, 0.1, 0.0)}


@query("ind_16_hedonic_raw", "k AS (SELECT * FROM (VALUES " + ",".join(f"('{a}', {', '.join(f'{x}e0' for x in xs)})" for a, xs in _COEF.items()) + """) t(kind, b0, ba, br, bb))
  SELECT id, round(h, 6) AS hedonic, round(ln(price/area)-h, 6) AS residual FROM (SELECT id, price, area, CASE WHEN area > 0 THEN b0+ba*area+br*rooms+bb*coalesce(baths,0) END AS h FROM listing LEFT JOIN k USING (kind))""")
def _(v):
    k = v.spark.createDataFrame([(a, *map(float, xs)) for a, xs in _COEF.items()], "kind string, intercept double, area double, rooms double, baths double")
    return ind.hedonic_raw(v.listing, k, ["area", "rooms", "baths"]).select("id", R("hedonic"), R("residual"))


@query("ind_17_dimension_pc1", """s AS (SELECT kind, avg(area) AS ma, stddev_samp(area) AS sa, avg(rooms) AS mr, stddev_samp(rooms) AS sr, avg(baths) AS mb, stddev_samp(baths) AS sb FROM listing GROUP BY 1)
  SELECT id, round(CASE WHEN area > 0 THEN 0.6e0*(area-ma)/sa + 0.6e0*(rooms-mr)/sr + 0.5e0*coalesce((baths-mb)/sb, 0) END, 6) AS pc1 FROM listing JOIN s USING (kind)""")
def _(v):
    f = {"area": 0.6, "rooms": 0.6, "baths": 0.5}
    load = v.listing.groupBy("kind").agg(*[e for n, w in f.items() for e in (F.lit(w).alias(f"phi_{n}"), F.avg(n).alias(f"mean_{n}"), F.stddev_samp(n).alias(f"sd_{n}"))])
    return ind.dimension_pc1(v.listing, load, list(f)).select("id", R("pc1"))


@query("ind_18_combined_dwelling", "SELECT id, round(security*0.7e0+services*0.3e0, 6) AS dwelling FROM scored")
def _(v):
    return v.scored.select("id", F.round(ind.combined_dwelling(c("security"), c("services")), 6).alias("dwelling"))


DWELL_SQL = "round(least(5.0e0, greatest(0.0e0, 0.4e0*rooms + 0.5e0*coalesce(baths,0) + least(coalesce(area,0)/50, 3.0e0))), 2)"


@query("ind_19_rule_dwelling", f"SELECT id, {DWELL_SQL} AS dwelling FROM listing")
def _(v):
    return v.listing.select("id", ind.rule_dwelling().alias("dwelling"))


@query("ind_20_neighbour_gap_by_kind", f"""d AS (SELECT id, kind, lon, lat, price/area AS x FROM listing WHERE lon IS NOT NULL AND area > 0),
  n AS (SELECT a.id, a.kind, a.x, b.x AS y, row_number() OVER (PARTITION BY a.id ORDER BY round({HAV},3), b.id) AS rn FROM d a JOIN d b ON {BOX(5500)}),
  g AS (SELECT id, kind, least(5.0e0, greatest(0.0e0, 5-(any_value(x)/avg(y)-1)*5)) AS s FROM n WHERE rn <= 20 GROUP BY id, kind) SELECT kind, count(*) AS n, round(avg(s), 6) AS mean_score FROM g GROUP BY kind""")
def _(v):
    return ind.price_gap_score(v.listing).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("dwelling_gap"), 6).alias("mean_score"))


ZON = f"""zs AS (SELECT layer, poly_id, x0, y0, x1, y1, CASE layer WHEN 'treatment' THEN {TREAT_SQL} WHEN 'buildability' THEN {BUILD_SQL} ELSE {ACT_SQL} END AS s FROM pot),
  zp AS (SELECT a.id, max(s) FILTER (b.layer='treatment') AS zt, max(s) FILTER (b.layer='buildability') AS zb, max(s) FILTER (b.layer='activity') AS za FROM PTS a LEFT JOIN zs b ON {INSIDE} WHERE a.lon IS NOT NULL GROUP BY 1)"""
ZVAL = "least(5.0e0, greatest(0.0e0, coalesce(zt,2.5e0)*0.4e0 + coalesce(zb,2.5e0)*0.4e0 + coalesce(za,3.0e0)*0.2e0))"


@query("ind_21_zoning_potential", ZON.replace("PTS", "listing") + f" SELECT l.id, round({ZVAL}, 6) AS zoning FROM zp l UNION ALL SELECT id, NULL FROM listing WHERE lon IS NULL")
def _(v):
    return ind.zoning_potential(v.listing.select("id", "lon", "lat"), v.pot).select("id", R("zoning"))


def skip_sql(w):
    den = "+".join(f"CASE WHEN {k} IS NULL THEN 0.0e0 ELSE {x}e0 END" for k, x in w.items())
    num = "+".join(f"coalesce({k}*{x}e0, 0)" for k, x in w.items())
    n = "+".join(f"({k} IS NOT NULL)::INT" for k in w)
    return f"CASE WHEN {n} >= 2 THEN least(5.0e0, greatest(0.0e0, {dec2(f'({num})/nullif({den}, 0)')})) END"


_unit = lambda m: "CAST(round(CAST((" + "+".join(f"coalesce({k}, {m}e0)" for k in ind.FIVE) + ")/5.0e0 AS DECIMAL(24,10)), 3) AS DOUBLE)"


@query("ind_22_composite_variants", f"""SELECT id, {dec2('('+"+".join(f"coalesce({k},0)" for k in ind.FIVE)+')*0.20e0')} AS five, {skip_sql(ind.COMPOSITE_FOUR)} AS skip, {_unit(2.5)} AS neutral, {_unit(0.0)} AS unit,
  {', '.join(f'{skip_sql(w)} AS {p}' for p, w in ind.COMPOSITE_PRESETS.items())} FROM scored""")
def _(v):
    return v.scored.select("id", ind.composite().alias("five"), ind.composite("skip").alias("skip"), ind.composite("neutral").alias("neutral"),
                           ind.composite("unit").alias("unit"), *[ind.composite("skip", w).alias(p) for p, w in ind.COMPOSITE_PRESETS.items()])


@query("ind_23_price_per_point", f"SELECT id, CASE WHEN composite > 0 AND price > 0 THEN {dec2s('price/composite')} END AS ratio, round(composite/(price/1000000), 6) AS index_per_million FROM scored")
def _(v):
    return v.scored.select("id", ind.price_per_point().alias("ratio"), F.round(c("composite") / (c("price") / 1_000_000), 6).alias("index_per_million"))


def chain_sql():
    """Indices of every listing from the raw layers, as one query text."""
    return f"""{MASS_SQL}, ac AS ({_NEAR}), pc AS ({POI_COUNT}), {ZON.replace('PTS', 'listing')}, zi AS (SELECT a.id, min(b.zone_id) AS zone_id FROM listing a JOIN zone b ON {INSIDE} GROUP BY 1),
  ix AS (SELECT l.id, l.kind, l.price, l.area, {ACCESS_SQL} AS access, {ZSEC} AS security, round(least(5.0e0, n_poi*0.05e0), 2) AS services, {DWELL_SQL} AS dwelling, {ZVAL} AS zoning
   FROM listing l JOIN ac USING (id) JOIN pc USING (id) JOIN zp USING (id) LEFT JOIN zi USING (id) LEFT JOIN m USING (zone_id) WHERE l.lon IS NOT NULL),
  cx AS (SELECT *, {dec2('(access+security+services+dwelling+zoning)*0.2e0')} AS composite FROM ix)"""


def chain(v):
    from plotwise.plans.recompute import recompute_indices

    return recompute_indices(v.listing, stations=v.station.where("layer = 'transmilenio'"), pois=v.poi, zones=zone_mass(v), layers=v.pot)


@query("ind_24_opportunity_table", f"""{chain_sql()}, r AS (SELECT *, {dec2s('price/composite')} AS ratio FROM cx WHERE composite > 0), p AS (SELECT *, percent_rank() OVER (ORDER BY ratio) AS p, percent_rank() OVER (PARTITION BY kind ORDER BY ratio) AS pk FROM r)
  SELECT id, kind, composite, ratio, CAST(round(CAST(p*100 AS DECIMAL(18,9)), 1) AS DOUBLE) AS pct_ratio, CAST(round(CAST(pk*100 AS DECIMAL(18,9)), 1) AS DOUBLE) AS pct_ratio_kind, CAST(round(CAST(price/nullif(area,0) AS DECIMAL(24,9)), 0) AS DOUBLE) AS price_m2, {OPP_SQL} AS class FROM p""")
def _(v):
    from plotwise.session import stage

    t = ind.opportunity_table(stage(chain(v).select("id", "kind", "price", "area", "composite")))
    return t.select("id", "kind", "composite", "ratio", "pct_ratio", "pct_ratio_kind", "price_m2", "class")


@query("ind_25_zone_propagation", f"""bz AS (SELECT a.barrio_id, b.zone_id FROM (SELECT barrio_id, (x0+x1)/2 AS lon, (y0+y1)/2 AS lat FROM barrio) a JOIN zone b ON {INSIDE}),
  bs AS (SELECT barrio_id, zone_id, CASE WHEN barrio_id%3<>0 THEN (barrio_id%50)/10.0e0 END AS access, CASE WHEN barrio_id%4<>0 THEN (barrio_id%40)/8.0e0 END AS security FROM bz),
  zz AS (SELECT zone_id, round(avg(access),6) AS access, round(avg(security),6) AS security FROM scored WHERE zone_id IS NOT NULL GROUP BY 1),
  f AS (SELECT barrio_id, coalesce(bs.access, zz.access) AS access, coalesce(bs.security, zz.security) AS security FROM bs LEFT JOIN zz USING (zone_id)),
  li AS (SELECT a.id, min(b.barrio_id) AS barrio_id FROM scored a JOIN barrio b ON {INSIDE} GROUP BY 1),
  o AS (SELECT s.id, li.barrio_id, CASE WHEN f.barrio_id IS NULL THEN s.access ELSE f.access END AS access, CASE WHEN f.barrio_id IS NULL THEN s.security ELSE f.security END AS security, services, dwelling, zoning FROM scored s LEFT JOIN li USING (id) LEFT JOIN f ON f.barrio_id=li.barrio_id)
  SELECT id, barrio_id, access, security, {_unit(0.0)} AS composite FROM o""")
def _(v):
    k = c("barrio_id")
    b = geo.zone_parents(v.barrio, v.zone, "barrio_id", ["zone_id"], "zone_id").select(
        "barrio_id", "zone_id", F.when(k % 3 != 0, (k % 50) / 10.0).alias("access"), F.when(k % 4 != 0, (k % 40) / 8.0).alias("security"))
    z = v.scored.where("zone_id is not null").groupBy("zone_id").agg(F.round(F.avg("access"), 6).alias("access"), F.round(F.avg("security"), 6).alias("security"))
    pts = geo.one_polygon(v.scored.drop("zone_id"), v.barrio, "barrio_id", ["barrio_id"])
    return ind.propagate_zone_scores(pts, b, z, ["access", "security"]).select("id", "barrio_id", "access", "security", "composite")


_PS = {"sitp": 800, "transmilenio": 1500}
STUDY_SQL = f"""sg AS ({gravity_sql('station', 'layer', _PS).replace('a.id', 'a.study_id').replace('FROM listing a', 'FROM study a')}), ss AS (SELECT a.study_id, {dec2('avg(b.security)')} AS v FROM study a JOIN scored b ON {BOX(1050)} WHERE {HAV} <= 1000 AND b.security IS NOT NULL GROUP BY 1),
  sd AS (SELECT a.study_id, {dec2('avg(b.dwelling)')} AS v FROM study a JOIN scored b ON {BOX(550)} WHERE {HAV} <= 500 GROUP BY 1), {ZON.replace('PTS', '(SELECT *, study_id AS id FROM study)')},
  st AS (SELECT study_id, s.kind, s.area, s.rooms, {dec2('g_sitp+g_transmilenio')} AS access, coalesce(ss.v, 3.0e0) AS security, coalesce(sd.v, 3.0e0) AS dwelling,
   CASE WHEN zt IS NOT NULL AND zb IS NOT NULL AND za IS NOT NULL THEN {dec2(ZVAL)} END AS zoning FROM study s JOIN sg USING (study_id) LEFT JOIN ss USING (study_id) LEFT JOIN sd USING (study_id) LEFT JOIN zp ON zp.id=study_id),
  su AS (SELECT *, {skip_sql(ind.COMPOSITE_FOUR)} AS composite FROM st)"""


@query("ind_26_point_study", f"{STUDY_SQL} SELECT study_id, access, security, dwelling, zoning, composite FROM su")
def _(v):
    return ind.point_study(v.study.select("study_id", "lon", "lat"), v.station, v.scored, v.pot).select("study_id", "access", "security", "dwelling", "zoning", "composite")


@query("ind_27_study_valuation", f"""su AS (SELECT study_id, kind, area, rooms, (study_id%500)/100.0e0 AS composite FROM study),
  si AS (SELECT a.study_id, b.price/b.area AS x, row_number() OVER (PARTITION BY a.study_id ORDER BY b.id) AS rn, a.area FROM su a JOIN scored b ON a.kind=b.kind AND a.rooms=b.rooms AND b.area BETWEEN a.area*0.8e0 AND a.area*1.2e0),
  es AS (SELECT study_id, avg(x)*any_value(area) AS e, count(*) AS n_similar FROM si WHERE rn <= 50 GROUP BY 1),
  mk AS (SELECT a.study_id, count(*) AS n_market, round(avg(b.price), 2) AS market_price FROM su a JOIN scored b ON a.kind=b.kind AND b.composite BETWEEN a.composite-0.5e0 AND a.composite+0.5e0 AND b.composite > 0 GROUP BY 1)
  SELECT study_id, coalesce(n_similar, 0) AS n_similar, CAST(round(CAST(e AS DECIMAL(24,6))) AS BIGINT) AS estimate, coalesce(n_market, 0) AS n_market, market_price FROM su LEFT JOIN es USING (study_id) LEFT JOIN mk USING (study_id)""")
def _(v):
    s = v.study.withColumn("composite", (c("study_id") % 500) / 100.0)
    s = ind.study_valuation(s, v.scored)
    t = v.scored.where("composite > 0").withColumn("ratio", ind.price_per_point())
    return ind.market_comparison(s, t).select("study_id", "n_similar", "estimate", "n_market", F.round("market_price", 2).alias("market_price"))


_LAY = ["parque", "colegio", "ips", "supermercado", "teatro"]


@query("ind_28_nearest_layers", "SELECT l.id, " + ", ".join(f"d_{n}" for n in _LAY) + " FROM listing l LEFT JOIN (SELECT a.id, " + ", ".join(
    f"min(round({HAV},3)) FILTER (b.category='{n}') AS d_{n}" for n in _LAY) + " FROM listing a JOIN poi b ON true WHERE a.lon IS NOT NULL GROUP BY 1) x USING (id)")
def _(v):
    return ind.nearest_layer_distances(v.listing.select("id", "lon", "lat"), v.poi, "category", _LAY, "poi_id").drop("lon", "lat")


_DL = {"sitp": 800, "cai": 800, "transmilenio": 1500}
_KER = lambda r: {"gaussian": f"exp(-({HAV}*{HAV})/(2*pow({lb.calibrated_sigma(r)!r}e0,2)))", "linear": f"greatest(0.0e0, 1-{HAV}/{r})", "inverse": f"1.0e0/greatest({HAV}, 50.0e0)"}
_dsum = ", ".join(f"coalesce(sum(CASE WHEN b.layer='{n}' AND {HAV} <= {r} THEN {e} END), 0) AS {k}_{n}" for n, r in _DL.items() for k, e in _KER(r).items())
_dcols = [f"{k}_{n}" for n in _DL for k in ("gaussian", "linear", "inverse")]
_gs, _ls = "+".join(f"gaussian_{n}" for n in _DL), "+".join(f"linear_{n}" for n in _DL)


@query("ind_29_decay_comparison", f"SELECT id, {', '.join(f'round({x}, 6) AS {x}' for x in _dcols)}, round(CASE WHEN {_ls} > 1e-9 THEN (({_gs})-({_ls}))/({_ls})*100 ELSE 0 END, 2) AS difference_pct FROM (SELECT a.id, {_dsum} FROM listing a LEFT JOIN station b ON {BOX(1550)} GROUP BY 1)")
def _(v):
    d = ind.decay_comparison(v.listing.select("id", "lon", "lat"), v.station, "layer", _DL)
    return d.select("id", *[R(x) for x in _dcols], R("difference_pct", 2))


@query("ind_30_recompute_all", f"{chain_sql()} SELECT id, access, security, services, dwelling, round(zoning, 6) AS zoning, composite FROM cx")
def _(v):
    return chain(v).select("id", "access", "security", "services", "dwelling", R("zoning"), "composite")
