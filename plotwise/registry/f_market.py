"""Outliers, valuation, search, vectors, upserts."""

from pyspark.sql import functions as F

from plotwise.fixtures import AMENITIES, SCRAPE_ORDER, pick
from plotwise.fixtures import _case as case_sql
from plotwise.functions import labels as lb
from plotwise.functions import text as tx
from plotwise.operators import geo
from plotwise.operators import indicators as ind
from plotwise.operators import outliers as ou
from plotwise.operators import search as se
from plotwise.operators import upsert as up
from plotwise.operators import valuation as vl
from plotwise.operators import vectors
from plotwise.registry.c_geo import BOX, HAV, INSIDE
from plotwise.registry.core import query
from plotwise.session import stage

c = F.col
R = lambda n, d=6: F.round(c(n), d).alias(n)

# ----------------------------------------------------------------- outliers

PREP = """p0 AS (SELECT *, price/area AS price_m2 FROM listing WHERE price IS NOT NULL AND area > 0), g0 AS (SELECT city, kind, median(stratum) AS ms, median(price_m2) AS mp, median(area) AS ma, count(*) AS n FROM p0 GROUP BY 1,2 HAVING count(*) >= 10),
  p1 AS (SELECT p0.*, coalesce(stratum::DOUBLE, ms, 3.0) AS sf, ms, mp, ma FROM p0 JOIN g0 USING (city, kind)),
  p2 AS (SELECT *, (price_m2-avg(price_m2) OVER w)/stddev_pop(price_m2) OVER w AS z0, (area-avg(area) OVER w)/stddev_pop(area) OVER w AS z1, (sf-avg(sf) OVER w)/stddev_pop(sf) OVER w AS z2 FROM p1 WINDOW w AS (PARTITION BY city, kind))"""
_D2 = "pow(a.z0-b.z0,2)+pow(a.z1-b.z1,2)+pow(a.z2-b.z2,2)"
NOISE = f"""{PREP}, cn AS (SELECT a.id, count(*) AS n FROM p2 a JOIN p2 b ON a.city=b.city AND a.kind=b.kind AND {_D2} <= 2.25e0 GROUP BY 1),
  co AS (SELECT p2.* FROM p2 JOIN cn USING (id) WHERE n >= 5), nz AS (SELECT a.* FROM p2 a WHERE NOT EXISTS (SELECT 1 FROM co b WHERE a.city=b.city AND a.kind=b.kind AND {_D2} <= 2.25e0))"""
_far = lambda n, m: f"({n}/nullif({m},0) > 3.0 OR {n}/nullif({m},0) < 0.25)"


@query("out_1_density_outliers", f"""{NOISE} SELECT id, concat_ws(',', CASE WHEN {_far('price_m2', 'mp')} THEN 'price_m2' END, CASE WHEN {_far('area', 'ma')} THEN 'area' END,
  CASE WHEN {_far('stratum', 'ms')} THEN 'stratum' END) AS reasons, 'pending' AS status FROM nz WHERE {_far('price_m2', 'mp')} OR {_far('area', 'ma')} OR coalesce({_far('stratum', 'ms')}, false)""")
def _(v):
    d = ou.classify(v.listing, ["city", "kind"])
    return d.select("id", F.array_join(F.transform("reasons", lambda r: r["feature"]), ",").alias("reasons"), "status")


@query("out_1_density_noise", f"{NOISE} SELECT id FROM nz")
def _(v):
    return ou.density_noise(ou.prepare(v.listing, ["city", "kind"]), ["z0", "z1", "z2"], ["city", "kind"]).where("noise").select("id")


@query("out_2_explanations", f"""{PREP} SELECT id, concat_ws(',', CASE WHEN {_far('price_m2', 'mp')} THEN 'price_m2' END, CASE WHEN {_far('area', 'ma')} THEN 'area' END, CASE WHEN {_far('stratum', 'ms')} THEN 'stratum' END) AS reasons FROM p2""")
def _(v):
    d = ou.explanations(ou.prepare(v.listing, ["city", "kind"]), ["city", "kind"])
    return d.select("id", F.array_join(F.transform("reasons", lambda r: r["feature"]), ",").alias("reasons"))


def standardized(v):
    d = v.listing.where("price > 0 and area > 0 and stratum is not null").withColumn("price_m2", c("price") / c("area"))
    st = d.agg(*[e for n in ("price_m2", "area", "stratum") for e in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))]).first()
    return stage(d.select("id", *[((c(n) - st[f"m_{n}"]) / st[f"s_{n}"]).alias(f"z{i}") for i, n in enumerate(("price_m2", "area", "stratum"))]))


# All pairs of listings: the fifth smallest distance of each, the elbow of their sorted curve, clusters at that radius.
KDIST = f"""s0 AS (SELECT id, price/area AS price_m2, area, stratum FROM listing WHERE price > 0 AND area > 0 AND stratum IS NOT NULL), sd AS (SELECT id, (price_m2-avg(price_m2) OVER ())/stddev_pop(price_m2) OVER () AS z0,
   (area-avg(area) OVER ())/stddev_pop(area) OVER () AS z1, (stratum-avg(stratum) OVER ())/stddev_pop(stratum) OVER () AS z2 FROM s0),
  kd AS MATERIALIZED (SELECT a.id, round(sqrt(list_max(min({_D2}, 5))), 9) AS v FROM sd a JOIN sd b ON a.id <> b.id GROUP BY 1),
  el AS MATERIALIZED (SELECT v AS eps FROM (SELECT v, row_number() OVER w AS rn, round((lead(v) OVER w - v) - (v - lag(v) OVER w), 9) AS r FROM kd WINDOW w AS (ORDER BY v)) WHERE r IS NOT NULL ORDER BY r DESC, rn LIMIT 1)"""
# All pairs decide who is core and which cells touch; core points of one cell are within the radius of each other.
CALIB = f"""{KDIST}, ep AS MATERIALIZED (SELECT round(eps, 4) AS e FROM el), co AS MATERIALIZED (SELECT a.id FROM sd a, ep JOIN sd b ON {_D2} <= e*e GROUP BY 1 HAVING count(*) >= 5),
  cc AS MATERIALIZED (SELECT sd.*, min(id) OVER (PARTITION BY floor(z0*sqrt(3)/e), floor(z1*sqrt(3)/e), floor(z2*sqrt(3)/e)) AS cell FROM sd JOIN co USING (id), ep),
  ce AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM cc a, ep JOIN cc b ON {_D2} <= e*e AND a.cell<>b.cell GROUP BY 1, 2),
  rl(id, lab) USING KEY (id) AS (SELECT DISTINCT cell, cell FROM cc UNION SELECT e.b, min(r.lab) FROM rl r JOIN ce e ON e.a=r.id JOIN recurring.rl q ON q.id=e.b WHERE r.lab < q.lab GROUP BY 1),
  bo AS (SELECT a.id, arg_min(b.cell, {{'d': round({_D2}, 12), 'b': b.id}}) AS cell FROM sd a, ep JOIN cc b ON {_D2} <= e*e WHERE a.id NOT IN (SELECT id FROM co) GROUP BY 1),
  mb AS (SELECT m.id, rl.lab FROM (SELECT id, cell FROM cc UNION ALL SELECT id, cell FROM bo) m JOIN rl ON rl.id=m.cell), lo AS (SELECT lab, min(id) AS label FROM mb GROUP BY 1), cl AS (SELECT sd.id, label FROM sd LEFT JOIN mb USING (id) LEFT JOIN lo USING (lab))"""
_Z = ["z0", "z1", "z2"]


@query("out_3_k_distance", f"{KDIST} SELECT round((SELECT eps FROM el), 6) AS eps, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{n}" for n, q in ((25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95))) + " FROM kd")
def _(v):
    return ou.elbow(stage(ou.k_distances(standardized(v), _Z, "id", 5))).select(*[R(n) for n in ("eps", "p25", "p50", "p75", "p95")])


@query("out_3_calibrated_noise", f"RECURSIVE {CALIB} SELECT label IS NULL AS noise, count(*) AS n FROM cl GROUP BY 1")
def _(v):
    d = standardized(v)
    eps = ou.elbow(stage(ou.k_distances(d, _Z, "id", 5))).select(F.round("eps", 4)).first()[0]
    return ou.density_noise(d, _Z, [], float(eps), 5).groupBy("noise").agg(F.count("*").alias("n"))


@query("out_3_cluster_labels", f"RECURSIVE {CALIB} SELECT id, label FROM cl")
def _(v):
    return ou.calibrated_clusters(standardized(v), _Z).select("id", "label")


@query("out_3_calibrated_run", f"RECURSIVE {CALIB} SELECT (SELECT e FROM ep) AS eps, count(*) AS n, count(DISTINCT label) AS n_clusters, count(*) FILTER (label IS NULL) AS n_outliers, round(count(*) FILTER (label IS NULL)/count(*)::DOUBLE*100, 2) AS pct_outliers FROM cl")
def _(v):
    return ou.cluster_summary(ou.calibrated_clusters(standardized(v), _Z))


@query("out_4_method_comparison")
def _(v):
    d = stage(ou.density_noise(standardized(v), ["z0", "z1", "z2"]))
    return ou.isolation_outliers(d, ["z0", "z1", "z2"], "id").groupBy("noise", "iso_outlier").agg(F.count("*").alias("n"), F.round(F.avg("iso_score"), 4).alias("mean_score"))


@query("out_5_review", """f AS (SELECT id FROM listing WHERE kind='1-URGENT'), d AS (SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 'confirm' ELSE 'reinstate' END AS decision, ts, event_id FROM events WHERE event_type IN ('purchase','error')),
  l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC)=1) SELECT f.id, CASE decision WHEN 'confirm' THEN 'confirmed' WHEN 'reinstate' THEN 'reinstated' ELSE 'pending' END AS status, coalesce(decision, '') <> 'reinstate' AS is_outlier FROM f LEFT JOIN l USING (id)""")
def _(v):
    flags = v.listing.where("kind = '1-URGENT'").select("id")
    e = v.table("events").where(c("event_type").isin("purchase", "error"))
    dec = e.select(c("user_id").alias("id"), F.when(c("event_type") == "purchase", "confirm").otherwise("reinstate").alias("decision"), "ts", "event_id")
    return ou.review(flags, dec, F.struct("ts", "event_id"))


@query("out_6_rerun_decision", "SELECT count(*) AS n_new, concat_ws(',', CASE WHEN count(*) >= 30 THEN 'new_listings' END, CASE WHEN count(*) > 0 THEN 'days_without_run' END) AS reasons, count(*) > 0 AS trigger FROM listing WHERE price > 0 AND area > 0 AND listed > TIMESTAMP '1998-06-01'")
def _(v):
    return ou.rerun_decision(v.listing, "listed", F.lit("1998-06-01").cast("timestamp"), F.lit("1998-07-01").cast("timestamp"))


# ---------------------------------------------------------------- valuation

_COND = ["Remodelado", "Usados", "Para remodelar", "Nuevos", "desconocido"]


def with_condition(v):
    return v.listing.withColumn("condition", pick(_COND, c("id") % 5))


def comps_sql(subj, ident, same=True):
    """n=4 comparables per subject; located subjects by distance, others by area and price."""
    bands = [(f"{a}e0", f"{p}e0") for a, p in vl.BANDS]
    inb = lambda a, p: f"b.area BETWEEN a.area*(1-{a}) AND a.area*(1+{a}) AND b.price BETWEEN a.price*(1-{p}) AND a.price*(1+{p})"
    lev = "CASE " + " ".join(f"WHEN {inb(a, p)} THEN {i}" for i, (a, p) in enumerate(bands, 1)) + " END"
    diff = f" AND a.{ident} <> b.id" if same else ""
    return f"""cp AS (SELECT a.{ident}, b.id AS comp_id, {lev} AS lv, CASE WHEN a.lon IS NOT NULL THEN round({HAV},3) ELSE round(abs(b.area-a.area)+abs(b.price-a.price)/1000000, 6) END AS dist
   FROM {subj} a JOIN listing b ON a.city=b.city AND a.kind=b.kind AND {inb(*bands[-1])}{diff} AND (a.lon IS NULL OR b.lon IS NOT NULL) WHERE a.area > 0 AND a.price > 0 AND b.area > 0 AND b.price > 0 AND NOT b.is_outlier),
  cl AS (SELECT {ident}, CASE WHEN count(*) FILTER (lv=1) >= 4 THEN 1 WHEN count(*) FILTER (lv<=2) >= 4 THEN 2 ELSE 3 END AS level FROM cp GROUP BY 1),
  cr AS (SELECT {ident}, comp_id, level, dist, row_number() OVER (PARTITION BY {ident} ORDER BY dist, comp_id) AS rn FROM cp JOIN cl USING ({ident}) WHERE lv <= level QUALIFY rn <= 4)"""


@query("val_1_comparables", f"{comps_sql('listing', 'id')} SELECT id, comp_id, level, dist, rn FROM cr")
def _(v):
    return vl.comparables(v.listing, v.listing).withColumn("rn", c("rn").cast("long"))


@query("val_2_scaled_neighbours", """d AS (SELECT id, city, kind, price/area AS f0, area AS f1, lat AS f2, lon AS f3 FROM listing WHERE area > 0 AND price > 0 AND lon IS NOT NULL), z AS (SELECT id, city, kind, """
       + ", ".join(f"(f{i}-avg(f{i}) OVER w)/stddev_pop(f{i}) OVER w AS z{i}" for i in range(4)) + " FROM d WINDOW w AS (PARTITION BY city, kind)), k AS (SELECT a.id, b.id AS comp_id, round(sqrt(" + "+".join(f"pow(a.z{i}-b.z{i},2)" for i in range(4))
       + "), 9) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt(" + "+".join(f"pow(a.z{i}-b.z{i},2)" for i in range(4)) + "), 9), b.id) AS rn FROM z a JOIN z b ON a.city=b.city AND a.kind=b.kind AND a.id<>b.id QUALIFY rn <= 4) SELECT id, comp_id, round(dist, 6) AS dist, rn FROM k")
def _(v):
    return vl.scaled_neighbours(v.listing, v.listing).select("id", "comp_id", R("dist"), c("rn").cast("long").alias("rn"))


# All pairs decide at every radius who is core and which cells touch; labels spread along those until none changes.
_DZ = "+".join(f"pow(a.z{i}-b.z{i},2)" for i in range(4))
LADDER_SQL = """d AS (SELECT id, city, kind, price/area AS f0, area AS f1, lat AS f2, lon AS f3 FROM listing WHERE area > 0 AND price > 0 AND lon IS NOT NULL AND NOT is_outlier), z AS (SELECT id, city, kind, """ + ", ".join(
    f"(f{i}-avg(f{i}) OVER w)/stddev_pop(f{i}) OVER w AS z{i}" for i in range(4)) + f""" FROM d WINDOW w AS (PARTITION BY city, kind)),
  lv AS (SELECT unnest([{', '.join(f'{e}e0' for e in vl.LADDER)}]) AS eps), zl AS MATERIALIZED (SELECT * FROM z, lv),
  co AS MATERIALIZED (SELECT a.eps, a.id FROM zl a JOIN z b ON a.city=b.city AND a.kind=b.kind AND {_DZ} <= a.eps*a.eps GROUP BY 1, 2 HAVING count(*) >= {vl.CORE}),
  cc AS MATERIALIZED (SELECT zl.*, min(id) OVER (PARTITION BY eps, city, kind, floor(z0*2/eps), floor(z1*2/eps), floor(z2*2/eps), floor(z3*2/eps)) AS cell FROM zl JOIN co USING (eps, id)),
  ce AS MATERIALIZED (SELECT a.eps, a.cell AS a, b.cell AS b FROM cc a JOIN cc b ON a.eps=b.eps AND a.city=b.city AND a.kind=b.kind AND {_DZ} <= a.eps*a.eps AND a.cell<>b.cell GROUP BY 1, 2, 3),
  rl(eps, id, lab) USING KEY (eps, id) AS (SELECT DISTINCT eps, cell, cell FROM cc UNION SELECT e.eps, e.b, min(r.lab) FROM rl r JOIN ce e ON e.eps=r.eps AND e.a=r.id JOIN recurring.rl q ON q.eps=e.eps AND q.id=e.b WHERE r.lab < q.lab GROUP BY 1, 2),
  bo AS (SELECT a.eps, a.id, arg_min(b.cell, {{'d': round({_DZ}, 12), 'b': b.id}}) AS cell FROM zl a JOIN cc b ON a.eps=b.eps AND a.city=b.city AND a.kind=b.kind AND {_DZ} <= a.eps*a.eps WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.eps=a.eps AND co.id=a.id) GROUP BY 1, 2),
  mb AS (SELECT m.eps, m.id, rl.lab FROM (SELECT eps, id, cell FROM cc UNION ALL SELECT eps, id, cell FROM bo) m JOIN rl ON rl.eps=m.eps AND rl.id=m.cell),
  sz AS (SELECT eps, lab, count(*)-1 AS fel FROM mb GROUP BY 1, 2), ch AS (SELECT id, coalesce(min(eps) FILTER (fel >= 4), max(eps)) AS eps FROM mb JOIN sz USING (eps, lab) GROUP BY 1),
  own AS (SELECT ch.id, ch.eps, mb.lab FROM ch JOIN mb ON mb.id=ch.id AND mb.eps=ch.eps JOIN sz ON sz.eps=mb.eps AND sz.lab=mb.lab WHERE fel >= 2),
  cd AS (SELECT a.id, b.id AS comp_id, own.eps, round(sqrt({_DZ}), 9) AS dist FROM z a LEFT JOIN own ON own.id=a.id JOIN z b ON a.city=b.city AND a.kind=b.kind AND a.id<>b.id LEFT JOIN mb ON mb.id=b.id AND mb.eps=own.eps AND mb.lab=own.lab WHERE own.id IS NULL OR mb.id IS NOT NULL),
  cr AS (SELECT id, comp_id, eps, dist, row_number() OVER (PARTITION BY id ORDER BY dist, comp_id) AS rn FROM cd QUALIFY rn <= 4)"""


@query("val_2_cluster_comparables", f"RECURSIVE {LADDER_SQL} SELECT id, comp_id, eps, round(dist, 6) AS dist, rn FROM cr")
def _(v):
    return vl.cluster_comparables(v.listing, v.listing).select("id", "comp_id", "eps", R("dist"), c("rn").cast("long").alias("rn"))


_lv = "([" + ", ".join(str(lb.CONDITION_LEVELS.get(x, 3)) for x in _COND) + "])"
_fx = "([" + ", ".join(f"{x}e0" for x in lb.CONDITION_FACTORS.values()) + "])"
_r = lambda x, d: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(28,10)), {d}) AS DOUBLE)"
HOM = f"""hm AS (SELECT cr.SID, comp_id, b.price/b.area AS m2, {_r(f"{_fx}[greatest(-4, least(4, {_lv}[CAST(s.cix AS INT)+1]-{_lv}[CAST(comp_id%5 AS INT)+1]))+5]*CASE WHEN b.area/s.area > 1.15e0 THEN 0.95e0 WHEN b.area/s.area < 0.85e0 THEN 1.05e0 ELSE 1.0e0 END", 2)} AS factor
  FROM cr JOIN listing b ON b.id=comp_id JOIN SUBJ s ON s.SID=cr.SID), hn AS (SELECT *, {_r('m2*0.95e0*factor', 0)} AS h FROM hm)"""
_t = {i: lb_t for i, lb_t in ((i, round(__import__('plotwise.functions.mathx', fromlist=['x']).t_quantile(0.95, i), 10)) for i in range(1, 4))}
STAT = f"""st AS (SELECT SID, count(*)::INT AS n, avg(h) AS mean, coalesce(stddev_samp(h), 0) AS sd, CASE count(*) {' '.join(f'WHEN {i + 1} THEN {t!r}e0' for i, t in _t.items())} ELSE 0 END AS t FROM hn GROUP BY 1),
  so AS (SELECT SID, n, round(t, 4) AS t, {_r('mean', 0)} AS mean, {_r('sd', 0)} AS sd, {_r('mean-t*sd/sqrt(n)', 0)} AS low, {_r('mean+t*sd/sqrt(n)', 0)} AS high, {_r('sd/mean*100', 2)} AS cv_pct FROM st)"""
_li = "li AS (SELECT *, id%5 AS cix FROM listing)"
hom = lambda sid, subj: HOM.replace("SID", sid).replace("SUBJ", subj)
stat = lambda sid: STAT.replace("SID", sid)


@query("val_3_homologation", f"{comps_sql('listing', 'id')}, {_li}, {hom('id', 'li')} SELECT id, comp_id, factor, {_r('m2', 0)} AS price_m2, h AS price_m2_h FROM hn")
def _(v):
    l = with_condition(v)
    return vl.homologated(vl.comparables(l, l), l, l).select("id", "comp_id", "factor", "price_m2", "price_m2_h")


@query("val_4_small_statistics", f"{comps_sql('listing', 'id')}, {_li}, {hom('id', 'li')}, {stat('id')} SELECT id, n, t, mean, sd, low, high, cv_pct FROM so")
def _(v):
    l = with_condition(v)
    return vl.small_statistics(vl.homologated(vl.comparables(l, l), l, l)).select("id", "n", "t", "mean", "sd", "low", "high", "cv_pct")


_k = lambda x: f"{_r(f'{x}*area/1000', 0)}*1000"


@query("val_5_objectives", f"{comps_sql('listing', 'id')}, {_li}, {hom('id', 'li')}, {stat('id')} SELECT id, n, {_k('mean')} AS target, {_k('low')} AS minimum, {_k('high')} AS maximum FROM so JOIN listing USING (id) WHERE n >= 2")
def _(v):
    l = with_condition(v)
    return vl.appraise(l, l).select("id", "n", "target", "minimum", "maximum")


@query("val_6_manual_subjects", f"""sj AS (SELECT *, concat('city_', study_id%3) AS city, (study_id%400+50)*1000000 AS price, study_id%5 AS cix FROM study), {comps_sql('sj', 'study_id', False)}, {hom('study_id', 'sj')}, {stat('study_id')},
  bz AS (SELECT a.study_id, min(b.zone_id) AS zone_id FROM study a JOIN zone b ON {INSIDE} GROUP BY 1) SELECT study_id, n, {_k('mean')} AS target, {_k('low')} AS minimum, {_k('high')} AS maximum, zone_id FROM so JOIN sj USING (study_id) LEFT JOIN bz USING (study_id) WHERE n >= 2""")
def _(v):
    s = v.study.withColumns({"city": F.concat(F.lit("city_"), (c("study_id") % 3).cast("string")), "price": ((c("study_id") % 400) + 50) * 1_000_000, "condition": pick(_COND, c("study_id") % 5)})
    a = vl.appraise(s, with_condition(v), ident="study_id", same=False)
    z = geo.one_polygon(v.study.select("study_id", "lon", "lat"), v.zone, "zone_id", ["zone_id"])
    return a.join(z, "study_id").select("study_id", "n", "target", "minimum", "maximum", "zone_id")


SIM = """sm AS (SELECT a.id, b.id AS sim_id, round(abs(b.price-a.price)/a.price::DOUBLE + abs(b.area-a.area)/a.area, 9) AS dist FROM scored a JOIN scored b ON a.kind=b.kind AND b.price BETWEEN a.price*(1-0.20e0) AND a.price*(1+0.20e0) AND b.area BETWEEN a.area*(1-0.15e0) AND a.area*(1+0.15e0)
  WHERE a.area > 0 AND b.area > 0), sr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sim_id) AS rn FROM sm QUALIFY rn <= 5)"""


@query("sea_7_similar_listings", f"{SIM} SELECT id, sim_id, dist, rn FROM sr")
def _(v):
    return vl.similar(v.scored).withColumn("rn", c("rn").cast("long"))


RAW = SIM.replace("sm AS", "rm AS").replace("sr AS", "rr AS").replace("FROM sm", "FROM rm").replace("round(abs(b.price-a.price)/a.price::DOUBLE + abs(b.area-a.area)/a.area, 9)", "round(abs(b.price-a.price)::DOUBLE + abs(b.area-a.area), 6)").replace("rn <= 5", "rn <= 10")


@query("sea_7_similar_raw", f"{RAW} SELECT id, sim_id, dist, rn FROM rr")
def _(v):
    return vl.similar(v.scored, k=10, scaled=False).withColumn("rn", c("rn").cast("long"))


@query("val_7_verdicts", f"""{RAW}, av AS (SELECT rr.id, avg(price) AS sp, avg(composite) AS si, count(*) AS n FROM rr JOIN scored s ON s.id=sim_id WHERE rn <= 5 GROUP BY 1), g AS (SELECT s.id, n, round((price-sp)/sp*100, 9) AS gap, round(composite-si, 9) AS ig FROM scored s JOIN av USING (id))
  SELECT id, n AS n_similar, round(gap, 6) AS price_gap_pct, round(ig, 6) AS index_gap, CASE WHEN gap < -10 AND ig > 1e-12 THEN 'Excelente Oportunidad' WHEN gap < 0 AND ig >= -1e-12 THEN 'Buena Oportunidad' WHEN gap > 10 AND ig < -1e-12 THEN 'Sobrevalorado' ELSE 'Precio de Mercado' END AS verdict FROM g""")
def _(v):
    return vl.verdicts(v.scored, vl.similar(v.scored, k=10, scaled=False).where("rn <= 5")).select("id", "n_similar", R("price_gap_pct"), R("index_gap"), "verdict")


# ------------------------------------------------------------------- search

KIND_NAMES = ["Apartamento", "Casa", "Lote", "Oficina", "Local"]


def search_base(v):
    am = v.amenity.where("has").groupBy("id").agg(F.collect_set(F.when(c("name") == "Piscina", "tiene_piscina").when(c("name") == "Gimnasio", "tiene_gimnasio")
                                                                .when(c("name") == "Vigilancia 24h", "tiene_vigilancia").otherwise("otra")).alias("amenities"))
    d = v.scored.withColumn("kind", pick(KIND_NAMES, F.substring("kind", 1, 1).cast("int") - 1)).withColumn("locality", F.upper(pick(["Suba", "Usme", "Chapinero", "Kennedy", "Bosa"], c("id") % 5)))
    return d.join(am, "id", "left").withColumn("amenities", F.coalesce("amenities", F.array().cast("array<string>")))


def search_features(v):
    p = v.poi.select(c("poi_id").alias("fid"), "category", "lon", "lat")
    return p.unionByName(v.station.select((c("station_id") + 10_000_000_000).alias("fid"), c("layer").alias("category"), "lon", "lat"))


# Request parameters, not data: the texts a user types.
REQUESTS = [("a", "apartamento cerca de parque a 800 m"), ("b", "casa menos de 400 millones con 3 habitaciones"), ("c", "apartamento o casa cerca a colegio y farmacia"),
            ("d", "lote muy seguro en chapinero"), ("e", "oficina a 10 minutos de biblioteca con gimnasio"), ("f", "casa con piscina pegado a parque, índice > 3"),
            ("g", "local cerca de transmilenio a 60 m"), ("h", "apartamento más de 50 m2 bien conectado")]


def search_hits(v):
    log = v.spark.createDataFrame(REQUESTS, "qid string, q string")
    intents = stage(se.intents_of(log, "qid", "q"))
    return intents, se.ranked_search(search_base(v), search_features(v), intents)


# The same requests, read by hand: intent, kinds, categories, reach, price, area, rooms, locality, floors, amenity.
_ASKED = [("a", ["Apartamento"], ["parque"], 800, {}), ("b", ["Casa"], [], 600, {"price <=": 400000000, "rooms >=": 3}), ("c", ["Apartamento", "Casa"], ["farmacia", "colegio"], 600, {}),
          ("d", ["Lote"], [], 600, {"loc =": "'CHAPINERO'", "security >=": 3.5}), ("e", ["Oficina"], ["biblioteca"], 800, {"has": "Gimnasio"}), ("f", ["Casa"], ["parque"], 150, {"has": "Piscina", "composite >=": 3.0}),
          ("g", ["Local"], ["transmilenio"], 60, {}), ("h", ["Apartamento"], [], 600, {"price >=": 50000000, "area >=": 50.0, "access >=": 3.5})]


def _asked_sql(intent, kinds, cats, reach, rules):
    where = [f"kn IN ({', '.join(repr(k) for k in kinds)})"] + [f"id IN (SELECT id FROM amenity WHERE has AND name='{x}')" if r == "has" else f"{r} {x}" for r, x in rules.items()]
    d = [f"(SELECT d FROM nd WHERE nd.id=b0.id AND nd.category='{x}' AND d <= {reach})" for x in cats]
    close = "+".join(f"coalesce(greatest(0.0e0, 1-{x}/{reach}.0e0), 0.0e0)" for x in d)
    score = "composite/5.0e0*0.45e0" + (f" + ({close})/{len(d)}*0.40e0" if d else "")
    hard = " AND ".join(f"{x} IS NOT NULL" for x in d) or "true"
    return f"SELECT '{intent}' AS intent, id, round({score}, 9) AS score, {hard} AS hard FROM b0 WHERE {' AND '.join(where)}"


RANKED = f"""b0 AS (SELECT *, ({case_sql(KIND_NAMES, "(CAST(substr(kind,1,1) AS INT)-1)")}) AS kn, upper({case_sql(["Suba", "Usme", "Chapinero", "Kennedy", "Bosa"], "id%5")}) AS loc FROM scored WHERE lon IS NOT NULL AND composite IS NOT NULL AND (substr(kind,1,1) NOT IN ('1','2') OR price IS NULL OR price >= 30000000)),
  ft AS (SELECT category, lon, lat FROM poi WHERE category IN ('parque','farmacia','colegio','biblioteca') UNION ALL SELECT layer, lon, lat FROM station WHERE layer='transmilenio'), nd AS MATERIALIZED (SELECT a.id, b.category, CAST(round_even(min({HAV}), 0) AS INT) AS d FROM b0 a JOIN ft b ON true GROUP BY 1, 2),
  al AS ({" UNION ALL ".join(_asked_sql(*r) for r in _ASKED)}), rk AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY hard DESC, score DESC, id) AS rn, bool_or(hard) OVER (PARTITION BY intent) AS ah FROM al)"""


@query("sea_1_ranked_search", f"{RANKED} SELECT intent, id, score, rn FROM rk WHERE rn <= 20 AND (hard OR NOT ah)")
def _(v):
    return search_hits(v)[1].select("intent", "id", "score", c("rn").cast("long").alias("rn"))


@query("sea_2_relaxed_search", f"{RANKED} SELECT intent, id, score, hard, NOT ah AS relaxed, rn FROM rk WHERE rn <= 20 AND (hard OR NOT ah)")
def _(v):
    return search_hits(v)[1].select("intent", "id", "score", "hard", "relaxed", c("rn").cast("long").alias("rn"))


@query("scl_15_hit_explanations")
def _(v):
    return se.explain_hits(search_hits(v)[1]).select("intent", "id", "explanation")


@query("sea_3_suggestions")
def _(v):
    intents, hits = search_hits(v)
    return se.suggestions(intents, stage(hits.select("intent", "locality", "rn")))


@query("sea_4_near_any", f"""h AS (SELECT DISTINCT a.id FROM scored a JOIN poi b ON b.category IN ('colegio','ips') AND {BOX(1000)} WHERE {HAV} <= 1000) SELECT id, composite, round(price/composite, 2) AS ratio FROM scored JOIN h USING (id) WHERE composite >= 3 AND price <= 450000000
  ORDER BY composite DESC, price/composite, id LIMIT 20""")
def _(v):
    d = se.near_any(v.scored, v.poi, ["colegio", "ips"], 1000.0).where("composite >= 3 and price <= 450000000").withColumn("x", c("price") / c("composite"))
    return d.orderBy(F.desc("composite"), "x", "id").limit(20).select("id", "composite", F.round("x", 2).alias("ratio"))


@query("sea_4_custom_weight_rank")
def _(v):
    d = se.near_any(v.scored, v.poi, ["colegio", "ips"], 1000.0).where("composite >= 3").orderBy(F.desc("composite"), "id").limit(20)
    s = ind.profile_services(ind.class_counts(stage(d.select("id", "composite", "services", "lon", "lat")), v.poi), {"urbano": ind.PROFILES["urbano"]})
    return s.select("id", "composite", "services", "score").orderBy(F.desc("score"), "id")


@query("sea_5_context_listings", f"""h AS (SELECT a.id, count(*) FILTER (b.category IN ('ips','farmacia')) AS health FROM scored a JOIN poi b ON {BOX(500)} WHERE {HAV} <= 500 GROUP BY 1) SELECT s.id, zone_name, coalesce(health, 0) AS health FROM scored s JOIN zone USING (zone_id) LEFT JOIN h USING (id)
  WHERE zone_id IN (3, 7, 12) AND composite >= 2.5 AND price <= 300000000""")
def _(v):
    d = v.scored.where(c("zone_id").isin(3, 7, 12) & (c("composite") >= 2.5) & (c("price") <= 300_000_000)).select("id", "zone_id", "lon", "lat")
    n = geo.radius_aggregate(d, v.poi, 500, {"health": F.coalesce(F.sum(F.when(c("category").isin("ips", "farmacia"), c("mult"))), F.lit(0))}, ["category"], {"health": 0})
    return n.join(v.zone.select("zone_id", "zone_name"), "zone_id").select("id", "zone_name", "health")


@query("sea_6_all_amenities", """SELECT id, string_agg(DISTINCT name, ',' ORDER BY name) AS amenities FROM amenity WHERE has GROUP BY id HAVING count(DISTINCT name) FILTER (name IN ('Piscina','Ascensor')) = 2""")
def _(v):
    from plotwise.operators.relational import having_all

    a = v.amenity.where("has")
    ok = having_all(a.select("id").distinct(), a, "id", "name", ["Piscina", "Ascensor"])
    return a.join(ok, "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("amenities"))


@query("vec_1_cosine_topk", """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rn FROM s WHERE similarity >= 0.2) SELECT qid, vec_id, round(similarity, 6) AS similarity, rn FROM r WHERE rn <= 10""")
def _(v):
    e = v.table("embeddings")
    return vectors.cosine_topk(e, e, "vec_id", "embedding", 10, 0.2).select("qid", "vec_id", R("similarity"), c("rn").cast("long").alias("rn"))


@query("vec_2_centroids", "SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1,2")
def _(v):
    d = se.centroids(v.table("embeddings"), "label", "embedding")
    return d.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", c("pos").cast("long").alias("pos"), R("x"))


@query("vec_3_cache_upkeep", "SELECT user_id, event_type, count(*) AS hits, max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY AS keep FROM events GROUP BY 1,2")
def _(v):
    return se.cache_upkeep(v.table("events"), ["user_id", "event_type"], "ts", F.lit("2024-01-30").cast("timestamp"), 2).drop("last_used")


# ------------------------------------------------------------------- upsert

CUT = "1998-01-01"
_F = ["price", "state", "area"]


def split_scrape(v):
    cut = F.lit(CUT).cast("timestamp")
    s = v.scrape.withColumns({"price": F.when(c("price") % 11 != 0, c("price"))})
    old, new = s.where(c("ts") < cut), s.where(c("ts") >= cut)
    snap = up.latest_per_key(old, ["key"], c("seq")).select("key", *_F)
    seen = old.groupBy("key").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("scrapes"))
    return snap.join(seen, "key"), new


UPSERT = f"""sc AS (SELECT * REPLACE (CASE WHEN price%11<>0 THEN price END AS price) FROM scrape), o AS (SELECT key, count(*) AS k, min(ts) AS f, max(ts) AS l FROM sc WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1),
  ol AS (SELECT * FROM sc WHERE ts < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC)=1), n AS (SELECT key, count(*) AS k FROM sc WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1),
  nl AS (SELECT * FROM sc WHERE ts >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC)=1),
  j AS (SELECT coalesce(ol.key, nl.key) AS key, ol.key AS ok, nl.key AS nk, ol.price AS op, ol.state AS os, ol.area AS oa, coalesce(nl.price, ol.price) AS price, coalesce(nl.state, ol.state) AS state, coalesce(nl.area, ol.area) AS area FROM ol FULL JOIN nl ON ol.key=nl.key),
  r AS (SELECT *, CASE WHEN ok IS NULL OR nk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN price IS DISTINCT FROM op THEN 'price' END, CASE WHEN state IS DISTINCT FROM os THEN 'state' END, CASE WHEN area IS DISTINCT FROM oa THEN 'area' END) END AS changes FROM j)"""


@query("ups_1_keyed_upsert", f"""{UPSERT}
  SELECT r.key, price, state, area, strftime(coalesce(o.f, TIMESTAMP '2030-01-01'), '%Y-%m-%d') AS first_seen, strftime(CASE WHEN nk IS NULL THEN o.l ELSE TIMESTAMP '2030-01-01' END, '%Y-%m-%d') AS last_seen, coalesce(o.k,0)+coalesce(n.k,0) AS scrapes,
  CASE WHEN ok IS NULL THEN 'inserted' WHEN nk IS NULL THEN 'kept' WHEN changes <> '' THEN 'updated' ELSE 'unchanged' END AS action, changes FROM r LEFT JOIN o ON o.key=r.key LEFT JOIN n ON n.key=r.key""")
def _(v):
    cur, batch = split_scrape(v)
    d = up.upsert(cur, batch, ["key"], _F, F.lit("2030-01-01").cast("timestamp"), c("seq"))
    day = lambda n: F.date_format(n, "yyyy-MM-dd").alias(n)
    return d.select("key", *_F, day("first_seen"), day("last_seen"), "scrapes", "action", F.array_join("changes", ",").alias("changes"))


@query("ups_1_action_counts", f"{UPSERT} SELECT CASE WHEN ok IS NULL THEN 'inserted' WHEN nk IS NULL THEN 'kept' WHEN changes <> '' THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS n FROM r GROUP BY 1")
def _(v):
    cur, batch = split_scrape(v)
    return up.upsert(cur, batch, ["key"], _F, F.lit("2030-01-01").cast("timestamp"), c("seq")).groupBy("action").agg(F.count("*").alias("n"))


@query("ups_2_dedupe_backfill", f"""s AS (SELECT key, CASE WHEN price%3<>0 THEN price END AS price, CASE WHEN price%5<>0 THEN area END AS area, row_number() OVER (PARTITION BY key ORDER BY CASE state WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, {SCRAPE_ORDER}) AS p FROM scrape)
  SELECT key, arg_min(price, p) FILTER (price IS NOT NULL) AS price, arg_min(area, p) FILTER (area IS NOT NULL) AS area, count(*) AS copies FROM s GROUP BY 1""")
def _(v):
    s = v.scrape.withColumns({"area": F.when(c("price") % 5 != 0, c("area")), "price": F.when(c("price") % 3 != 0, c("price"))})
    rank = F.when(c("state") == "A", 0).when(c("state") == "N", 1).otherwise(2)
    return up.dedupe_backfill(s, ["key"], ["price", "area"], F.struct(rank.alias("r"), c("ts"), c("seq")))


@query("ups_3_insert_missing", "SELECT DISTINCT id, name FROM amenity a WHERE NOT EXISTS (SELECT 1 FROM amenity b WHERE b.has AND a.id=b.id AND a.name=b.name)")
def _(v):
    return up.insert_missing(v.amenity.where("has"), v.amenity, ["id", "name"]).select("id", "name")


@query("str_1_change_audit_batch", "w AS (SELECT key, ts, price, state, area, lag(price) OVER o AS pp, lag(state) OVER o AS ps, lag(area) OVER o AS pa, row_number() OVER o AS rn FROM scrape WINDOW o AS (PARTITION BY key ORDER BY ts, s1, s2, s3, s4, s5)) "
       + " UNION ALL ".join(f"SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\", '{f}' AS field, {cast(o)} AS old, {cast(n)} AS new FROM w WHERE rn > 1 AND {n} IS DISTINCT FROM {o}" for f, o, n, cast in (
           ("price", "pp", "price", lambda x: f"CAST({x} AS VARCHAR)"), ("state", "ps", "state", lambda x: x), ("area", "pa", "area", lambda x: f"CAST({x} AS VARCHAR)"))))
def _(v):
    return up.change_history(v.scrape, "key", "ts", ["seq"], _F).withColumn("ts", F.unix_seconds("ts")).withColumnRenamed("ts", "at")
