"""Joins, aggregations, windows, ranks, top-k, set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotwise.fixtures import OFFENCES, SCORES
from plotwise.functions import labels as lb
from plotwise.functions import mathx as mx
from plotwise.operators import aggregates as ag
from plotwise.operators import ranking as rk
from plotwise.operators import relational as rel
from plotwise.registry.a_functions import sql_bands
from plotwise.registry.core import query

c = F.col
ALL = SCORES + ["composite"]
r6 = lambda n, d=6: F.round(c(n), d).alias(n)

# ------------------------------------------------------------------- joins


@query("jon_1_weights_join", "SELECT id, kind, round(access * w, 6) AS weighted FROM scored JOIN (VALUES ('1-URGENT', 0.5e0), ('2-HIGH', 0.4e0), ('5-LOW', 0.1e0)) t(k, w) ON kind = k")
def _(v):
    # Three literal rows: safe to broadcast.
    w = v.spark.createDataFrame([("1-URGENT", 0.5), ("2-HIGH", 0.4), ("5-LOW", 0.1)], "kind string, w double")
    return v.scored.join(F.broadcast(w), "kind").select("id", "kind", F.round(c("access") * c("w"), 6).alias("weighted"))


@query("jon_2_zones_left_aggregate", "SELECT z.zone_id, zone_name, count(id) AS n, max(price) AS top_price FROM zone z LEFT JOIN scored s ON s.zone_id = z.zone_id GROUP BY ALL")
def _(v):
    per = v.scored.groupBy("zone_id").agg(F.count("*").alias("n"), F.max("price").alias("top_price"))
    return v.zone.select("zone_id", "zone_name").join(per, "zone_id", "left").fillna(0, ["n"])


@query("jon_3_filter_in_join", "SELECT z.zone_id, count(id) AS n FROM zone z LEFT JOIN scored s ON s.zone_id = z.zone_id AND kind='2-HIGH' AND composite > 4 GROUP BY 1")
def _(v):
    z, s = v.zone.alias("z"), v.scored.alias("s")
    cond = (c("z.zone_id") == c("s.zone_id")) & (c("s.kind") == "2-HIGH") & (c("s.composite") > 4)
    return z.join(s, cond, "left").groupBy(c("z.zone_id").alias("zone_id")).agg(F.count("s.id").alias("n"))


@query("jon_4_name_join", "SELECT a.zone_id, a.zone_name, b.barrio_id FROM zone a JOIN (SELECT barrio_id, 'nation_'||barrio_id AS nm FROM barrio) b ON lower(zone_name)=nm")
def _(v):
    b = v.barrio.select("barrio_id", F.concat(F.lit(" Nátion_"), c("barrio_id").cast("string")).alias("nm"))
    return rel.name_join(v.zone.select("zone_id", "zone_name"), b, "zone_name", "nm").drop("nm")


@query("jon_5_has_all_amenities", """SELECT id FROM listing WHERE EXISTS (SELECT 1 FROM amenity a WHERE a.id=listing.id AND name='Piscina')
  AND EXISTS (SELECT 1 FROM amenity a WHERE a.id=listing.id AND name='Gimnasio')""")
def _(v):
    return rel.having_all(v.listing.select("id"), v.amenity, "id", "name", ["Piscina", "Gimnasio"])


@query("jon_6_absent_listings", "SELECT id FROM listing WHERE NOT EXISTS (SELECT 1 FROM amenity a WHERE a.id=listing.id AND has)")
def _(v):
    return v.listing.select("id").join(v.amenity.where("has"), "id", "left_anti")


@query("jon_7_band_comparables", """SELECT a.id, count(b.id) AS matches FROM listing a LEFT JOIN listing b ON a.city=b.city AND a.kind=b.kind
  AND b.area BETWEEN a.area*(1-0.2e0) AND a.area*(1+0.2e0) AND b.price BETWEEN a.price*(1-0.3e0) AND a.price*(1+0.3e0) WHERE a.area > 0 AND a.price > 0 GROUP BY a.id""")
def _(v):
    cols = ["id", "city", "kind", "area", "price"]
    return rel.band_counts(v.listing.select(*cols), v.listing.select(*cols), ["city", "kind"], {"area": 0.2, "price": 0.3}).select("id", "matches")


@query("jon_8_global_maximum", "SELECT zone_id, round(click::DOUBLE/max(click) OVER (), 6) AS click_share, round(error::DOUBLE/max(error) OVER (), 6) AS error_share FROM crime")
def _(v):
    top = v.crime.agg(F.max("click").alias("a"), F.max("error").alias("b"))
    return v.crime.select("zone_id", F.round(c("click") / top.select("a").scalar(), 6).alias("click_share"),
                          F.round(c("error") / top.select("b").scalar(), 6).alias("error_share"))


@query("jon_9_lateral_total", """SELECT s.zone_id, kind, count(*) AS n, any_value(t) AS zone_total FROM scored s JOIN (SELECT zone_id, count(DISTINCT id) AS t FROM scored GROUP BY 1) z
  ON z.zone_id=s.zone_id GROUP BY ALL""")
def _(v):
    s = v.scored.where("zone_id is not null")
    total = s.groupBy("zone_id").agg(F.count_distinct("id").alias("zone_total"))
    return s.groupBy("zone_id", "kind").agg(F.count("*").alias("n")).join(total, "zone_id")


@query("jon_10_correlated_weights", """SELECT zone_id, round(click*(SELECT w FROM (VALUES ('click',0.45e0),('error',0.25e0)) t(o,w) WHERE o='click')
  + error*(SELECT w FROM (VALUES ('click',0.45e0),('error',0.25e0)) t(o,w) WHERE o='error'), 6) AS mass FROM crime""")
def _(v):
    w = v.spark.createDataFrame([("click", 0.45), ("error", 0.25)], "o string, w double")
    pick = lambda o: w.where(c("o") == o).select("w").scalar()
    return v.crime.select("zone_id", F.round(c("click") * pick("click") + c("error") * pick("error"), 6).alias("mass"))


@query("jon_11_detail_record", """SELECT s.id, zone_name, coalesce(n.k, 0) AS amenities, z.avg_c AS zone_index, e.views FROM scored s LEFT JOIN zone USING (zone_id)
  LEFT JOIN (SELECT id, count(*) AS k FROM amenity WHERE has GROUP BY 1) n ON n.id=s.id
  LEFT JOIN (SELECT zone_id, round(avg(composite),6) AS avg_c FROM scored WHERE zone_id IS NOT NULL GROUP BY 1) z ON z.zone_id=s.zone_id
  LEFT JOIN (SELECT user_id, count(*) AS views FROM events GROUP BY 1) e ON e.user_id=s.id""")
def _(v):
    n = v.amenity.where("has").groupBy("id").agg(F.count("*").alias("amenities"))
    z = v.scored.where("zone_id is not null").groupBy("zone_id").agg(F.round(F.avg("composite"), 6).alias("zone_index"))
    e = v.table("events").groupBy(c("user_id").alias("id")).agg(F.count("*").alias("views"))
    return (v.scored.select("id", "zone_id").join(v.zone.select("zone_id", "zone_name"), "zone_id", "left").join(n, "id", "left")
            .join(z, "zone_id", "left").join(e, "id", "left").select("id", "zone_name", F.coalesce("amenities", F.lit(0)).alias("amenities"), "zone_index", "views"))


# ------------------------------------------------------------- aggregations

_avgs = ", ".join(f"round(avg({s}),6) AS avg_{s}" for s in ALL)


@query("agg_1_zone_statistics", f"""SELECT z.zone_id, zone_name, count(id) AS n, avg(price) AS avg_price, min(price) AS min_price, max(price) AS max_price, {_avgs},
  count(*) FILTER (kind='1-URGENT') AS n_urgent, count(*) FILTER (kind='5-LOW') AS n_low FROM zone z LEFT JOIN scored s ON s.zone_id=z.zone_id GROUP BY 1,2""")
def _(v):
    return ag.zone_statistics(v.zone, v.scored, "zone_id", "zone_name", ALL, {"urgent": "1-URGENT", "low": "5-LOW"})


@query("agg_2_price_distribution", """SELECT kind, count(*) AS n, avg(price) AS avg_price, min(price) AS min_price, max(price) AS max_price, avg(area) AS avg_area,
  round(avg(price/area), 2) AS avg_price_m2, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS p75 FROM listing WHERE area IS NOT NULL GROUP BY kind""")
def _(v):
    return ag.price_distribution(v.listing).withColumn("avg_price_m2", F.round("avg_price_m2", 2))


@query("agg_3_groups_with_minimum", f"SELECT zone_id, kind, count(*) AS n, {_avgs} FROM scored WHERE zone_id IS NOT NULL GROUP BY 1,2 HAVING count(*) >= 50")
def _(v):
    return ag.group_averages(v.scored.where("zone_id is not null"), ["zone_id", "kind"], ALL, 50)


@query("agg_4_filtered_counts", """SELECT city, count(*) FILTER (price > 300000000) AS dear, count(DISTINCT kind) AS kinds, count(DISTINCT stratum) FILTER (rooms >= 4) AS strata,
  avg(price) FILTER (baths >= 2) AS avg_two_baths FROM listing GROUP BY city""")
def _(v):
    return v.listing.groupBy("city").agg(
        F.count(F.when(c("price") > 300_000_000, 1)).alias("dear"), F.count_distinct("kind").alias("kinds"),
        F.count_distinct(F.when(c("rooms") >= 4, c("stratum"))).alias("strata"), F.avg(F.when(c("baths") >= 2, c("price"))).alias("avg_two_baths"))


@query("agg_5_index_summary", """SELECT count(*) AS total, count(access) AS n, round(avg(access),6) AS mean, round(stddev_samp(access),6) AS sd, min(access) AS min, max(access) AS max,
  round(count(access)*100.0/count(*),6) AS cover_pct, quantile_cont(access,0.25) AS q1, quantile_cont(access,0.5) AS median, quantile_cont(access,0.75) AS q3 FROM scored""")
def _(v):
    return ag.score_summary(v.scored, "access").withColumns({x: F.round(x, 6) for x in ("mean", "sd", "cover_pct")})


@query("agg_6_category_histogram", f"SELECT label, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (), 6) AS pct FROM (SELECT {sql_bands('composite', lb.INDEX_BANDS, lb.INDEX_LOWEST)} AS label FROM scored) GROUP BY label")
def _(v):
    return ag.share_histogram(v.scored, lb.index_label(c("composite"))).withColumn("pct", F.round("pct", 6))


@query("agg_7_distribution_per_kind", """SELECT kind, count(*) AS total, count(security) AS n, round(avg(security),6) AS mean, round(stddev_samp(security),6) AS sd, min(security) AS min, max(security) AS max,
  round(count(security)*100.0/count(*),6) AS cover_pct, quantile_cont(security,0.25) AS q1, quantile_cont(security,0.5) AS median, quantile_cont(security,0.75) AS q3 FROM scored GROUP BY kind""")
def _(v):
    return ag.score_summary(v.scored, "security", ["kind"]).withColumns({x: F.round(x, 6) for x in ("mean", "sd", "cover_pct")})


@query("agg_8_width_histogram", """SELECT CASE WHEN access < 0 THEN 0 WHEN access >= 5 THEN 21 ELSE CAST(floor(access/5*20) AS BIGINT)+1 END AS bin, count(*) AS n, min(access) AS lo, max(access) AS hi
  FROM scored WHERE access IS NOT NULL GROUP BY 1""")
def _(v):
    return ag.width_histogram(v.scored, "access", 0, 5, 20)


@query("agg_9_box_statistics", " UNION ALL ".join(f"SELECT '{s}' AS dim, min({s}) AS min, quantile_cont({s},0.25) AS q1, quantile_cont({s},0.5) AS median, quantile_cont({s},0.75) AS q3, max({s}) AS max FROM scored" for s in ALL).replace("SELECT", "SELECT", 1))
def _(v):
    return ag.box_statistics(v.scored, ALL)


_pairs = [(a, b) for i, a in enumerate(ALL) for b in ALL[i + 1:]]
_full = "f AS (SELECT * FROM scored WHERE access IS NOT NULL AND security IS NOT NULL AND zoning IS NOT NULL)"


@query("agg_10_pearson", _full + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM f" for a, b in _pairs))
def _(v):
    return ag.correlation_pairs(v.scored.dropna(subset=ALL), ALL).withColumn("r", F.round("r", 6))


_ranks = ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1)/2.0e0 AS {s}" for s in ALL)


@query("agg_10_spearman", _full + f", k AS (SELECT {_ranks} FROM f) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM k" for a, b in _pairs))
def _(v):
    return ag.correlation_pairs(v.scored.select(*ALL), ALL, "spearman").withColumn("r", F.round("r", 6))


@query("agg_11_amenity_catalog", "SELECT name, count(*) AS n FROM amenity WHERE has AND name ILIKE '%a%' GROUP BY name HAVING count(*) >= 10")
def _(v):
    return ag.amenity_catalog(v.amenity, "%a%", 10)


@query("agg_12_amenity_share", """SELECT zone_id, name, count(*) AS n, count(DISTINCT id) AS listings, any_value(t) AS zone_listings, CAST(round(CAST(100.0*count(*)/any_value(t) AS DECIMAL(18,6)), 1) AS DOUBLE) AS pct
  FROM amenity JOIN scored USING (id) JOIN (SELECT zone_id, count(*) AS t FROM scored GROUP BY 1) USING (zone_id) WHERE has GROUP BY 1,2 HAVING count(*) >= 3""")
def _(v):
    return ag.amenity_share(v.scored, v.amenity, "zone_id")


_flags = ", ".join(f"coalesce(bool_or({' OR '.join(f'name ILIKE {chr(39)}{p}{chr(39)}' for p in ps)}), false) AS {f}" for f, ps in ag.AMENITY_FLAGS.items())


@query("agg_13_amenity_flags", f"SELECT l.id, {_flags}, count(a.name) AS n_amenities FROM listing l LEFT JOIN (SELECT * FROM amenity WHERE has) a ON a.id=l.id GROUP BY l.id")
def _(v):
    return ag.amenity_flags(v.listing, v.amenity)


_TERMS = {"Piscina": "piscina", "Gimnasio": "gimnasio", "Parqueadero": "parqueadero", "Vigilancia 24h": "portería 24 horas", "Ascensor": "ascensor",
          "Zona BBQ": "zona de parrilla", "Depósito": "depósito"}


@query("agg_14_amenity_score", "t AS (SELECT id, CASE name " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in _TERMS.items()) + " END AS term FROM amenity WHERE has), w AS (SELECT id, term, CASE term "
       + " ".join(f"WHEN '{t}' THEN {x}e0" for t, x in ag.AMENITY_WEIGHTS.items()) + f""" ELSE 1.0e0 END AS w FROM t)
  SELECT id, round(sum(w),6) AS raw, count(*) AS n, array_to_string(list_sort(list_distinct(list(term))), ',') AS amenities, round(least(5.0e0, sum(w)*5.0e0/{sum(ag.AMENITY_WEIGHTS.values())!r}e0), 6) AS score FROM w GROUP BY id""")
def _(v):
    from plotwise.functions import text as tx

    s = ag.amenity_score(v.amenity, term=tx.amenity_term(tx.clean_amenity(c("name"))))
    return s.select("id", r6("raw"), "n", F.array_join("amenities", ",").alias("amenities"), r6("score"))


@query("agg_15_health_counters", """SELECT kind, site, count(*) AS n, count(*) FILTER (zone_id IS NULL) AS no_zone, count(*) FILTER (price IS NULL) AS no_price, count(*) FILTER (lon IS NULL) AS no_point,
  count(*) FILTER (composite IS NULL) AS no_index, count(*) FILTER (area IS NULL) AS no_area FROM scored GROUP BY 1,2""")
def _(v):
    return ag.health_counters(v.scored)


@query("agg_16_layer_counts", "SELECT 'poi' AS layer, category, count(*) AS n FROM poi GROUP BY 2 UNION ALL SELECT 'station' AS layer, layer AS category, count(*) AS n FROM station GROUP BY layer")
def _(v):
    p = v.poi.select(F.lit("poi").alias("layer"), "category")
    s = v.station.select(F.lit("station").alias("layer"), c("layer").alias("category"))
    return p.unionByName(s).groupBy("layer", "category").agg(F.count("*").alias("n"))


@query("agg_17_level_summary", """z AS (SELECT zone_id, avg(composite) AS composite FROM scored WHERE zone_id IS NOT NULL GROUP BY 1), k AS (SELECT zone_id, kind, avg(access) AS composite FROM scored WHERE zone_id IS NOT NULL GROUP BY 1,2)
  SELECT 'zone' AS level, count(*) AS n, count(composite) AS with_index, round(avg(composite),6) AS mean FROM z UNION ALL SELECT 'zone_kind', count(*), count(composite), round(avg(composite),6) FROM k
  UNION ALL SELECT 'listing', count(*), count(composite), round(avg(composite),6) FROM scored""")
def _(v):
    s = v.scored.where("zone_id is not null")
    lv = {"zone": s.groupBy("zone_id").agg(F.avg("composite").alias("composite")),
          "zone_kind": s.groupBy("zone_id", "kind").agg(F.avg("access").alias("composite")), "listing": v.scored}
    return ag.level_summary(lv, "composite").withColumn("mean", F.round("mean", 6))


@query("agg_18_overview", """SELECT count(*) AS n, avg(price) AS avg_price, round(avg(composite),6) AS avg_index, count(*) FILTER (composite >= 4) AS high, count(*) FILTER (composite >= 3 AND composite < 4) AS middle,
  count(*) FILTER (composite < 3) AS low, count(DISTINCT kind) AS kinds, count(*) FILTER (listed >= TIMESTAMP '1998-06-30' - INTERVAL 7 DAY) AS last_7,
  count(*) FILTER (listed >= TIMESTAMP '1998-06-30' - INTERVAL 30 DAY) AS last_30 FROM scored""")
def _(v):
    return ag.overview(v.scored, "composite", "listed", F.lit("1998-06-30").cast("timestamp")).withColumn("avg_index", F.round("avg_index", 6))


_d1 = lambda x, d=1: f"CAST(round(CAST({x} AS DECIMAL(18,9)), {d}) AS DOUBLE)"
_cross = f"""count(*) AS n, {_d1('count(*) FILTER (p102=2)::DOUBLE/count(*)*100')} AS pct_unsafe, coalesce({_d1('avg(score) FILTER (score BETWEEN 1 AND 5)', 2)}, 0) AS mean_score"""


@query("agg_19_survey_crosstab", f"""SELECT locality, stratum, {_cross}, {_d1('count(*) FILTER (p203=1)::DOUBLE/count(*)*100')} AS pct_victim FROM survey GROUP BY 1,2 HAVING count(*) >= 20""")
def _(v):
    return ag.survey_crosstab(v.survey, ["locality", "stratum"], 20)


@query("agg_19_survey_margins", f"SELECT sex, age, {_cross} FROM survey GROUP BY CUBE (sex, age)")
def _(v):
    return ag.survey_margins(v.survey, ["sex", "age"])


@query("agg_19_survey_top_answers", """SELECT locality, answer, n, place FROM (SELECT *, row_number() OVER (PARTITION BY locality ORDER BY n DESC, answer) AS place FROM
  (SELECT locality, answer, count(*) AS n FROM (SELECT locality, answer_a AS answer FROM survey UNION ALL SELECT locality, answer_b FROM survey) GROUP BY 1,2)) WHERE place <= 3""")
def _(v):
    return ag.top_answers(v.survey, "locality", ["answer_a", "answer_b"], 3)


@query("agg_20_insecurity_index", f"""a AS (SELECT locality, count(*) AS n, count(*) FILTER (p102=2)::DOUBLE/count(*) AS u, coalesce({_d1('avg(score) FILTER (score BETWEEN 1 AND 5)', 2)}, 0) AS mean_score,
  count(*) FILTER (score BETWEEN 1 AND 5) AS ns, count(*) FILTER (p203=1)::DOUBLE/count(*) AS v, count(*) FILTER (age=3)::DOUBLE/count(*) AS a, count(*) FILTER (sex=1)::DOUBLE/count(*) AS t FROM survey GROUP BY 1)
  SELECT locality, n, mean_score, {_d1('u*100')} AS pct_unsafe, {_d1('v*100')} AS pct_victim, {_d1('v*1000')} AS victims_per_1000,
  {_d1('(u*0.30e0 + CASE WHEN ns>0 THEN (5-mean_score)/4 ELSE 0.5e0 END*0.25e0 + least(v*4,1.0e0)*0.20e0 + a*0.15e0 + least(t*2,1.0e0)*0.10e0)*5', 2)} AS index FROM a""")
def _(v):
    return ag.insecurity_index(v.survey, "locality", unsafe=c("p102") == 2, score="score", victim=c("p203") == 1, worse=c("age") == 3, witness=c("sex") == 1)


_PROF = ["bajo_alto", "alto_bajo", "bajo_bajo", "alto_alto", "otro"]


@query("agg_21_security_paradox", "z AS (SELECT zone_id, zone_name, (['" + "','".join(_PROF) + "'])[CAST(zone_id%5 AS INT)+1] AS profile FROM zone) SELECT z.zone_id, zone_name, profile, CASE profile "
       + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in ag.PARADOX_LABELS.items()) + " ELSE 'Sin clasificar' END AS reading, count(id) AS n, round(avg(security),6) AS avg_security, avg(price) AS avg_price FROM z LEFT JOIN scored s ON s.zone_id=z.zone_id GROUP BY ALL")
def _(v):
    from plotwise.fixtures import pick

    z = v.zone.select("zone_id", "zone_name", pick(_PROF, c("zone_id") % 5).alias("profile"))
    return ag.security_paradox(z, v.scored, "zone_id")


@query("agg_22_opportunity_summary", """SELECT kind, count(*) AS n, avg(price) AS avg_price, round(avg(composite),6) AS avg_index, round(avg(price/composite),2) AS avg_ratio, round(quantile_cont(price/composite,0.5),4) AS median_ratio,
  round(quantile_cont(price/composite,0.9),4) AS p90_ratio FROM scored WHERE composite > 0 GROUP BY kind""")
def _(v):
    d = v.scored.where("composite > 0").withColumn("ratio", c("price") / c("composite"))
    a = d.groupBy("kind").agg(F.count("*").alias("n"), F.avg("price").alias("avg_price"), F.round(F.avg("composite"), 6).alias("avg_index"), F.round(F.avg("ratio"), 2).alias("avg_ratio"))
    q = rk.exact_quantiles(d, "ratio", {"median_ratio": 0.5, "p90_ratio": 0.9}, ["kind"]).select("kind", r6("median_ratio", 4), r6("p90_ratio", 4))
    return a.join(q, "kind")


# ------------------------------------------------------------------ windows


@query("win_1_percent_score", "SELECT id, round(5*percent_rank() OVER (PARTITION BY kind ORDER BY dwelling), 9) AS score FROM scored")
def _(v):
    return rk.percent_score(v.scored, "dwelling", "score", ["kind"]).select("id", r6("score", 9))


@query("win_2_rank_desc", "SELECT id, rank() OVER (PARTITION BY kind ORDER BY composite DESC) AS rank FROM scored")
def _(v):
    return rk.with_rank(v.scored, "composite", ["kind"], descending=True).select("id", "rank")


@query("win_3_percentiles", """SELECT id, round(percent_rank() OVER (ORDER BY price), 9) AS pct_all, round(percent_rank() OVER (PARTITION BY kind ORDER BY price), 9) AS pct_kind,
  round(percent_rank() OVER (ORDER BY composite), 9) AS pct_index FROM scored""")
def _(v):
    d = rk.with_ranks(v.scored.select("id", "kind", "price", "composite"),
                      {"a_": ("price", [], False), "k_": ("price", ["kind"], False), "c_": ("composite", [], False)})
    return d.select("id", F.round("a_pct_rank", 9).alias("pct_all"), F.round("k_pct_rank", 9).alias("pct_kind"), F.round("c_pct_rank", 9).alias("pct_index"))


OPP_SQL = """CASE WHEN composite >= 4.0 AND p <= 0.25 THEN 'Excelente Oportunidad' WHEN composite >= 3.5 AND p <= 0.33 THEN 'Muy Buena Oportunidad'
  WHEN composite >= 3.0 AND p <= 0.50 THEN 'Buena Oportunidad' WHEN p <= 0.50 THEN 'Oportunidad Razonable' WHEN p >= 0.75 THEN 'Sobrevalorado' ELSE 'Precio Justo' END"""


@query("win_4_opportunity_class", f"SELECT id, {OPP_SQL} AS class FROM (SELECT *, percent_rank() OVER (ORDER BY price/composite) AS p FROM scored WHERE composite > 0)")
def _(v):
    from plotwise.operators.indicators import opportunity_class

    d = v.scored.where("composite > 0").withColumn("ratio", c("price") / c("composite"))
    return rk.with_rank(d, "ratio").select("id", opportunity_class(c("composite"), c("pct_rank")).alias("class"))


_zr = ", ".join(f"rank() OVER (ORDER BY avg_{s} DESC) AS rank_avg_{s}" for s in ALL[1:])


@query("win_5_zone_ranking", f"SELECT zone_id, n, {_zr} FROM (SELECT zone_id, count(*) AS n, {_avgs} FROM scored WHERE zone_id IS NOT NULL GROUP BY 1)")
def _(v):
    z = ag.group_averages(v.scored.where("zone_id is not null"), ["zone_id"], ALL, 1)
    return rel.zone_ranks(z, [f"avg_{s}" for s in ALL[1:]]).select("zone_id", "n", *[f"rank_avg_{s}" for s in ALL[1:]])


@query("win_6_share_of_total", "SELECT city, kind, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (PARTITION BY city), 6) AS pct FROM listing GROUP BY 1,2")
def _(v):
    g = v.listing.groupBy("city", "kind").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(c("n") * 100.0 / F.sum("n").over(Window.partitionBy("city")), 6))


@query("win_7_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(v):
    from plotwise.operators.upsert import latest_per_key

    return latest_per_key(v.table("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.struct("ts", "event_id")).drop("ts")


@query("win_8_price_history", """SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS at, price, prev, round((price-prev)*100.0/prev, 6) AS change_pct FROM (SELECT key, ts, price, lag(price) OVER (PARTITION BY key ORDER BY ts, s1, s2, s3, s4, s5) AS prev FROM scrape)""")
def _(v):
    d = rel.lag_by_time(v.scrape, "key", "ts", ["seq"], ["price"])
    return d.select("key", F.unix_seconds("ts").alias("at"), "price", c("prev_price").alias("prev"),
                    F.round(F.try_divide((c("price") - c("prev_price")) * 100.0, c("prev_price")), 6).alias("change_pct"))


@query("win_9_session_tail", """SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""")
def _(v):
    return rel.last_turns(v.turns, ["conv_id"], "turn", 4).select("conv_id", "turn", "role")


@query("win_9_last_distinct_ids", """l AS (SELECT user_id, event_id%40 AS item, max(event_id) AS o FROM events GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o DESC, item) AS rn FROM l)
  SELECT user_id, string_agg(item::VARCHAR, ',' ORDER BY rn) AS ids FROM k WHERE rn <= 30 GROUP BY user_id""")
def _(v):
    e = v.table("events").withColumn("item", c("event_id") % 40)
    return rel.last_ids(e, ["user_id"], "item", "event_id", 30).select("user_id", F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


@query("rnk_1_minmax", "SELECT id, round((price-min(price) OVER ())*5.0e0/(max(price) OVER ()-min(price) OVER ()), 9) AS score, round(least(5.0e0, greatest(0.0e0, (dwelling-1.0e0)/3.0e0*5)), 9) AS bounded, 2.5e0 AS constant FROM scored")
def _(v):
    d = rk.minmax_score(v.scored.withColumn("one", F.lit(1.0)), "price", "score")
    d = rk.minmax_score(d, "dwelling", "bounded", lo=1.0, hi=4.0)
    return rk.minmax_score(d, "one", "constant").select("id", r6("score", 9), r6("bounded", 9), "constant")


@query("rnk_2_zscore", "SELECT id, round(least(5.0e0, greatest(0.0e0, ((price-avg(price) OVER ())/stddev_pop(price) OVER ()+1.5e0)/3.0e0*5)), 7) AS score FROM scored")
def _(v):
    return rk.zscore_score(v.scored, "price", "score", 1.5).select("id", r6("score", 7))


@query("rnk_3_average_rank", """SELECT id, rank() OVER (ORDER BY dwelling) + (count(*) OVER (PARTITION BY dwelling)-1)/2.0e0 AS avg_rank,
  round((rank() OVER (ORDER BY dwelling) + (count(*) OVER (PARTITION BY dwelling)-1)/2.0e0 - 1)/(count(*) OVER ()-1)*5, 9) AS score FROM scored""")
def _(v):
    d = rk.with_rank(v.scored, "dwelling")
    score = (c("avg_rank") - 1) / (c("n") - 1) * 5
    return d.select("id", c("avg_rank").cast("double").alias("avg_rank"), F.round(score, 9).alias("score"))


def probit_sql(p):
    """Normal quantile by the same rational approximation, written out."""
    poly = lambda cs, x: "(" + f"*{x}+".join(["(" * (len(cs) - 1) + f"({cs[0]!r}e0)"] + [f"({k!r}e0))" for k in cs[1:]]) + ")"
    q = f"sqrt(-2*ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1-{p} END))"
    r = f"(({p}-0.5)*({p}-0.5))"
    tail, mid = f"{poly(mx._C, q)}/{poly(mx._D + [1.0], q)}", f"({p}-0.5)*{poly(mx._A, r)}/{poly(mx._B + [1.0], r)}"
    return f"CASE WHEN {p} BETWEEN 0.02425e0 AND 1-0.02425e0 THEN {mid} WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END"


@query("rnk_4_gaussian_ecdf", f"""r AS (SELECT id, dwelling, (rank() OVER (ORDER BY dwelling) + (count(*) OVER (PARTITION BY dwelling) - 1)/2.0e0)/(count(*) OVER () + 1.0e0) AS p FROM scored WHERE dwelling IS NOT NULL), z AS (SELECT id, {probit_sql('p')} AS z FROM r)
  SELECT scored.id, round((z - min(z) OVER ())/(max(z) OVER () - min(z) OVER ())*5, 6) AS score FROM scored LEFT JOIN z USING (id)""")
def _(v):
    return rk.gaussian_ecdf_score(v.scored.select("id", "dwelling"), "dwelling", "score").select("id", r6("score"))


@query("rnk_5_compare_normalizations")
def _(v):
    from plotwise.plans.normalization import compare_normalizations

    return compare_normalizations(v.scored.select("id", *ALL), SCORES, "composite")


# -------------------------------------------------------------- top-k, sets


@query("top_1_top_by_index", "SELECT id, security FROM scored ORDER BY security DESC NULLS LAST, id LIMIT 25")
def _(v):
    return v.scored.select("id", "security").orderBy(c("security").desc_nulls_last(), "id").limit(25)


@query("top_2_top_opportunities", "SELECT id, round(price/composite, 2) AS ratio FROM scored WHERE composite >= 3 AND kind='2-HIGH' AND price <= 400000000 ORDER BY price/composite, id LIMIT 20")
def _(v):
    d = v.scored.where("composite >= 3 and kind = '2-HIGH' and price <= 400000000").withColumn("x", c("price") / c("composite"))
    return d.orderBy("x", "id").limit(20).select("id", F.round("x", 2).alias("ratio"))


@query("top_3_paged_points", "SELECT id, lon, lat, zoning FROM scored WHERE lon IS NOT NULL ORDER BY zoning DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def _(v):
    return v.scored.where("lon is not null").orderBy(c("zoning").desc_nulls_last(), "id").offset(100).limit(50).select("id", "lon", "lat", "zoning")


@query("top_4_repeatable_sample", "SELECT id, price FROM listing ORDER BY md5(concat('7:', id)), id LIMIT 60")
def _(v):
    return rel.repeatable_sample(v.listing.select("id", "price"), "id", 60)


@query("top_5_rank_changes", f"""z AS (SELECT zone_id, {_avgs} FROM scored WHERE zone_id IS NOT NULL GROUP BY 1), k AS (SELECT zone_id, rank() OVER (ORDER BY avg_composite DESC) AS a, rank() OVER (ORDER BY avg_access DESC) AS b FROM z)
  SELECT zone_id, a, b, a-b AS delta FROM k ORDER BY abs(a-b) DESC, zone_id LIMIT 5""")
def _(v):
    z = rel.zone_ranks(ag.group_averages(v.scored.where("zone_id is not null"), ["zone_id"], ALL, 1), ["avg_composite", "avg_access"])
    d = z.select("zone_id", c("rank_avg_composite").alias("a"), c("rank_avg_access").alias("b")).withColumn("delta", c("a") - c("b"))
    return d.orderBy(F.desc(F.abs("delta")), "zone_id").limit(5)


@query("top_6_weighted_best", """SELECT id, round(coalesce(access,0)*0.5e0+coalesce(security,0)*0.3e0+services*0.2e0, 6) AS weighted FROM scored WHERE zone_id=7 ORDER BY round(coalesce(access,0)*0.5e0+coalesce(security,0)*0.3e0+services*0.2e0, 6) DESC, id LIMIT 15""")
def _(v):
    d = v.scored
    return rel.weighted_best(d, {"access": 0.5, "security": 0.3, "services": 0.2}, c("zone_id") == 7, 15).select("id", r6("weighted"))


@query("top_7_activity_feed", """SELECT type, CAST(floor(epoch("at")) AS BIGINT) AS "at", detail FROM (SELECT 'event' AS type, ts AS "at", concat('{"event_id":', event_id, ',"event_type":"', event_type, '"}') AS detail FROM events
  UNION ALL SELECT 'listing', listed, concat('{"id":', id, ',"kind":"', kind, '"}') FROM listing UNION ALL SELECT 'scrape', ts, concat('{"key":"', key, '","price":', price, '}') FROM scrape
  UNION ALL SELECT 'turn', ts, concat('{"conv_id":', conv_id, ',"turn":', turn, '}') FROM turns) t ORDER BY t."at" DESC, type, detail LIMIT 50""")
def _(v):
    return rel.activity_feed({"event": (v.table("events"), "ts", ["event_id", "event_type"]), "listing": (v.listing, "listed", ["id", "kind"]),
                              "scrape": (v.scrape, "ts", ["key", "price"]), "turn": (v.turns, "ts", ["conv_id", "turn"])}).withColumn("at", F.unix_seconds("at"))


@query("top_8_sectors_by_security", "SELECT zone_id, click, error, round(5*(1-click::DOUBLE/(click+error+purchase+signup+view)), 6) AS score FROM crime WHERE click > 0 ORDER BY score DESC, zone_id")
def _(v):
    tot = sum((c(o) for o in OFFENCES[1:]), c(OFFENCES[0]))
    return v.crime.where("click > 0").select("zone_id", "click", "error", F.round(5 * (1 - c("click") / tot), 6).alias("score")).orderBy(F.desc("score"), "zone_id")


@query("uni_1_stacked_layers", """SELECT concat('p', poi_id) AS key, category AS layer, lon, lat FROM poi UNION ALL SELECT concat('s', station_id), layer, lon, lat FROM station""")
def _(v):
    p = v.poi.select(F.concat(F.lit("p"), c("poi_id").cast("string")).alias("key"), c("category").alias("layer"), "lon", "lat")
    return p.unionByName(v.station.select(F.concat(F.lit("s"), c("station_id").cast("string")).alias("key"), "layer", "lon", "lat"))


@query("set_2_key_intersection", """SELECT DISTINCT l_suppkey AS key FROM lineitem INTERSECT SELECT o_custkey FROM orders""")
def _(v):
    return v.table("lineitem").select(c("l_suppkey").alias("key")).intersect(v.table("orders").select(c("o_custkey").alias("key")))


@query("set_2_top_overlap", """SELECT count(*) AS overlap FROM (SELECT id FROM scored ORDER BY composite DESC NULLS LAST, id LIMIT 200) JOIN (SELECT id FROM scored ORDER BY dwelling DESC NULLS LAST, id LIMIT 200) USING (id)""")
def _(v):
    return rel.top_overlap(v.scored, "id", "composite", "dwelling", 200)


@query("set_3_difference_report", """SELECT c_custkey AS key, 'left' AS side FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
  SELECT o_custkey, 'right' FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def _(v):
    return rel.set_difference_report(v.table("customer").select(c("c_custkey").alias("key")), v.table("orders").select(c("o_custkey").alias("key")), "key")


@query("set_4_distinct_values", "SELECT DISTINCT name, has FROM amenity")
def _(v):
    return v.amenity.select("name", "has").distinct()
