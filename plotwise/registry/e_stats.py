"""Regression, validation battery, PCA, weighting, sensitivity, uncertainty."""

from pyspark.sql import functions as F

from plotwise.fixtures import OFFENCES, SCORES
from plotwise.operators import gram as gm
from plotwise.operators import indicators as ind
from plotwise.operators import pca
from plotwise.operators import regression as rg
from plotwise.operators import validation as va
from plotwise.operators import weights as wt
from plotwise.operators.ranking import exact_quantiles
from plotwise.registry.core import query
from plotwise.session import stage

c = F.col
R = lambda n, d=6: F.round(c(n), d).alias(n)
Y, INDEX, CONTROLS = "ln_price", "composite", ["area", "rooms", "baths", "stratum"]
ALLX = [INDEX, *SCORES, *CONTROLS]


def analysis(v):
    """Complete listing-level rows with the outcome; the index is left unrounded-free of its sub-scores."""
    d = v.scored.where("price > 0 and area > 0").withColumn("ln_price", F.ln(c("price").cast("double")))
    d = d.withColumn("price_m2", c("price") / c("area"))
    d = d.dropna(subset=ALLX + ["zone_id"])
    return d.select("id", "kind", "zone_id", "lon", "lat", "price", "price_m2", Y, "listed", "is_outlier", *ALLX)


A_SQL = "an AS (SELECT id, kind, zone_id, lon, lat, price, price/area AS price_m2, ln(price::DOUBLE) AS ln_price, listed, is_outlier, " + ", ".join(
    f"{x}::DOUBLE AS {x}" for x in ALLX) + " FROM scored WHERE price > 0 AND area > 0 AND zone_id IS NOT NULL AND " + " AND ".join(f"{x} IS NOT NULL" for x in ALLX) + ")"


def ols_sql(src, y, xs, out, by=None):
    """Residuals `res` of a regression by orthogonalizing one column after the other."""
    p = f"PARTITION BY {by}" if by else ""
    n = len(xs)
    o = f"({p})"
    keep = f"{src}.*"
    ctes = [f"{out}_0 AS (SELECT {keep}, {y} - avg({y}) OVER {o} AS q_y, {y} - avg({y}) OVER {o} AS q_t, " + ", ".join(f"{x} - avg({x}) OVER {o} AS q_{i}" for i, x in enumerate(xs)) + f" FROM {src})"]
    for k in range(n):
        cols = ", ".join(f"q_{j} - coalesce(sum(q_{j}*q_{k}) OVER {o} / nullif(sum(q_{k}*q_{k}) OVER {o}, 0), 0)*q_{k} AS q_{j}" for j in list(range(k + 1, n)) + ["y"])
        ctes.append(f"{out}_{k + 1} AS (SELECT * EXCLUDE ({', '.join(f'q_{j}' for j in list(range(k, n)) + ['y'])}), {cols} FROM {out}_{k})")
    ctes.append(f"{out} AS (SELECT *, q_y AS res, q_t AS cen FROM {out}_{n})")
    return ", ".join(ctes)


def r2(t):
    return f"(SELECT 1-sum(res*res)/sum(cen*cen) FROM {t})"


def aic(t, k):
    return f"(SELECT count(*)*(ln(2*pi())+ln(sum(res*res)/count(*))+1)+2*{k + 2} FROM {t})"


RED, FULL = [INDEX, *CONTROLS], [*SCORES, *CONTROLS]
_m = lambda n, x: f"SELECT '{n}' AS item, round({x}, 6) AS value"
_u = lambda *xs: " UNION ALL ".join(xs)


def pick(df, section, items):
    return df.where(c("section") == section).where(c("item").isin(items)).select("item", "value")


# --------------------------------------------------------------- regression


@query("reg_0_grouped_ols", f"{A_SQL}, {ols_sql('an', Y, FULL, 'o', 'kind')} SELECT kind, count(*)::DOUBLE AS n, round(1-sum(res*res)/sum(cen*cen), 6) AS r2, round(sum(res*res), 5) AS ssr, "
       f"round(count(*)*(ln(2*pi())+ln(sum(res*res)/count(*))+1)+2*{len(FULL) + 2}, 4) AS aic FROM o GROUP BY kind")
def _(v):
    t = rg.grouped_ols(analysis(v), Y, FULL, ["kind"]).where(c("item").isin("n", "r2", "ssr", "aic"))
    w = t.groupBy(c("section").alias("kind")).pivot("item", ["n", "r2", "ssr", "aic"]).agg(F.first("value"))
    return w.select("kind", "n", "r2", R("ssr", 5), R("aic", 4))


_TR = "tr AS (SELECT *, ln(price_m2) AS y FROM an WHERE floor(('0x'||substr(md5(concat(42, ':', id)),1,8))::BIGINT/4294967296.0e0*5) <> 0)"


# The hashed fifth is held out; the rest is fitted kind by kind.
@query("reg_1_train_fit", f"{A_SQL}, {_TR}, {ols_sql('tr', 'y', CONTROLS, 'o', 'kind')} SELECT kind, count(*)::DOUBLE AS n_train, any_value(m) - count(*)::DOUBLE AS n_test, round(1-sum(res*res)/sum(cen*cen), 6) AS r2_train, round(sqrt(sum(res*res)/count(*)), 6) AS rmse_train FROM o JOIN (SELECT kind, count(*) AS m FROM an GROUP BY 1) USING (kind) GROUP BY kind")
def _(v):
    t = rg.price_model(analysis(v).withColumn("y", F.ln("price_m2")), "y", CONTROLS, "kind", "id")
    names = ["n_train", "n_test", "r2_train", "rmse_train"]
    return t.groupBy(c("section").alias("kind")).pivot("item", names).agg(F.first("value"))


@query("reg_1_price_model")
def _(v):
    return rg.price_model(analysis(v).withColumn("y", F.ln("price_m2")), "y", CONTROLS, "kind", "id")


FEATURES = {"hedonic": ["area", "rooms", "baths", "stratum"], "full": ["area", "rooms", "baths", "stratum", *SCORES]}


def race_of(v):
    d = stage(analysis(v).withColumn("y", F.ln("price_m2")))
    return d, rg.model_race(d, "y", FEATURES, "kind", "id")


@query("reg_2_model_race")
def _(v):
    return rg.race_report(v.spark, race_of(v)[1])


def quantiles_of(v):
    d = stage(analysis(v).withColumn("y", F.ln("price_m2")))
    return d, stage(rg.quantile_fits(d, "y", CONTROLS, ["kind"]))


@query("reg_3_quantile_position")
def _(v):
    d, fits = quantiles_of(v)
    q = rg.quantile_position(d, fits, "y", CONTROLS, ["kind"])
    return q.groupBy("kind", "position").agg(F.count("*").alias("n"), F.round(F.avg("q_low"), 4).alias("q_low"), F.round(F.avg("q_high"), 4).alias("q_high"))


# An exact fit has no duality gap, and no more than a share tau of the rows below it or 1 - tau above it.
@query("reg_3_quantile_optimum", f"{A_SQL} SELECT kind, tau, count(*)::DOUBLE AS n, true AS no_gap, true AS share_below, true AS share_above FROM an, (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS tau) GROUP BY 1, 2")
def _(v):
    d, fits = quantiles_of(v)
    rows = stage(rg.predictions(d.withColumn("tau", F.explode(F.lit([0.25, 0.5, 0.75]))), fits, CONTROLS, ["kind", "tau"], "hat"))
    side = lambda x: F.count(F.when(x, 1)) / F.count("*")
    shares = rows.groupBy("kind", "tau").agg(side(c("y") < c("hat") - 1e-6).alias("below"), side(c("y") > c("hat") + 1e-6).alias("above"))
    return fits.join(shares, ["kind", "tau"]).select("kind", "tau", "n", (c("gap") <= 1e-8 * c("loss")).alias("no_gap"), (c("below") <= c("tau")).alias("share_below"), (c("above") <= 1 - c("tau")).alias("share_above"))


@query("reg_4_market_summary", f"{A_SQL}, yy AS (SELECT *, ln(price_m2) AS y FROM an), {ols_sql('yy', 'y', CONTROLS, 'o', 'kind')}, m AS (SELECT kind, price_m2/greatest(exp(y-res), 1.0) AS mr FROM o) "
       "SELECT kind, count(*) AS n, count(*) FILTER (mr > 1.10) AS n_over, count(*) FILTER (mr BETWEEN 0.90 AND 1.10) AS n_fair, count(*) FILTER (mr < 0.90) AS n_under, round(avg(mr), 6) AS mean_ratio, round(quantile_cont(mr, 0.5), 6) AS median_ratio FROM m GROUP BY kind")
def _(v):
    d = analysis(v).withColumn("y", F.ln("price_m2"))
    fits = gm.group_grams(d, ["y", *CONTROLS], ["kind"]).fits("y", CONTROLS)
    m = rg.market_ratio(rg.predictions(d, fits, CONTROLS, ["kind"], "ln_hat"), "price_m2", "ln_hat")
    return rg.market_summary(stage(m.select("kind", "valuation", "market_ratio")), "kind").withColumns({"mean_ratio": F.round("mean_ratio", 6), "median_ratio": F.round("median_ratio", 6)})


_PRED = "price_m2*(0.8e0 + (id%41)/100.0e0)"


@query("reg_5_appraisal_metrics", f"""{A_SQL}, p AS (SELECT kind, price_m2 AS a, {_PRED} AS p, {_PRED}/price_m2 AS r FROM an), m AS (SELECT kind, quantile_cont(r, 0.5) AS med FROM p GROUP BY 1)
  SELECT kind, count(*) AS n, round(any_value(med),6) AS median_ratio, round(avg(abs(r-med)/med)*100, 6) AS cod, round(avg(r)/(sum(p)/sum(a)), 6) AS prd, round(regr_slope((r-med)/med, ln(a)), 6) AS prb,
  avg(abs(r-med)/med)*100 BETWEEN 5 AND 15 AS cod_ok, avg(r)/(sum(p)/sum(a)) BETWEEN 0.98 AND 1.03 AS prd_ok, regr_slope((r-med)/med, ln(a)) BETWEEN -0.05 AND 0.05 AS prb_ok, any_value(med) BETWEEN 0.9 AND 1.1 AS level_ok
  FROM p JOIN m USING (kind) GROUP BY kind""")
def _(v):
    d = analysis(v).withColumn("pred", c("price_m2") * (0.8 + (c("id") % 41) / 100.0))
    return rg.appraisal_metrics(d, "price_m2", "pred", ["kind"]).withColumns({n: F.round(n, 6) for n in ("median_ratio", "cod", "prd", "prb")})


_V3 = ["area", "rooms", "dwelling"]


@query("reg_6_vif", f"""{A_SQL}, k AS (SELECT corr(area,rooms) AS a, corr(area,dwelling) AS b, corr(rooms,dwelling) AS d FROM an), t AS (SELECT *, 1+2*a*b*d-a*a-b*b-d*d AS det FROM k)
  SELECT 'area' AS item, round((1-d*d)/det, 5) AS value FROM t UNION ALL SELECT 'rooms', round((1-b*b)/det, 5) FROM t UNION ALL SELECT 'dwelling', round((1-a*a)/det, 5) FROM t""")
def _(v):
    return rg.vif(analysis(v), _V3).select("item", R("value", 5))


@query("reg_7_model_consensus")
def _(v):
    return gm.report(v.spark, rg.consensus(race_of(v)[1]))


@query("reg_8_population_shift", f"""{A_SQL}, o AS (SELECT area FROM an WHERE listed <= TIMESTAMP '1998-01-01'), w AS (SELECT area FROM an WHERE listed > TIMESTAMP '1998-01-01'),
  e AS (SELECT list_sort(list_distinct(list_value({', '.join(f'quantile_cont(area, {i / 10})' for i in range(11))}))) AS q FROM o),
  bo AS (SELECT len(list_filter(q[2:len(q)-1], lambda x: x <= area)) AS b, count(*)::DOUBLE/(SELECT count(*) FROM o) AS s FROM o, e WHERE area BETWEEN q[1] AND q[len(q)] GROUP BY 1),
  bw AS (SELECT len(list_filter(q[2:len(q)-1], lambda x: x <= area)) AS b, count(*)::DOUBLE/(SELECT count(*) FROM w) AS s FROM w, e WHERE area BETWEEN q[1] AND q[len(q)] GROUP BY 1),
  j AS (SELECT greatest(coalesce(bo.s,0), 1e-4) AS e, greatest(coalesce(bw.s,0), 1e-4) AS a FROM (SELECT unnest(range(len(q)-1)) AS b FROM e) f LEFT JOIN bo USING (b) LEFT JOIN bw USING (b)),
  n AS (SELECT e/sum(e) OVER () AS e, a/sum(a) OVER () AS a FROM j) SELECT 'area' AS feature, round(sum((a-e)*ln(a/e)), 6) AS psi FROM n""")
def _(v):
    d = analysis(v)
    cut = F.lit("1998-01-01").cast("timestamp")
    return rg.population_shift(d.where(c("listed") <= cut), d.where(c("listed") > cut), "area").withColumn("psi", F.round("psi", 6))


def psi_sql(col, n):
    """CTEs that give psi{n}: shift of a column between rows before and after the last run."""
    edges = ", ".join(f"quantile_cont({col}, {i / 10})" for i in range(11))
    inner = f"len(list_filter(q[2:len(q)-1], lambda x: x <= {col}))"
    share = lambda t, side: f"{side}{n} AS (SELECT {inner} AS b, count(*)::DOUBLE/(SELECT count(*) FROM {t}) AS s FROM {t}, e{n} WHERE {col} BETWEEN q[1] AND q[len(q)] GROUP BY 1)"
    return f"""e{n} AS (SELECT list_sort(list_distinct(list_value({edges}))) AS q FROM od), {share('od', 'bo')}, {share('nw', 'bw')},
  j{n} AS (SELECT greatest(coalesce(bo{n}.s,0), 1e-4) AS e, greatest(coalesce(bw{n}.s,0), 1e-4) AS a FROM (SELECT unnest(range(len(q)-1)) AS b FROM e{n}) f LEFT JOIN bo{n} USING (b) LEFT JOIN bw{n} USING (b)),
  psi{n} AS (SELECT sum((a-e)*ln(a/e)) AS psi FROM (SELECT e/sum(e) OVER () AS e, a/sum(a) OVER () AS a FROM j{n}))"""


@query("reg_9_retrain_decision", f"""{A_SQL}, cn AS (SELECT * FROM an WHERE NOT is_outlier), od AS (SELECT * FROM cn WHERE listed <= TIMESTAMP '1998-01-01'), nw AS (SELECT * FROM cn WHERE listed > TIMESTAMP '1998-01-01'), {psi_sql('stratum', 1)}, {psi_sql('area', 2)},
  gr AS (SELECT bool_or(a.n >= r.n*1.1e0) AS g FROM (SELECT kind, count(*) AS n FROM cn GROUP BY 1) a JOIN (SELECT kind, count(*) AS n FROM an WHERE listed <= TIMESTAMP '1998-01-01' GROUP BY 1) r USING (kind)),
  pr AS (SELECT 0.8e0 + (id%41)/100.0e0 AS r FROM nw), md AS (SELECT quantile_cont(r, 0.5) AS m FROM pr), ap AS (SELECT count(*) >= 10 AND (any_value(m) NOT BETWEEN 0.9 AND 1.1 OR avg(abs(r-m)/m)*100 > 20) AS off FROM pr, md)
  SELECT n AS new_clean, CASE WHEN n >= 27 THEN concat_ws(',', CASE WHEN g THEN 'growth' END, CASE WHEN psi1.psi >= 0.2 THEN 'drift_stratum' END, CASE WHEN psi2.psi >= 0.2 THEN 'drift_area' END, CASE WHEN n >= 30 AND off THEN 'appraisal_drift' END) ELSE '' END AS reasons, reasons <> '' AS retrain
  FROM (SELECT count(*) AS n FROM nw), gr, ap, psi1, psi2""")
def _(v):
    d = stage(analysis(v).withColumn("predicted", c("price_m2") * (0.8 + (c("id") % 41) / 100.0)))
    cut = F.lit("1998-01-01").cast("timestamp")
    runs = d.where(c("listed") <= cut).groupBy("kind").agg(F.count("*").alias("n_samples"))
    return rg.retrain_decision(d, runs, cut, "listed", ["stratum", "area"])


@query("reg_9_first_run", f"{A_SQL} SELECT count(*) AS new_clean, 'first_run' AS reasons, true AS retrain FROM an WHERE NOT is_outlier")
def _(v):
    return rg.retrain_decision(analysis(v), None, None, "listed", ["stratum", "area"])


@query("reg_10_one_se_choice")
def _(v):
    res = race_of(v)[1]
    return gm.report(v.spark, [(k, n, x) for k, r in res.items() for n, x in rg.one_se_choice(r["models"])])


@query("reg_11_spatial_cv")
def _(v):
    return rg.spatial_cv(analysis(v), Y, FULL, "zone_id", "id")


@query("reg_11_spatial_groups")
def _(v):
    g = rg.spatial_groups(v.listing.where("lon is not null"))
    return g.groupBy("geo_group").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 3).alias("lon"), F.round(F.avg("lat"), 3).alias("lat"))


@query("reg_12_refit_study")
def _(v):
    return rg.refit_study(analysis(v), Y, {"A": CONTROLS, "B": RED, "C": FULL}, "id")


# --------------------------------------------------------------- validation


@query("sta_1_nested_models", f"{A_SQL}, {ols_sql('an', Y, RED, 'r')}, {ols_sql('an', Y, FULL, 'f')} " + _u(
    _m("reduced_r2", r2("r")), _m("full_r2", r2("f")), _m("delta_r2", f"{r2('f')}-{r2('r')}"), f"SELECT 'delta_aic' AS item, round({aic('f', len(FULL))}-{aic('r', len(RED))}, 3) AS value"))
def _(v):
    d = analysis(v)
    t = va.to_report(d, va.nested_models(gm.gram(d, [Y, *ALLX]), Y, INDEX, SCORES, CONTROLS))
    return pick(t, "nested", ["reduced_r2", "full_r2", "delta_r2", "delta_aic"]).withColumn("value", F.when(c("item") == "delta_aic", F.round("value", 3)).otherwise(c("value")))


@query("sta_1_nested_tests")
def _(v):
    d = analysis(v)
    return va.to_report(d, va.nested_models(gm.gram(d, [Y, *ALLX]), Y, INDEX, SCORES, CONTROLS))


@query("sta_2_commonality", f"{A_SQL}, {ols_sql('an', Y, SCORES, 'f')}, " + ", ".join(ols_sql("an", Y, [x for x in SCORES if x != s], f"w_{s}") for s in SCORES) + " " + _u(
    _m("r2_total", r2("f")), *[_m(f"unique_{s}", f"greatest(0.0e0, {r2('f')}-{r2('w_' + s)})") for s in SCORES]))
def _(v):
    d = analysis(v)
    t = va.to_report(d, va.commonality(gm.gram(d, [Y, *SCORES]), Y, SCORES))
    return pick(t, "commonality", ["r2_total", *[f"unique_{s}" for s in SCORES]])


@query("sta_3_cv_comparison")
def _(v):
    d = analysis(v)
    return va.to_report(d, va.cv_comparison(d, Y, INDEX, SCORES, CONTROLS, "zone_id", "id"))


@query("boot_0_replicate_weights", "u AS (SELECT rep, id, ('0x'||substr(md5(concat(rep, ':', id)),1,8))::BIGINT/4294967296.0e0 AS u FROM listing, range(5) r(rep)), w AS (SELECT rep, id, "
       + "+".join(f"(u >= {x!r}e0)::INT" for x in __import__("itertools").accumulate(__import__("math").exp(-1) / __import__("math").factorial(k) for k in range(12)))
       + " AS w FROM u) SELECT rep, count(*) AS rows_kept, sum(w)::BIGINT AS weight, max(w) AS top FROM w WHERE w > 0 GROUP BY rep")
def _(v):
    d = va.replicate_weights(v.listing.select("id"), "id", 5)
    return d.groupBy("rep").agg(F.count("*").alias("rows_kept"), F.sum("weight").alias("weight"), F.max("weight").alias("top"))


@query("sta_4_bootstrap")
def _(v):
    d = analysis(v)
    return va.to_report(d, va.bootstrap_fits(va.block_grams(d, [Y, *ALLX], "id"), Y, INDEX, SCORES, CONTROLS))


def _reset_sql(xs, name):
    k = len(xs)
    return (f"{ols_sql('an', Y, xs, name)}, {name}p AS (SELECT * EXCLUDE (res, cen), ln_price-res AS yh, res AS r0 FROM {name}), {name}z AS (SELECT *, (yh-avg(yh) OVER ())/stddev_pop(yh) OVER () AS u FROM {name}p), "
            f"{name}v AS (SELECT id, ln_price, {', '.join(xs)}, r0, u*u AS u2, u*u*u AS u3 FROM {name}z), {ols_sql(name + 'v', Y, [*xs, 'u2', 'u3'], name + 'r')}, "
            f"{name}f AS (SELECT ((sum(r0*r0)-sum(res*res))/2)/(sum(res*res)/(count(*)-{k + 3})) AS f FROM {name}r)")


@query("sta_5_reset", f"{A_SQL}, {_reset_sql(RED, 'a')}, {_reset_sql(FULL, 'b')} SELECT 'reduced_f' AS item, round(f, 4) AS value FROM af UNION ALL SELECT 'full_f', round(f, 4) FROM bf")
def _(v):
    d = stage(analysis(v))
    t = va.to_report(d, va.reset_test(d, gm.gram(d, [Y, *ALLX]), Y, INDEX, SCORES, CONTROLS))
    return pick(t, "reset", ["reduced_f", "full_f"]).withColumn("value", F.round("value", 4))


@query("sta_6_subgroups", f"{A_SQL}, {ols_sql('an', Y, RED, 'r', 'zone_id')}, {ols_sql('an', Y, FULL, 'f', 'zone_id')} SELECT a.zone_id, n, r2_reduced, r2_full FROM (SELECT zone_id, count(*)::DOUBLE AS n, round(1-sum(res*res)/sum(cen*cen),6) AS r2_reduced FROM r GROUP BY 1) a "
       "JOIN (SELECT zone_id, round(1-sum(res*res)/sum(cen*cen),6) AS r2_full FROM f GROUP BY 1) b USING (zone_id) WHERE n >= 50")
def _(v):
    d = analysis(v)
    t = va.subgroup_fits(d, "zone_id", Y, INDEX, SCORES, CONTROLS).where("section like 'subgroup_%' and section <> 'subgroup'")
    w = t.groupBy("section").pivot("item", ["n", "r2_reduced", "r2_full"]).agg(F.first("value"))
    return w.select(F.regexp_extract("section", r"subgroup_(\d+)", 1).cast("long").alias("zone_id"), "n", "r2_reduced", "r2_full")


_X7 = "x7 AS (SELECT *, ln(greatest(area, 1.0)) AS log_area, security*security AS security_sq, dwelling*dwelling AS dwelling_sq, security*stratum AS security_stratum, dwelling*area AS dwelling_area, access*services AS access_services FROM an)"
_S7 = {"M1_base": [], "M2_log_area": ["log_area"], "M3_squares": ["security_sq", "dwelling_sq"], "M4_interactions": ["security_stratum", "dwelling_area", "access_services"],
       "M5_all": ["log_area", "security_sq", "dwelling_sq", "security_stratum", "dwelling_area", "access_services"]}


@query("sta_7_specifications", f"{A_SQL}, {_X7}, " + ", ".join(ols_sql("x7", Y, FULL + xs, n.lower()) for n, xs in _S7.items()) + " " + _u(
    *[f"SELECT '{n}' AS model, round({r2(n.lower())}, 6) AS r2, round({aic(n.lower(), len(FULL) + len(xs))}, 3) AS aic" for n, xs in _S7.items()]))
def _(v):
    d = stage(analysis(v))
    t = va.to_report(d, va.specifications(d, Y, SCORES, CONTROLS)).where("section like 'M%' and item in ('r2', 'aic')")
    w = t.groupBy(c("section").alias("model")).pivot("item", ["r2", "aic"]).agg(F.first("value"))
    return w.select("model", "r2", R("aic", 3))


_MIS = f"{A_SQL}, {ols_sql('an', Y, CONTROLS, 'o')}, q AS (SELECT quantile_cont(composite, 0.25) AS a, quantile_cont(composite, 0.5) AS b, quantile_cont(composite, 0.75) AS c FROM o), k AS (SELECT o.*, CASE WHEN composite <= a THEN 1 WHEN composite <= b THEN 2 WHEN composite <= c THEN 3 ELSE 4 END AS qt FROM o, q)"
_RK = lambda x, src, where="true": f"(SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x})-1)/2.0e0 AS rk FROM {src} WHERE {where})"


@query("sta_8_mispricing", f"""{_MIS}, i1 AS (SELECT id, rank() OVER (ORDER BY composite) + (count(*) OVER (PARTITION BY composite)-1)/2.0e0 AS ra, rank() OVER (ORDER BY res) AS rb FROM k),
  u AS {_RK('res', 'k', 'qt IN (1,4)')} SELECT 'rho' AS item, round((SELECT corr(ra, rb) FROM i1), 3) AS value UNION ALL SELECT 'q' || qt || '_n', count(*) FROM k GROUP BY qt UNION ALL SELECT 'q' || qt || '_index', round(avg(composite), 6) FROM k GROUP BY qt
  UNION ALL SELECT 'median_gap', round((SELECT quantile_cont(res, 0.5) FROM k WHERE qt=4) - (SELECT quantile_cont(res, 0.5) FROM k WHERE qt=1), 6)""")
def _(v):
    d = stage(analysis(v))
    t = va.to_report(d, va.mispricing(d, gm.gram(d, [Y, *CONTROLS]), Y, INDEX, CONTROLS))
    return pick(t, "mispricing", ["rho", "median_gap", *[f"q{i}_{x}" for i in range(1, 5) for x in ("n", "index")]]).withColumn("value", F.when(c("item") == "rho", F.round("value", 3)).otherwise(c("value")))


@query("sta_9_spearman", f"{A_SQL}, k AS (SELECT rank() OVER (ORDER BY composite) + (count(*) OVER (PARTITION BY composite)-1)/2.0e0 AS a, rank() OVER (ORDER BY price_m2) + (count(*) OVER (PARTITION BY price_m2)-1)/2.0e0 AS b FROM an) SELECT round(corr(a,b),6) AS rho, count(*) AS n FROM k")
def _(v):
    rho, _, n = va.spearman(analysis(v), INDEX, "price_m2")
    return v.spark.createDataFrame([(round(rho, 6), n)], "rho double, n long")


@query("sta_10_convergent", f"""{A_SQL}, g AS (SELECT stratum, count(*) AS n, avg(composite) AS m, var_pop(composite) AS s FROM an GROUP BY 1), t AS (SELECT sum(n) AS nn, count(*) AS kk, sum(n*m)/sum(n) AS mm, sum(n*s) AS sw FROM g),
  b AS (SELECT sum(n*(m-mm)*(m-mm)) AS sb FROM g, t), k AS (SELECT stratum, rank() OVER (ORDER BY composite) + (count(*) OVER (PARTITION BY composite)-1)/2.0e0 AS a, rank() OVER (ORDER BY stratum) + (count(*) OVER (PARTITION BY stratum)-1)/2.0e0 AS s FROM an)
  SELECT 'rho_stratum' AS item, round((SELECT corr(a, s) FROM k), 6) AS value UNION ALL SELECT 'anova_f', round((SELECT (sb/(kk-1))/(sw/(nn-kk)) FROM t, b), 6) UNION ALL SELECT 'eta_sq', round((SELECT sb/(sb+sw) FROM t, b), 6)
  UNION ALL SELECT 'auc', round((SELECT (sum(a) FILTER (stratum>=4) - count(*) FILTER (stratum>=4)*(count(*) FILTER (stratum>=4)+1)/2.0e0)/(count(*) FILTER (stratum>=4)*count(*) FILTER (stratum<4))::DOUBLE FROM k), 6)""")
def _(v):
    d = analysis(v)
    return pick(va.to_report(d, va.convergent(stage(d), INDEX, "stratum", "price_m2")), "convergent", ["rho_stratum", "anova_f", "eta_sq", "auc"])


@query("sta_10_stratum_means", f"{A_SQL} SELECT 'mean_' || CAST(stratum AS VARCHAR) AS item, round(avg(composite), 6) AS value FROM an GROUP BY stratum HAVING count(*) >= 5")
def _(v):
    return va.stratum_means(analysis(v).withColumn("stratum", c("stratum").cast("double")), INDEX, "stratum").select("item", "value")


@query("sta_11_decision_matrix", f"""{A_SQL}, {ols_sql('an', Y, CONTROLS, 'o')}, z AS (SELECT *, CASE WHEN composite > (SELECT quantile_cont(composite, 0.5) FROM o) THEN CASE WHEN res < 0 THEN 'buy' ELSE 'hold' END ELSE CASE WHEN res < 0 THEN 'avoid' ELSE 'sell' END END AS q FROM o),
  cu AS (SELECT price_m2, sum((q='buy')::INT) OVER w AS a, sum((q='hold')::INT) OVER w AS b FROM z WHERE q IN ('buy','hold') WINDOW w AS (ORDER BY price_m2 RANGE UNBOUNDED PRECEDING))
  SELECT q || '_n' AS item, count(*)::DOUBLE AS value FROM z GROUP BY q UNION ALL SELECT q || '_index', round(avg(composite), 6) FROM z GROUP BY q UNION ALL SELECT 'ks', round((SELECT max(abs(a/(SELECT count(*) FROM z WHERE q='buy')::DOUBLE - b/(SELECT count(*) FROM z WHERE q='hold')::DOUBLE)) FROM cu), 6)""")
def _(v):
    d = stage(analysis(v))
    t = va.to_report(d, va.decision_matrix(d, gm.gram(d, [Y, *CONTROLS]), Y, INDEX, CONTROLS, "price_m2"))
    return pick(t, "decision", ["ks", *[f"{q}_{x}" for q in ("buy", "hold", "avoid", "sell") for x in ("n", "index")]])


def zone_scores(v):
    z = v.scored.where("zone_id is not null").groupBy("zone_id").agg(*[F.round(F.avg(s), 6).alias(s) for s in SCORES], F.round(F.avg(INDEX), 6).alias(INDEX))
    return z


@query("sta_12_summary")
def _(v):
    d = analysis(v)
    g = gm.gram(d, [Y, *ALLX])
    s = wt.stability_summary(wt.rank_stability(stage(zone_scores(v)), "zone_id", SCORES)).first()
    rows = va.summary_table(va.nested_models(g, Y, INDEX, SCORES, CONTROLS), va.commonality(g, Y, SCORES), {"spearman": s["rho_median"], "moved_pct": s["moved_median"]})
    return va.to_report(d, rows)


def residuals(v):
    d = stage(analysis(v))
    f = gm.gram(d, [Y, *FULL]).fit(Y, FULL)
    return stage(d.withColumn("res", c(Y) - f.predict()))


@query("sta_13_moran")
def _(v):
    d = residuals(v)
    return va.to_report(d, va.moran(d, "res"))


@query("sta_14_breusch_pagan", f"{A_SQL}, {ols_sql('an', Y, FULL, 'o')}, e AS (SELECT * EXCLUDE (res, cen), res*res AS r2v FROM o), e2 AS (SELECT id, r2v, {', '.join(FULL)} FROM e), {ols_sql('e2', 'r2v', FULL, 'b')} SELECT 'lm' AS item, round((SELECT count(*)*(1-sum(res*res)/sum(cen*cen)) FROM b), 4) AS value")
def _(v):
    d = residuals(v)
    return pick(va.to_report(d, va.breusch_pagan(d, "res", FULL)), "breusch_pagan", ["lm"]).withColumn("value", F.round("value", 4))


@query("sta_14_diagnostics")
def _(v):
    d = residuals(v)
    vifs = {r["item"]: r["value"] for r in rg.vif(d, FULL).collect()}
    mo, bp, no = va.moran(d, "res"), va.breusch_pagan(d, "res", FULL), va.normality(d, "res")
    val = {(a, b): x for a, b, x in mo + bp + no}
    rows = [("vif", k, x) for k, x in vifs.items()] + mo + bp + no
    return va.to_report(d, rows + va.recommendations(vifs, val[("moran", "p")], val[("normality", "jarque_bera_p")], val[("breusch_pagan", "p")]))


@query("sta_15_normality", f"""{A_SQL}, p AS (SELECT price_m2 AS x FROM an), m AS (SELECT count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, avg(x) AS mu, sqrt(var_pop(x)) AS sp FROM p),
  k AS (SELECT avg(pow((x-mu)/sp,3)) AS g1, avg(pow((x-mu)/sp,4))-3 AS g2, count(*) AS n FROM p, m)
  SELECT 'n' AS item, n::DOUBLE AS value FROM k UNION ALL SELECT 'skewness', round(g1, 6) FROM k UNION ALL SELECT 'kurtosis', round(g2, 6) FROM k UNION ALL SELECT 'jarque_bera', round(n/6.0e0*(g1*g1+g2*g2/4), 2) FROM k""")
def _(v):
    d = analysis(v)
    t = va.to_report(d, va.normality(stage(d), "price_m2"))
    return pick(t, "normality", ["n", "skewness", "kurtosis", "jarque_bera"]).withColumn("value", F.when(c("item") == "jarque_bera", F.round("value", 2)).otherwise(c("value")))


@query("sta_15_normality_battery")
def _(v):
    d = residuals(v)
    return va.to_report(d, va.normality(d, "res"))


@query("sta_16_zone_dataset", "SELECT zone_id, count(*) AS n, " + ", ".join(f"round(avg({s}),6) AS {s}" for s in [*SCORES, INDEX]) + " FROM scored WHERE zone_id IS NOT NULL AND price BETWEEN 30000000 AND 500000000 GROUP BY 1 HAVING count(*) >= 10")
def _(v):
    from plotwise.operators.cleaning import plausible

    d = plausible(v.scored.where("zone_id is not null"), {"price": (30_000_000, 500_000_000)})
    return d.groupBy("zone_id").agg(F.count("*").alias("n"), *[F.round(F.avg(s), 6).alias(s) for s in [*SCORES, INDEX]]).where("n >= 10")


@query("sta_17_scree_and_qq", f"{A_SQL} " + _u(*[f"SELECT {p}e0 AS prob, round(quantile_cont(price_m2, {p}), 4) AS sample FROM an" for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
def _(v):
    return va.qq_points(analysis(v), "price_m2", [0.05, 0.25, 0.5, 0.75, 0.95]).select("prob", R("sample", 4))


# Eigenvalues add up to the variances, their squares to all squared covariances.
@query("sta_17_scree_moments", f"{A_SQL} SELECT 'sum' AS item, round({'+'.join(f'var_samp({s})' for s in SCORES)}, 5) AS value FROM an UNION ALL SELECT 'squares', round({'+'.join(f'pow(covar_samp({s},{t}),2)' for s in SCORES for t in SCORES)}, 5) FROM an")
def _(v):
    g = gm.gram(analysis(v), SCORES)
    import numpy as np

    ev = np.linalg.eigvalsh(g.cov(SCORES))
    return v.spark.createDataFrame([("sum", round(float(ev.sum()), 5)), ("squares", round(float((ev**2).sum()), 5))], "item string, value double")


@query("sta_17_scree")
def _(v):
    d = analysis(v)
    g = gm.gram(d, SCORES)
    import numpy as np

    ev = np.sort(np.linalg.eigvalsh(g.cov(SCORES)))[::-1]
    return gm.report(v.spark, [r for i, e in enumerate(ev, 1) for r in (("scree", f"eigenvalue_{i}", e), ("scree", f"share_{i}", e / ev.sum()))])


# ---------------------------------------------------------------------- pca


@query("pca_1_two_variables", f"SELECT kind, round((1+abs(corr(area,rooms)))/2, 6) AS explained, count(*)::DOUBLE AS n FROM listing WHERE area IS NOT NULL GROUP BY kind")
def _(v):
    m = pca.grouped_pca(v.listing, ["area", "rooms"], ["kind"])
    return pca.loadings_table(v.spark, m, ["area", "rooms"], ["kind"]).select("kind", R("explained"), "n")


# The first component's variance is the largest root of the 3 by 3 correlation matrix, in closed form.
_I3 = "i3 AS (SELECT kind, coalesce(area, median(area) OVER w) AS area, rooms::DOUBLE AS rooms, coalesce(baths::DOUBLE, median(baths) OVER w) AS baths, area AS a0 FROM listing WINDOW w AS (PARTITION BY kind))"


@query("pca_1_dimension_scores", f"""{_I3}, k3 AS (SELECT kind, count(*) FILTER (area > 0) AS n, corr(area, rooms) AS a, corr(area, baths) AS b, corr(rooms, baths) AS d FROM i3 GROUP BY 1), p3 AS (SELECT *, sqrt((a*a+b*b+d*d)/3) AS p FROM k3)
  SELECT kind, n, 0.0e0 AS mean, round(sqrt(1+2*p*cos(acos(greatest(-1, least(1, a*b*d/pow(p,3))))/3)), 6) AS sd FROM p3""")
def _(v):
    d = stage(pca.impute_columns(v.listing, ["area", "rooms", "baths"], ["kind"]))
    t = pca.loadings_table(v.spark, pca.grouped_pca(d, ["area", "rooms", "baths"], ["kind"]), ["area", "rooms", "baths"], ["kind"])
    s = ind.dimension_pc1(d, t, ["area", "rooms", "baths"])
    return s.groupBy("kind").agg(F.count("pc1").alias("n"), F.round(F.avg("pc1"), 6).alias("mean"), F.round(F.stddev_pop("pc1"), 6).alias("sd"))


@query("pca_2_adequacy", f"""{A_SQL}, k AS (SELECT corr(area,rooms) AS a, corr(area,dwelling) AS b, corr(rooms,dwelling) AS d, count(*) AS n FROM an), t AS (SELECT *, 1+2*a*b*d-a*a-b*b-d*d AS det FROM k),
  q AS (SELECT *, pow(a-b*d,2)/((1-b*b)*(1-d*d)) AS pa, pow(b-a*d,2)/((1-a*a)*(1-d*d)) AS pb, pow(d-a*b,2)/((1-a*a)*(1-b*b)) AS pd FROM t)
  SELECT 'kmo' AS item, round((a*a+b*b+d*d)/(a*a+b*b+d*d+pa+pb+pd), 6) AS value FROM q UNION ALL SELECT 'bartlett', round(-((n-1)-11.0e0/6)*ln(det), 4) FROM q""")
def _(v):
    a = pca.adequacy(gm.gram(analysis(v), _V3), _V3)
    return v.spark.createDataFrame([("kmo", round(a["kmo"], 6)), ("bartlett", round(a["chi2"], 4))], "item string, value double")


@query("pca_3_fallback_ladder")
def _(v):
    m = pca.fallback_weights(analysis(v), SCORES, ["kind"])
    return gm.report(v.spark, [r for (k,), x in m.items() for r in ((k, "method", x["method"]), (k, "kmo", x["kmo"]), (k, "bartlett_p", x["bartlett_p"]), (k, "share", x["share"]),
                                                                   *[(k, f"weight_{n}", w) for n, w in x["weights"].items()])])


@query("pca_4_transit_weights")
def _(v):
    g = stage(ind.gravity_scores(v.listing.where("lon is not null").select("id", "kind", "lon", "lat"), v.station, "layer", {k: 4 * r for k, r in ind.TRANSIT_RADII.items() if k != "metro"}))
    return pca.weights_with_range(g, ["g_transmilenio", "g_sitp", "g_vias"], "kind")


@query("pca_5_bootstrap_loadings")
def _(v):
    return gm.report(v.spark, pca.bootstrap_loadings(analysis(v), _V3, "id"))


def security_zones(v):
    crime = v.crime.select(c("zone_id").alias("locality"), *[(c(o) / c("area_km2")).alias(f"{o}_km2") for o in OFFENCES])
    s = v.survey.groupBy("locality").agg(F.avg((c("p102") == 2).cast("int")).alias("pct_unsafe"), F.avg((c("p203") == 1).cast("int")).alias("pct_victim"),
                                         (5 - F.avg(F.when(c("score").between(1, 5), c("score")))).alias("score_inv"), F.avg((c("age") == 3).cast("int")).alias("pct_worse"))
    return crime.join(s, "locality"), [f"{o}_km2" for o in OFFENCES], ["pct_unsafe", "pct_victim", "score_inv", "pct_worse"]


def composite_zones(v):
    z, o, s = security_zones(v)
    return pca.security_composite(stage(z), o, s)


@query("pca_6_security_composite")
def _(v):
    z, _ = composite_zones(v)
    return z.select("locality", *[R(n) for n in ("raw_objective", "raw_subjective", "score")], "rank")


@query("pca_6_composite_statistics")
def _(v):
    return gm.report(v.spark, composite_zones(v)[1])


@query("pca_7_rank_distribution")
def _(v):
    z = stage(composite_zones(v)[0])
    return wt.rank_distribution(z, "locality", ["z_objective", "z_subjective"], [0.5, 0.5]).withColumn("rank_mean", F.round("rank_mean", 4))


@query("pca_8_cluster_profiles")
def _(v):
    z = stage(composite_zones(v)[0])
    return pca.cluster_profiles(z).select("locality", "profile", "cluster_size")


@query("pca_9_rank_comparison", """z AS (SELECT zone_id, round(avg(composite),6) AS a, round(avg(access),6) AS b FROM scored WHERE zone_id IS NOT NULL GROUP BY 1), k AS (SELECT zone_id, rank() OVER (ORDER BY a DESC) AS ra, rank() OVER (ORDER BY b DESC) AS rb FROM z)
  SELECT zone_id, ra AS a_rank, rb AS b_rank, rb-ra AS change, round(1-6*sum((ra-rb)*(ra-rb)) OVER ()/(count(*) OVER ()*(count(*) OVER ()*count(*) OVER ()-1))::DOUBLE, 6) AS rho FROM k""")
def _(v):
    return pca.rank_comparison(stage(zone_scores(v)), INDEX, "access").select("zone_id", "a_rank", "b_rank", "change", R("rho"))


@query("ind_22_first_component")
def _(v):
    d = stage(v.scored.dropna(subset=SCORES))
    return pca.first_component_index(d, SCORES).select("id", R("composite"))


# ------------------------------------------------------------------ weights


def answers(v):
    """Six upper-triangle judgements (1/9 to 9) per user."""
    u = v.table("events").select("user_id").distinct()
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(i + 1, 4)])
    d = u.select("user_id", F.explode(cells).alias("e")).select("user_id", "e.i", "e.j")
    s = (c("user_id") * (c("i") + 2) + c("j") * 7) % 17 - 8
    return d.withColumn("value", F.when(s >= 0, (s + 1).cast("double")).otherwise(1.0 / (1 - s)))


@query("wgt_1_pairwise_weights")
def _(v):
    t = wt.pairwise_weights(answers(v), "user_id", ["health", "education", "commerce", "culture"])
    return t.select("user_id", *[R(f"w_{x}") for x in ("health", "education", "commerce", "culture")], R("lambda_max"), R("ci"), R("cr"), "consistent")


@query("wgt_2_matrix_from_ranks", """r AS (SELECT user_id, k AS item, (user_id*(k+3))%5+1 AS place FROM (SELECT DISTINCT user_id FROM events), range(4) t(k))
  SELECT a.user_id, a.item AS i, b.item AS j, CASE WHEN a.item=b.item THEN 1.0e0 WHEN b.place>=a.place THEN least(9.0e0, 1+2*(b.place-a.place)) ELSE round(1/least(9.0e0, 1+2*(a.place-b.place)), 9) END AS value FROM r a JOIN r b USING (user_id)""")
def _(v):
    u = v.table("events").select("user_id").distinct().withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    r = u.withColumn("place", (c("user_id") * (c("item") + 3)) % 5 + 1)
    return wt.matrix_from_ranks(r, "user_id", "item", "place").select("user_id", "i", "j", R("value", 9))


@query("wgt_2_invalid_cells", "SELECT user_id, 0 AS i, 1 AS j, 'reciprocity' AS fault FROM (SELECT DISTINCT user_id FROM events) WHERE user_id%7=3 AND (user_id*2)%5 <> user_id*3%5 UNION ALL SELECT user_id, 2, 2, 'diagonal' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id%5=1")
def _(v):
    u = v.table("events").select("user_id").distinct()
    a = (c("user_id") * 2 % 5 + 1).cast("double")
    b = F.when(c("user_id") % 7 == 3, 1.0 / (c("user_id") * 3 % 5 + 1)).otherwise(1.0 / a)
    cell = lambda i, j, x: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x.alias("value"))
    d = F.when(c("user_id") % 5 == 1, 2.0).otherwise(1.0)
    m = u.select("user_id", F.explode(F.array(cell(0, 0, F.lit(1.0)), cell(0, 1, a), cell(1, 0, b), cell(1, 1, F.lit(1.0)), cell(2, 2, d))).alias("e")).select("user_id", "e.*")
    return wt.invalid_cells(m, "user_id").select("user_id", "i", "j", "fault")


_HC = {"homicidios": "click", "delitos_sexuales": "error", "hurto_personas": "purchase", "otros": "signup"}
_AL = [0.0, 0.25, 0.5, 0.75, 1.0]
_mass = lambda w: "+".join(f"{col}*{w[n]!r}e0" for n, col in _HC.items())


@query("wgt_3_hybrid_ranking", "h AS (" + _u(*[f"SELECT zone_id, {a}e0 AS alpha, {_mass(wt.EXPERT_WEIGHTS)} AS b, {_mass(wt.hybrid_weights(wt.EXPERT_WEIGHTS, wt.DATA_WEIGHTS, a))} AS m FROM crime" for a in _AL])
       + """), k AS (SELECT *, rank() OVER (PARTITION BY alpha ORDER BY round(b,9) DESC) AS rb, rank() OVER (PARTITION BY alpha ORDER BY round(m,9) DESC) AS rm FROM h) SELECT zone_id, alpha, round(m,6) AS mass, rb AS base_rank, rm AS rank FROM k""")
def _(v):
    return wt.hybrid_ranking(stage(v.crime), "zone_id", _HC, wt.EXPERT_WEIGHTS, _AL).select("zone_id", "alpha", R("mass"), "base_rank", "rank")


@query("wgt_4_correlation_weights", f"{A_SQL}, k AS (SELECT " + ", ".join(f"abs(corr({s}, {Y})) AS {s}" for s in SCORES) + " FROM an) SELECT " + ", ".join(f"round({s}/({'+'.join(SCORES)}), 6) AS {s}" for s in SCORES) + " FROM k")
def _(v):
    w = wt.empirical_weights(gm.gram(analysis(v), [Y, *SCORES]), Y, SCORES)["correlation"]
    return v.spark.createDataFrame([tuple(round(w[s], 6) for s in SCORES)], ", ".join(f"{s} double" for s in SCORES))


@query("wgt_4_empirical_weights")
def _(v):
    d = stage(analysis(v))
    w = wt.empirical_weights(gm.gram(d, [Y, *SCORES]), Y, SCORES)
    w["benefit_of_doubt"] = wt.doubt_weights(d, SCORES, "id").first().asDict()
    means = d.agg(*[F.avg(s).alias(s) for s in SCORES]).first()
    return gm.report(v.spark, [r for m, x in w.items() for r in ([(m, s, x[s]) for s in SCORES] + [(m, "mean_index", sum(x[s] * means[s] for s in SCORES))])])


_UNIT = lambda *p: f"('0x'||substr(md5(concat_ws(':', {', '.join(p)})),1,8))::BIGINT/4294967296.0e0"
_PW = [f"0.2e0*(0.8e0+0.4e0*{_UNIT('sim', str(k))})" for k in range(5)]


@query("mc_1_rank_stability", "z AS (SELECT zone_id, " + ", ".join(f"round(avg({s}),6) AS {s}" for s in SCORES) + " FROM scored WHERE zone_id IS NOT NULL GROUP BY 1), w AS (SELECT sim, " + ", ".join(f"{e} AS w{k}" for k, e in enumerate(_PW))
       + " FROM range(200) t(sim)), s AS (SELECT sim, zone_id, round(" + "+".join(f"{s}*0.2e0" for s in SCORES) + ", 9) AS b, round((" + "+".join(f"{s}*w{k}" for k, s in enumerate(SCORES)) + ")/(w0+w1+w2+w3+w4), 9) AS p FROM z, w), "
       + "k AS (SELECT sim, row_number() OVER (PARTITION BY sim ORDER BY b DESC, zone_id) AS rb, row_number() OVER (PARTITION BY sim ORDER BY p DESC, zone_id) AS rp FROM s) SELECT sim, round(corr(rb, rp), 6) AS rho, round(avg((abs(rb-rp) > 5)::INT), 6) AS moved_share FROM k GROUP BY sim")
def _(v):
    return wt.rank_stability(stage(zone_scores(v)), "zone_id", SCORES, sims=200).select("sim", R("rho"), R("moved_share"))


@query("mc_1_stability_summary")
def _(v):
    return wt.stability_summary(wt.rank_stability(stage(zone_scores(v)), "zone_id", SCORES))


_sw = lambda col: [f"greatest(0.05e0, {x})" for x in col]
_sy = lambda cols: "(" + "+".join(f"{w}*m.{s}" for w, s in zip(_sw(cols), SCORES)) + ")/(" + "+".join(_sw(cols)) + ")"


@query("sob_1_sobol", "m AS (SELECT " + ", ".join(f"avg({s}) AS {s}" for s in SCORES) + " FROM scored WHERE " + " AND ".join(f"{s} IS NOT NULL" for s in SCORES) + "), u AS (SELECT id, " + ", ".join(f"{_UNIT(chr(39) + x + chr(39), 'id', str(k))} AS {x}{k}" for x in "AB" for k in range(5))
       + " FROM range(1024) t(id)), y AS (SELECT " + _sy([f"A{k}" for k in range(5)]) + " AS ya, " + _sy([f"B{k}" for k in range(5)]) + " AS yb, " + ", ".join(_sy([f"{'B' if k == i else 'A'}{k}" for k in range(5)]) + f" AS y{i}" for i in range(5))
       + " FROM u, m), r AS (SELECT (avg(ya*ya)+avg(yb*yb))/2 - pow((avg(ya)+avg(yb))/2, 2) AS v, " + ", ".join(f"avg(yb*(y{i}-ya)) AS s{i}, 0.5e0*avg(pow(ya-y{i},2)) AS t{i}" for i in range(5)) + " FROM y) "
       + _u(*[f"SELECT '{s}' AS score, round(s{i}/v, 5) AS first_order, round(t{i}/v, 5) AS total FROM r" for i, s in enumerate(SCORES)]))
def _(v):
    return wt.sobol(v.scored, SCORES).select("score", R("first_order", 5), R("total", 5))


_ER = wt.ERROR_SHARES
_EP = [(a, b) for i, a in enumerate(_ER) for b in list(_ER)[i + 1:]]


@query("unc_1_index_bands", "k AS (SELECT kind, " + "+".join(f"covar_samp({a},{b})" for a, b in _EP) + " AS cs FROM scored WHERE " + " AND ".join(f"{s} IS NOT NULL" for s in _ER) + " GROUP BY 1), s AS (SELECT id, composite, sqrt(greatest(0.0e0, "
       + "+".join(f"pow(coalesce({s},0)*{e * 0.2!r}e0,2)" for s, e in _ER.items()) + " + 2*0.2e0*0.2e0*cs)) AS sigma FROM scored JOIN k USING (kind)) SELECT id, round(sigma,6) AS sigma, round(composite-1.96e0*sigma,6) AS low95, round(composite+1.96e0*sigma,6) AS high95, round(composite-1.645e0*sigma,6) AS low90 FROM s")
def _(v):
    return wt.index_bands(v.scored).select("id", R("sigma"), R("low95"), R("high95"), R("low90"))


@query("unc_2_gravity_bands")
def _(v):
    g = ind.gravity_scores(v.listing.select("id", "lon", "lat"), v.station, "layer", {"sitp": 500})
    return wt.gravity_bands(g, "g_sitp", "n_sitp", 500.0).select("id", R("sigma"), R("low"), R("high"))


@query("unc_3_zone_bands", """SELECT zone_id, count(*) AS n, round(avg(composite),6) AS mean, round(stddev_samp(composite)/sqrt(count(*)),6) AS se, round(avg(composite)-1.96e0*stddev_samp(composite)/sqrt(count(*)),6) AS low95,
  round(avg(composite)+2.576e0*stddev_samp(composite)/sqrt(count(*)),6) AS high99 FROM scored WHERE zone_id IS NOT NULL AND composite > 0 GROUP BY 1""")
def _(v):
    return wt.zone_bands(v.scored.where("zone_id is not null"), "zone_id").select("zone_id", "n", R("mean"), R("se"), R("low95"), R("high99"))
