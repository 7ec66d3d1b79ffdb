"""Statistical validity battery of the composite index."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import mathx as mx
from plotwise.operators import geo
from plotwise.operators.cleaning import complete_cases
from plotwise.operators.gram import Fit, Gram, gram, grams, group_grams, hash_unit, report, report_rows
from plotwise.operators.ranking import average_ranks, exact_quantiles, value_positions
from plotwise.operators.regression import cv_scores, fold_grams
from plotwise.session import stage

NAN = float("nan")


# ------------------------------------------------------------ nested models


def nested_models(g: Gram, y: str, index: str, subs: list[str], controls: list[str]) -> list[tuple]:
    """Index plus controls against all sub-scores plus controls; both are blocks of one statistic."""
    red, full = g.fit(y, [index, *controls]), g.fit(y, [*subs, *controls])
    d_r2, d_aic = full.r2 - red.r2, full.aic - red.aic
    lrt, df1 = 2 * (full.loglik - red.loglik), full.k - red.k
    df2 = g.n - full.k - 1
    f = ((red.ssr - full.ssr) / df1) / (full.ssr / df2) if df1 > 0 and df2 > 0 and full.ssr > 0 else NAN
    verdict = "index_suffices" if d_r2 < 0.02 and d_aic > -10 else "subscores_dominate" if d_r2 > 0.05 or d_aic < -20 else "subscores_add"
    rows = [("nested", "n", g.n)]
    for n, m in (("reduced", red), ("full", full)):
        rows += [("nested", f"{n}_{x}", getattr(m, x)) for x in ("r2", "r2_adj", "aic", "bic")]
    return rows + [("nested", "delta_r2", d_r2), ("nested", "delta_r2_adj", full.r2_adj - red.r2_adj), ("nested", "delta_aic", d_aic),
                   ("nested", "delta_bic", full.bic - red.bic), ("nested", "lrt", lrt), ("nested", "lrt_p", mx.chi2_sf(max(lrt, 0), df1) if df1 > 0 else 1.0),
                   ("nested", "f", f), ("nested", "f_p", mx.f_sf(f, df1, df2)), ("nested", "verdict", verdict)]


def commonality(g: Gram, y: str, subs: list[str]) -> list[tuple]:
    """Unique and common variance of the sub-scores by leaving each out."""
    tot = g.fit(y, subs).r2
    raw = {s: tot - g.fit(y, [x for x in subs if x != s]).r2 for s in subs}
    uniq = {s: max(0.0, v) for s, v in raw.items()}
    common = max(0.0, tot - sum(uniq.values()))
    pct = common / tot * 100 if tot > 0 else 0.0
    sup = sum(v < 0 for v in raw.values())
    verdict = ("suppression" if sup else "good_summary" if pct > 70 else "acceptable_summary" if pct > 40 else "orthogonal_subscores")
    return [("commonality", "r2_total", tot), ("commonality", "common", common), ("commonality", "pct_common", pct), ("commonality", "suppressors", sup),
            *[("commonality", f"unique_{s}", v) for s, v in uniq.items()], ("commonality", "verdict", verdict)]


def cv_comparison(df: DataFrame, y: str, index: str, subs: list[str], controls: list[str], group: str, key: str) -> list[tuple]:
    """In-sample, random and group-wise cross-validated R² of both models."""
    rnd, spa = fold_grams(df, [y, index, *subs, *controls], group, key)
    full = sum(rnd[1:], rnd[0])
    rows, keep = [], {}
    for name, xs in (("reduced", [index, *controls]), ("full", [*subs, *controls])):
        r, s = cv_scores(rnd, y, xs), cv_scores(spa, y, xs)
        leak = (r[2] - s[2]) / abs(s[2]) if s[2] else NAN
        keep[name] = (r[2], s[2], leak)
        rows += [("cv", f"{name}_in_sample", full.fit(y, xs).r2), ("cv", f"{name}_random", r[2]), ("cv", f"{name}_spatial", s[2]), ("cv", f"{name}_leakage", leak)]
    d = keep["full"][1] - keep["reduced"][1]
    verdict = "subscores_win_out_of_sample" if d > 0.02 else "index_wins_out_of_sample" if d < -0.02 else "tie_out_of_sample"
    return rows + [("cv", "delta_random", keep["full"][0] - keep["reduced"][0]), ("cv", "delta_spatial", d),
                   ("cv", "spatial_leakage", abs(keep["full"][2]) > 0.15), ("cv", "verdict", verdict)]


# ---------------------------------------------------------------- bootstrap


def poisson_weight(u: Column, most: int = 12) -> Column:
    """Poisson(1) count from a uniform, by inversion."""
    w, cum, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(most):
        cum += p
        w = w + F.when(u >= cum, 1).otherwise(0)
        p /= k + 1
    return w


def replicate_weights(df: DataFrame, key: str, reps: int) -> DataFrame:
    """Long table of Poisson(1) bootstrap weights per (row, replicate), zero weights left out."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return d.withColumn("weight", poisson_weight(hash_unit(F.col("rep"), F.col(key)))).where("weight > 0")


def block_grams(df: DataFrame, names: list[str], key: str, blocks: int = 1000) -> list[Gram]:
    """Statistics of `blocks` hashed blocks of rows: the bootstrap then resamples blocks.

    One pass over the rows whatever the number of replicates, and a driver table
    of fixed size. With no more rows than blocks this is the row bootstrap.
    """
    return list(grams(df.withColumn("_blk", F.floor(hash_unit(F.lit("blk"), F.col(key)) * blocks).cast("int")), names, ["_blk"]).values())


def resampled(parts: list[Gram], reps: int, seed: int = 42):
    """Bootstrap replicates of the total statistic."""
    rng = np.random.default_rng(seed)
    n = np.array([g.n for g in parts])
    s = np.array([g.s for g in parts])
    S = np.array([g.S for g in parts])
    for _ in range(reps):
        w = rng.poisson(1.0, len(parts)).astype(float)
        if (w @ n) < 1:
            continue
        yield Gram(parts[0].names, parts[0].shift, float(w @ n), w @ s, np.tensordot(w, S, 1))


def bootstrap_fits(parts: list[Gram], y: str, index: str, subs: list[str], controls: list[str], reps: int = 1000, level: float = 0.95) -> list[tuple]:
    """Percentile intervals of R², its difference and the AIC difference."""
    val = {"r2_reduced": [], "r2_full": [], "delta_r2": [], "delta_aic": []}
    for g in resampled(parts, reps):
        a, b = g.fit(y, [index, *controls]), g.fit(y, [*subs, *controls])
        for k, v in (("r2_reduced", a.r2), ("r2_full", b.r2), ("delta_r2", b.r2 - a.r2), ("delta_aic", b.aic - a.aic)):
            val[k].append(v)
    q = (1 - level) / 2
    rows, sig = [], {}
    for k, v in val.items():
        x = np.array(v)[~np.isnan(v)]
        lo, hi = np.quantile(x, q), np.quantile(x, 1 - q)
        sig[k] = not lo <= 0 <= hi
        rows += [("bootstrap", f"{k}_mean", x.mean()), ("bootstrap", f"{k}_low", lo), ("bootstrap", f"{k}_high", hi)]
    verdict = "significant" if sig["delta_r2"] and sig["delta_aic"] else "not_significant"
    return rows + [("bootstrap", "verdict", verdict)]


# ----------------------------------------------------------- specification


def _reset(df: DataFrame, f0: Fit, y: str, xs: list[str]) -> tuple[float, float]:
    """RESET with squared and cubed predictions, standardized first so the powers stay well scaled."""
    p = f0.predict()
    st = df.agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).first()
    u = (p - float(st["m"])) / float(st["s"] or 1.0)
    g = gram(df.withColumns({"_p2": u * u, "_p3": u * u * u}), [y, *xs, "_p2", "_p3"])
    f1 = g.fit(y, [*xs, "_p2", "_p3"])
    df2 = g.n - f1.k - 1
    f = ((f0.ssr - f1.ssr) / 2) / (f1.ssr / df2) if f1.ssr > 0 and df2 > 0 else NAN
    return f, mx.f_sf(f, 2, df2)


def reset_test(df: DataFrame, g: Gram, y: str, index: str, subs: list[str], controls: list[str]) -> list[tuple]:
    rows, bad = [], {}
    for name, xs in (("reduced", [index, *controls]), ("full", [*subs, *controls])):
        f, p = _reset(df, g.fit(y, xs), y, xs)
        bad[name] = p < 0.05
        rows += [("reset", f"{name}_f", f), ("reset", f"{name}_p", p)]
    verdict = ("both_misspecified" if all(bad.values()) else "full_misspecified" if bad["full"] else "reduced_misspecified" if bad["reduced"] else "both_ok")
    return rows + [("reset", "verdict", verdict)]


def subgroup_fits(df: DataFrame, group: str, y: str, index: str, subs: list[str], controls: list[str], at_least: int = 50) -> DataFrame:
    """Fit quality of both models in every group of enough rows, how much it varies, and a verdict."""
    red, full = [index, *controls], [*subs, *controls]

    def rows(key, g):
        return [] if g.n < at_least else [("n", g.n), ("r2_reduced", g.fit(y, red).r2), ("r2_full", g.fit(y, full).r2)]

    each = stage(report_rows(group_grams(df, [y, index, *subs, *controls], [group]), rows).withColumn("section", F.concat(F.lit("subgroup_"), "section")), "subgroups")
    of = lambda item: F.when(F.col("item") == item, F.col("value"))
    cv = lambda item: F.when(F.avg(of(item)) > 0, F.stddev_pop(of(item)) / F.avg(of(item)))
    spread = each.agg(cv("r2_reduced").alias("cv_reduced"), cv("r2_full").alias("cv_full"))
    verdict = F.when(F.col("cv_full") > 0.30, "high_heterogeneity").when(F.col("cv_full") > 0.15, "moderate_heterogeneity").otherwise("homogeneous")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    line = lambda item, value, label: F.struct(F.lit(item).alias("item"), value.alias("value"), label.alias("label"))
    last = spread.select(F.lit("subgroup").alias("section"), F.inline(F.array(line("cv_reduced", F.round("cv_reduced", 6), text), line("cv_full", F.round("cv_full", 6), text), line("verdict", none, verdict))))
    return each.unionByName(last)


def specifications(df: DataFrame, y: str, subs: list[str], controls: list[str], area: str = "area", security: str = "security",
                   dwelling: str = "dwelling", access: str = "access", services: str = "services", stratum: str = "stratum") -> list[tuple]:
    """Base, log area, squares, interactions and everything; one statistic over the union of the features."""
    c = F.col
    extra = {"log_area": F.ln(F.greatest(c(area), F.lit(1.0))), "security_sq": c(security) ** 2, "dwelling_sq": c(dwelling) ** 2,
             "security_stratum": c(security) * c(stratum), "dwelling_area": c(dwelling) * c(area), "access_services": c(access) * c(services)}
    d = df.withColumns(extra)
    base = [*subs, *controls]
    specs = {"M1_base": [], "M2_log_area": ["log_area"], "M3_squares": ["security_sq", "dwelling_sq"],
             "M4_interactions": ["security_stratum", "dwelling_area", "access_services"], "M5_all": list(extra)}
    g = gram(d, [y, *base, *extra])
    fits = {n: g.fit(y, base + xs) for n, xs in specs.items()}
    rows, ok = [], {}
    for n, f in fits.items():
        _, p = _reset(d, f, y, f.xs)
        ok[n] = p > 0.05
        rows += [(n, "r2", f.r2), (n, "r2_adj", f.r2_adj), (n, "aic", f.aic), (n, "bic", f.bic), (n, "reset_p", p),
                 (n, "delta_r2", f.r2 - fits["M1_base"].r2), (n, "delta_aic", f.aic - fits["M1_base"].aic)]
    best = max(fits, key=lambda n: fits[n].r2_adj)
    aic = min(fits, key=lambda n: fits[n].aic)
    passing = [n for n in sorted(fits, key=lambda n: -fits[n].r2_adj) if ok[n]]
    verdict = ("improvable_and_specified" if passing and passing[0] != "M1_base" else "improvable_but_misspecified" if aic != "M1_base" else "base_is_best")
    return rows + [("choice", "best_r2_adj", best), ("choice", "best_aic", aic), ("choice", "best_reset", passing[0] if passing else "none"), ("choice", "verdict", verdict)]


# ------------------------------------------------------------------- ranks


def spearman(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """Rank correlation with average ranks and its t-approximated p-value."""
    r = average_ranks(df.select(a, b).dropna(), [a, b]).agg(F.corr(a, b).alias("r"), F.count("*").alias("n")).first()
    rho, n = r["r"] if r["r"] is not None else NAN, r["n"]
    t = rho * math.sqrt((n - 2) / max(1e-300, 1 - rho * rho)) if n > 2 and abs(rho) < 1 else float("inf")
    return rho, (mx.t_sf2(t, n - 2) if math.isfinite(t) else 0.0), n


def mann_whitney(df: DataFrame, col: str, first: Column, second: Column) -> tuple[float, float]:
    """U of the first group and its two-sided tie-corrected normal p-value."""
    p = value_positions(df.where(first | second), col, counts={"": F.count("*"), "a": F.count(F.when(first, 1))})
    mid = F.col("before") + (F.col("cnt") + 1) / 2
    t = F.col("cnt").cast("double")
    r = p.agg(F.sum(mid * F.col("cnta")).alias("R"), F.sum("cnta").alias("n1"), F.sum("cnt").alias("n"), F.sum(t * t * t - t).alias("ties")).first()
    n1, n = float(r["n1"]), float(r["n"])
    n2 = n - n1
    u = r["R"] - n1 * (n1 + 1) / 2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - r["ties"] / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s if s > 0 else 0.0
    return u, min(1.0, math.erfc(z / math.sqrt(2)))


def auc(df: DataFrame, score: str, positive: Column) -> float:
    p = value_positions(df, score, counts={"": F.count("*"), "a": F.count(F.when(positive, 1))})
    mid = F.col("before") + (F.col("cnt") + 1) / 2
    r = p.agg(F.sum(mid * F.col("cnta")).alias("R"), F.sum("cnta").alias("n1"), F.sum("cnt").alias("n")).first()
    n1, n2 = float(r["n1"]), float(r["n"] - r["n1"])
    return (r["R"] - n1 * (n1 + 1) / 2) / (n1 * n2) if n1 and n2 else NAN


def ks_two_sample(df: DataFrame, col: str, first: Column, second: Column) -> tuple[float, float]:
    """Largest gap of the two cumulative distributions and its asymptotic p-value."""
    p = value_positions(df.where(first | second), col, counts={"a": F.count(F.when(first, 1)), "b": F.count(F.when(second, 1))})
    gap = F.abs((F.col("beforea") + F.col("cnta")) / F.col("totala") - (F.col("beforeb") + F.col("cntb")) / F.col("totalb"))
    r = p.agg(F.max(gap).alias("d"), F.max("totala").alias("a"), F.max("totalb").alias("b")).first()
    en = math.sqrt(r["a"] * r["b"] / (r["a"] + r["b"]))
    return r["d"], mx.kolmogorov_sf(en * r["d"])


def quartile_of(col: str, q: list[float]) -> Column:
    return F.when(F.col(col) <= q[0], 1).when(F.col(col) <= q[1], 2).when(F.col(col) <= q[2], 3).otherwise(4)


def mispricing(df: DataFrame, g: Gram, y: str, index: str, hedonic: list[str]) -> list[tuple]:
    """Residual of the physical model against the index: rank correlation, quartile means, Q4 against Q1."""
    f = g.fit(y, hedonic)
    d = df.dropna(subset=[y, index, *hedonic]).withColumn("_res", F.col(y) - f.predict())
    rho, p, n = spearman(d, index, "_res")
    q = list(exact_quantiles(d, index, {"a": 0.25, "b": 0.5, "c": 0.75}).first())
    d = d.withColumn("_q", quartile_of(index, q))
    rows = [("mispricing", "n", n), ("mispricing", "r2", f.r2), ("mispricing", "rho", rho), ("mispricing", "rho_p", p)]
    meds = {r["_q"]: r["m"] for r in exact_quantiles(d, "_res", {"m": 0.5}, ["_q"]).collect()}
    for r in d.groupBy("_q").agg(F.count("*").alias("n"), F.avg(index).alias("i"), F.avg("_res").alias("r")).collect():
        rows += [("mispricing", f"q{r['_q']}_n", r["n"]), ("mispricing", f"q{r['_q']}_index", r["i"]), ("mispricing", f"q{r['_q']}_residual", r["r"])]
    u, pu = mann_whitney(d, "_res", F.col("_q") == 4, F.col("_q") == 1)
    verdict = ("index_detects_undervaluation" if rho < -0.05 and p < 0.05 else "index_already_priced_in" if rho > 0.05 and p < 0.05 else "no_link_with_mispricing")
    return rows + [("mispricing", "median_gap", meds.get(4, NAN) - meds.get(1, NAN)), ("mispricing", "u", u), ("mispricing", "u_p", pu), ("mispricing", "verdict", verdict)]


def convergent(df: DataFrame, index: str, stratum: str, price_m2: str) -> list[tuple]:
    """Agreement with stratum and price: rank correlations, ANOVA, AUC of the high strata."""
    d = complete_cases(df.select(index, stratum, price_m2), [index, stratum, price_m2])
    rho1, p1, n = spearman(d, index, stratum)
    rho2, p2, _ = spearman(d, index, price_m2)
    groups = stage(d.groupBy(stratum).agg(F.count("*").alias("n"), F.avg(index).alias("m"), F.var_pop(index).alias("v")).where("n >= 5"), "strata")
    N, k, mean, ssw = groups.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("m")) / F.sum("n"), F.sum(F.col("n") * F.col("v"))).first()
    N, mean, ssw = N or 0, mean or 0.0, ssw or 0.0
    ssb = groups.agg(F.sum(F.col("n") * (F.col("m") - mean) ** 2)).first()[0] or 0.0
    f = (ssb / (k - 1)) / (ssw / (N - k)) if k > 1 and ssw > 0 else NAN
    eta = ssb / (ssb + ssw) if ssb + ssw > 0 else 0.0
    a = auc(d, index, F.col(stratum) >= 4)
    ok = [rho1 > 0.3 and p1 < 0.01, eta > 0.1, a > 0.70]
    verdict = "convergent_validity_ok" if all(ok) else "partial_validity" if ok[0] or ok[2] else "insufficient_validity"
    return [("convergent", "n", n), ("convergent", "rho_stratum", rho1), ("convergent", "rho_stratum_p", p1), ("convergent", "rho_price", rho2), ("convergent", "rho_price_p", p2),
            ("convergent", "anova_f", f), ("convergent", "anova_p", mx.f_sf(f, k - 1, N - k)), ("convergent", "eta_sq", eta), ("convergent", "auc", a),
            ("convergent", "verdict", verdict)]


def stratum_means(df: DataFrame, index: str, stratum: str) -> DataFrame:
    """Mean index of every stratum of at least five rows, in the report's shape."""
    g = complete_cases(df.select(index, stratum), [index, stratum]).groupBy(stratum).agg(F.count("*").alias("n"), F.avg(index).alias("m")).where("n >= 5")
    return g.select(F.lit("convergent").alias("section"), F.concat(F.lit("mean_"), F.col(stratum).cast("string")).alias("item"), F.round("m", 6).alias("value"), F.lit(None).cast("string").alias("label"))


def decision_matrix(df: DataFrame, g: Gram, y: str, index: str, hedonic: list[str], price_m2: str) -> list[tuple]:
    """Index above or below its median by residual sign: shares, means, and a KS test of the two good halves."""
    f = g.fit(y, hedonic)
    d = df.dropna(subset=[y, index, price_m2, *hedonic]).withColumn("_res", F.col(y) - f.predict())
    med = exact_quantiles(d, index, {"m": 0.5}).first()["m"]
    high, cheap = F.col(index) > med, F.col("_res") < 0
    d = d.withColumn("_q", F.when(high & cheap, "buy").when(high, "hold").when(cheap, "avoid").otherwise("sell"))
    got = d.groupBy("_q").agg(F.count("*").alias("n"), F.avg(index).alias("i"), F.avg(price_m2).alias("p"), F.avg("_res").alias("r")).collect()
    n = sum(r["n"] for r in got)
    mean_p = sum(r["n"] * r["p"] for r in got) / n
    rows, pct = [("decision", "median_index", med)], {}
    for r in got:
        q = r["_q"]
        pct[q] = r["n"] / n * 100
        rows += [("decision", f"{q}_n", r["n"]), ("decision", f"{q}_pct", pct[q]), ("decision", f"{q}_index", r["i"]), ("decision", f"{q}_price_m2", r["p"]),
                 ("decision", f"{q}_residual", r["r"]), ("decision", f"{q}_vs_all_pct", (r["p"] / mean_p - 1) * 100)]
    ks, p = ks_two_sample(d, price_m2, F.col("_q") == "buy", F.col("_q") == "hold")
    a, b = pct.get("buy", 0), pct.get("sell", 0)
    verdict = "useful" if a > 15 and b > 15 else "moderately_useful" if a + b > 20 else "of_little_use"
    return rows + [("decision", "ks", ks), ("decision", "ks_p", p), ("decision", "verdict", verdict)]


def summary_table(nested: list[tuple], common: list[tuple], ranking: dict[str, float]) -> list[tuple]:
    """State per test against its threshold, and the overall verdict."""
    v = {i: x for _, i, x in nested + common}
    grade = lambda x, ok, warn: "OK" if ok(x) else "REVIEW" if warn(x) else "FAIL"
    tests = [("delta_r2", v["delta_r2"], grade(v["delta_r2"], lambda x: x < 0.02, lambda x: x < 0.05)),
             ("delta_aic", v["delta_aic"], grade(v["delta_aic"], lambda x: x > -10, lambda x: x > -20)),
             ("pct_common", v["pct_common"], grade(v["pct_common"], lambda x: x > 70, lambda x: x > 40)),
             ("spearman", ranking["spearman"], grade(ranking["spearman"], lambda x: x > 0.90, lambda x: x > 0.80)),
             ("moved_pct", ranking["moved_pct"], grade(ranking["moved_pct"], lambda x: x < 10, lambda x: x < 20))]
    states = [s for _, _, s in tests]
    verdict = "reliable" if all(s == "OK" for s in states) else "unreliable" if "FAIL" in states else "acceptable_with_reservations"
    return [r for n, x, s in tests for r in (("summary", n, x), ("summary", f"{n}_state", s))] + [("summary", "verdict", verdict)]


# -------------------------------------------------------------- diagnostics


def moran(points: DataFrame, value: str, ident: str = "id", k: int = 5) -> list[tuple]:
    """Moran's I over k nearest neighbours with row-standardized weights; n*k pairs, never n*n."""
    d = points.where(F.col(value).isNotNull() & F.col("lon").isNotNull())
    st = d.agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.var_pop(value).alias("v")).first()
    n = st["n"]
    z = d.select(F.col(ident), "lon", "lat", (F.col(value) - float(st["m"])).alias("_z"))
    from plotwise.session import stage

    z = stage(z, "residuals")
    pairs = geo.nearest_others(z.select(ident, "lon", "lat").distinct(), z, k, ident=ident)
    pairs = pairs.join(z.select(F.col(ident).alias("_f"), F.col("_z").alias("_zf")).distinct(), "_f").select(ident, "_f", "_zf")

    pairs = stage(pairs.join(z.select(ident, "_z"), ident))
    num = pairs.agg(F.sum(F.col("_z") * F.col("_zf")).alias("s"), F.count("*").alias("e")).first()
    back = pairs.select(F.col("_f").alias(ident), F.col(ident).alias("_f"))
    mutual = pairs.join(back, [ident, "_f"], "left_semi").count()
    indeg = pairs.groupBy("_f").agg(F.count("*").alias("c")).agg(F.sum((1 + F.col("c") / k) ** 2).alias("s"), F.count("*").alias("m")).first()
    s0 = num["e"] / k
    s1 = ((num["e"] - mutual) + 2 * mutual) / k**2
    s2 = indeg["s"] + (n - indeg["m"])
    den = st["v"] * n
    i = (n / s0) * (num["s"] / k / den)
    e = -1 / (n - 1)
    var = (n**2 * s1 - n * s2 + 3 * s0**2) / ((n - 1) * (n + 1) * s0**2) - e**2
    zs = (i - e) / math.sqrt(max(var, 1e-10))
    p = mx.normal_sf2(zs)
    verdict = "none" if p >= 0.05 else "positive" if i > e else "negative"
    return [("moran", "i", i), ("moran", "expected", e), ("moran", "variance", var), ("moran", "z", zs), ("moran", "p", p), ("moran", "verdict", verdict)]


def breusch_pagan(df: DataFrame, resid: str, xs: list[str]) -> list[tuple]:
    g = gram(df.withColumn("_r2", F.col(resid) ** 2), ["_r2", *xs])
    lm = g.n * g.fit("_r2", xs).r2
    p = mx.chi2_sf(lm, len(xs))
    return [("breusch_pagan", "lm", lm), ("breusch_pagan", "p", p), ("breusch_pagan", "homoscedastic", p > 0.05)]


def recommendations(vifs: dict[str, float], moran_p: float, normal_p: float, bp_p: float) -> list[tuple]:
    out = []
    bad = [k for k, v in vifs.items() if v > 10]
    if bad:
        out.append("collinear: " + ",".join(sorted(bad)))
    if moran_p < 0.05:
        out.append("spatial autocorrelation: use a spatial lag model")
    if normal_p < 0.05:
        out.append("residuals not normal: transform or fit robustly")
    if bp_p < 0.05:
        out.append("heteroscedastic: use robust standard errors")
    return [("advice", f"r{i}", t) for i, t in enumerate(out or ["assumptions hold"], 1)]


def _skew_z(b, n):
    y = b * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    d, a = 1 / math.sqrt(0.5 * math.log(w2)), math.sqrt(2.0 / (w2 - 1))
    y = y if y != 0 else 1.0
    return d * math.log(y / a + math.sqrt((y / a) ** 2 + 1))


def _kurt_z(k, n):
    e = 3.0 * (n - 1) / (n + 1)
    v = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (k + 3 - e) / math.sqrt(v)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb * (2.0 / sb + math.sqrt(1 + 4.0 / sb**2))
    t1, den = 1 - 2 / (9.0 * a), 1 + x * math.sqrt(2 / (a - 4.0))
    t2 = math.copysign(((1 - 2.0 / a) / abs(den)) ** (1 / 3.0), den)
    return (t1 - t2) / math.sqrt(2 / (9.0 * a))


def normality(df: DataFrame, col: str) -> list[tuple]:
    """Moments, D'Agostino, Jarque-Bera, Anderson-Darling and KS against the fitted normal."""
    m = df.agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.stddev_samp(col).alias("s"), F.skewness(col).alias("g1"), F.kurtosis(col).alias("g2")).first()
    n, sk, ku = m["n"], m["g1"], m["g2"]
    k2 = _skew_z(sk, n) ** 2 + _kurt_z(ku, n) ** 2
    jb = n / 6 * (sk * sk + ku * ku / 4)
    p = value_positions(df, col)
    z = (F.col(col) - float(m["m"])) / float(m["s"])
    lo, hi = mx.normal_cdf(z), mx.normal_cdf(-z)
    b, c = F.col("before").cast("double"), F.col("cnt").cast("double")
    ad = F.sum(c * (2 * b + c) * F.ln(lo) + c * (2 * (n - b) - c) * F.ln(hi))
    ks = F.max(F.greatest((b + c) / n - lo, lo - b / n))
    r = p.agg(ad.alias("ad"), ks.alias("ks")).first()
    a2 = -n - r["ad"] / n
    crit = round(0.787 / (1 + 4.0 / n - 25.0 / n / n), 3)
    kp = mx.kolmogorov_sf((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * r["ks"])
    ps = [mx.chi2_sf(k2, 2), mx.chi2_sf(jb, 2), kp]
    rej = sum(x < 0.05 for x in ps) + (a2 > crit)
    return [("normality", "n", n), ("normality", "skewness", sk), ("normality", "kurtosis", ku), ("normality", "dagostino", k2), ("normality", "dagostino_p", ps[0]),
            ("normality", "jarque_bera", jb), ("normality", "jarque_bera_p", ps[1]), ("normality", "anderson_darling", a2), ("normality", "ad_rejects", a2 > crit),
            ("normality", "ks", r["ks"]), ("normality", "ks_p", kp), ("normality", "rejections", rej),
            ("normality", "verdict", "clearly_not_normal" if rej >= 3 else "marginal" if rej == 2 else "compatible")]


def qq_points(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Sample quantiles beside normal ones at fixed probabilities."""
    q = exact_quantiles(df, col, {f"q{i}": p for i, p in enumerate(probs)})
    rows = F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"q{i}").alias("sample")) for i, p in enumerate(probs)])
    return q.select(F.explode(rows).alias("e")).select("e.prob", "e.sample", mx.normal_quantile(F.col("e.prob")).alias("normal"))


def to_report(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return report(df.sparkSession, rows)
