"""Weights from pairwise judgements and from data, and how sensitive the index is to them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.operators.gram import Gram, hash_unit, solve
from plotwise.operators.pca import components
from plotwise.operators.ranking import with_ranks

# Random consistency indices, expert and data-driven crime weights, error shares of the scores.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}
EXPERT_WEIGHTS = {"homicidios": 0.5660, "lesiones_personales": 0.0, "violencia_intrafamiliar": 0.0, "delitos_sexuales": 0.2670,
                  "hurto_personas": 0.1200, "hurto_residencias": 0.0, "hurto_automotores": 0.0, "otros": 0.0470}
DATA_WEIGHTS = {"homicidios": 0.133, "lesiones_personales": 0.177, "violencia_intrafamiliar": 0.161, "delitos_sexuales": 0.164,
                "hurto_personas": 0.154, "hurto_residencias": 0.124, "hurto_automotores": 0.087, "otros": 0.0}
ERROR_SHARES = {"access": 0.05, "security": 0.10, "dwelling": 0.03, "services": 0.05, "zoning": 0.01}


def pairwise_weights(answers: DataFrame, user: str, criteria: list[str]) -> DataFrame:
    """Principal-eigenvector weights, consistency index and ratio of every respondent.

    `answers` is long: (user, i, j, value) with i < j, one row per upper-triangle
    cell. Rows are pivoted to one per respondent and solved in batches of small
    matrices.
    """
    n = len(criteria)
    cells = [(i, j) for i in range(n) for j in range(i + 1, n)]
    wide = answers.groupBy(user).agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value").cast("double"))).alias(f"c{i}_{j}") for i, j in cells])
    wide = wide.dropna()
    ri = RANDOM_INDEX.get(n, 1.0)
    ut = dict(answers.dtypes)[user]
    schema = ", ".join([f"{user} {ut}", *[f"w_{c} double" for c in criteria], "lambda_max double", "ci double", "cr double", "consistent boolean"])

    def solve_batches(batches):
        for pdf in batches:
            A = np.ones((len(pdf), n, n))
            for i, j in cells:
                v = pdf[f"c{i}_{j}"].to_numpy()
                A[:, i, j], A[:, j, i] = v, 1.0 / v
            w = np.ones((len(pdf), n)) / n
            for _ in range(200):  # power iteration on all matrices of the batch
                nxt = np.einsum("bij,bj->bi", A, w)
                nxt /= nxt.sum(1, keepdims=True)
                if len(w) == 0 or np.max(np.abs(nxt - w)) < 1e-14:
                    w = nxt
                    break
                w = nxt
            lam = (np.einsum("bij,bj->bi", A, w) / w).mean(1) if len(w) else np.zeros(0)
            ci = (lam - n) / (n - 1) if n > 1 else np.zeros(len(w))
            cr = ci / ri if ri else np.zeros(len(w))
            out = pd.DataFrame({user: pdf[user].to_numpy(), **{f"w_{c}": w[:, k] for k, c in enumerate(criteria)}, "lambda_max": lam, "ci": ci, "cr": cr, "consistent": cr < 0.10})
            yield out

    return wide.mapInPandas(solve_batches, schema)


def matrix_from_ranks(ranks: DataFrame, user: str, item: str, place: str) -> DataFrame:
    """Pairwise values 1 + 2 (rank difference), at most 9, with reciprocals; a user ranks few items."""
    a = ranks.select(user, F.col(item).alias("i"), F.col(place).alias("_a"))
    b = ranks.select(user, F.col(item).alias("j"), F.col(place).alias("_b"))
    diff = F.col("_b") - F.col("_a")
    big = lambda d: F.least(F.lit(9.0), 1 + 2 * d.cast("double"))
    return a.join(b, user).withColumn("value", F.when(F.col("i") == F.col("j"), 1.0).when(diff >= 0, big(diff)).otherwise(1 / big(-diff))).drop("_a", "_b")


def invalid_cells(matrix: DataFrame, user: str, tol: float = 1e-6) -> DataFrame:
    """Cells that break the unit diagonal or reciprocity."""
    t = matrix.select(user, F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("_t"))
    m = matrix.join(t, [user, "i", "j"], "left")
    diag = (F.col("i") == F.col("j")) & (F.abs(F.col("value") - 1) > tol)
    recip = (F.col("i") < F.col("j")) & (F.col("_t").isNull() | (F.abs(F.col("value") * F.col("_t") - 1) > tol))
    return m.where(diag | recip).withColumn("fault", F.when(diag, "diagonal").otherwise("reciprocity")).drop("_t")


def hybrid_weights(expert: dict[str, float], data: dict[str, float], alpha: float) -> dict[str, float]:
    """alpha expert + (1 - alpha) data, summing to one, four decimals."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    raw = {k: alpha * w + (1 - alpha) * data.get(k, 0.0) for k, w in expert.items()}
    tot = sum(raw.values())
    return {k: round(w / tot, 4) for k, w in raw.items()}


def hybrid_ranking(zones: DataFrame, key: str, columns: dict[str, str], base: dict[str, float], alphas: list[float]) -> DataFrame:
    """Crime mass and rank per zone for every alpha beside the base weights, and the rank correlation per alpha.

    `columns` maps a weight name to its count column.
    """
    mass = lambda w: reduce(lambda a, b: a + b, [F.col(c).cast("double") * float(w.get(n, 0.0)) for n, c in columns.items()])
    rows = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), mass(hybrid_weights(EXPERT_WEIGHTS, DATA_WEIGHTS, a)).alias("mass")) for a in alphas])
    d = zones.select(key, mass(base).alias("base_mass"), F.explode(rows).alias("e")).select(key, "base_mass", "e.alpha", "e.mass")
    d = with_ranks(d, {"b_": ("base_mass", ["alpha"], True), "h_": ("mass", ["alpha"], True)})
    d = d.select(key, "alpha", "base_mass", "mass", F.col("b_rank").alias("base_rank"), F.col("h_rank").alias("rank"), "b_avg_rank", "h_avg_rank")
    rho = d.groupBy("alpha").agg(F.corr("b_avg_rank", "h_avg_rank").alias("rho"))
    return d.drop("b_avg_rank", "h_avg_rank").join(rho, "alpha").withColumn("change", F.col("base_rank") - F.col("rank"))


def empirical_weights(g: Gram, y: str, subs: list[str]) -> dict[str, dict[str, float]]:
    """Weights by absolute correlation, by standardized regression and by the first component."""
    C = g.cross([y, *subs])
    sd = np.sqrt(np.diag(C))
    r = np.abs(C[1:, 0] / (sd[1:] * sd[0]))
    R = g.corr(subs)
    b = np.abs(solve(R, C[1:, 0] / (sd[1:] * sd[0])))
    pc = np.abs(components(R)[1][0])
    norm = lambda v: dict(zip(subs, map(float, v / v.sum()))) if v.sum() > 1e-10 else {s: 1 / len(subs) for s in subs}
    return {"correlation": norm(r), "regression": norm(b), "pca": norm(pc)}


def doubt_weights(df: DataFrame, subs: list[str], ident: str, top: int = 100) -> DataFrame:
    """Benefit of the doubt: mean normalized rank shares of the `top` best rows by min-max sum."""
    d = df.dropna(subset=subs)
    b = d.agg(*[e for s in subs for e in (F.min(s).alias(f"{s}_a"), F.max(s).alias(f"{s}_b"))]).first()
    unit = [(F.col(s) - float(b[f"{s}_a"])) / float(b[f"{s}_b"] - b[f"{s}_a"] + 1e-10) for s in subs]
    d = with_ranks(d.withColumn("_sum", reduce(lambda x, y: x + y, unit)), {f"{s}__": (s, [], True) for s in subs})
    best = d.orderBy(F.desc("_sum"), ident).limit(top)
    own = [1 - (F.col(f"{s}__rank") - 1) / F.col(f"{s}__n") for s in subs]
    tot = reduce(lambda x, y: x + y, own)
    means = best.agg(*[F.avg(o / tot).alias(s) for s, o in zip(subs, own)])
    allm = reduce(lambda x, y: x + y, [F.col(s) for s in subs])
    return means.select(*[(F.col(s) / allm).alias(s) for s in subs])


# -------------------------------------------------------------- sensitivity


def perturbed(base: list[float], delta: float, sim: Column) -> list[Column]:
    """Weights moved by up to ±delta and renormalized, reproducible per simulation."""
    raw = [F.lit(float(w)) * (1 - delta + 2 * delta * hash_unit(sim, F.lit(k))) for k, w in enumerate(base)]
    tot = reduce(lambda a, b: a + b, raw)
    return [r / tot for r in raw]


def rank_stability(zones: DataFrame, key: str, subs: list[str], base: list[float] | None = None, delta: float = 0.20, sims: int = 1000, moved: int = 5) -> DataFrame:
    """Spearman correlation and share of zones moving more than `moved` places, per simulation.

    Zones are a small dimension; each simulation ranks that table once.
    """
    base = base or [1 / len(subs)] * len(subs)
    base = [w / sum(base) for w in base]
    d = zones.dropna(subset=subs).select(key, *subs).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    w = perturbed(base, delta, F.col("sim"))
    total = lambda ws: reduce(lambda a, b: a + b, [F.col(s) * x for s, x in zip(subs, ws)])
    # Scores are told apart to nine decimals; equal ones are ordered by key.
    d = d.withColumns({"_b": F.round(total([F.lit(x) for x in base]), 9), "_p": F.round(total(w), 9)})
    place = lambda c: F.row_number().over(Window.partitionBy("sim").orderBy(F.desc(c), key))
    d = d.withColumns({"_rb": place("_b"), "_rp": place("_p")})
    return d.groupBy("sim").agg(F.corr("_rb", "_rp").alias("rho"), F.avg(F.when(F.abs(F.col("_rb") - F.col("_rp")) > moved, 1.0).otherwise(0.0)).alias("moved_share"))


def stability_summary(sims: DataFrame) -> DataFrame:
    """Quantiles over the simulations (their number is a parameter, so the exact percentile is bounded)."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    r = sims.agg(q("rho", 0.05).alias("rho_p5"), q("rho", 0.5).alias("rho_median"), q("rho", 0.95).alias("rho_p95"),
                 (q("moved_share", 0.5) * 100).alias("moved_median"), (q("moved_share", 0.95) * 100).alias("moved_p95"))
    verdict = F.when((F.col("rho_median") > 0.90) & (F.col("moved_median") < 10), "robust").when(F.col("rho_median") > 0.80, "acceptable").otherwise("fragile")
    return r.withColumn("verdict", verdict)


def rank_distribution(zones: DataFrame, key: str, dims: list[str], weights: list[float], delta: float = 0.3, sims: int = 1000) -> DataFrame:
    """Mean, median and extreme rank of every zone under perturbed weights, and how stable it is."""
    d = zones.select(key, *dims).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    w = perturbed(weights, delta, F.col("sim"))
    d = d.withColumn("_p", F.round(reduce(lambda a, b: a + b, [F.col(s) * x for s, x in zip(dims, w)]), 9))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("sim").orderBy(F.desc("_p"), key)))
    out = d.groupBy(key).agg(F.avg("_r").alias("rank_mean"), F.percentile("_r", F.lit(0.5)).alias("rank_median"), F.min("_r").alias("rank_min"), F.max("_r").alias("rank_max"))
    spread = F.col("rank_max") - F.col("rank_min")
    return out.withColumn("stable", F.when(spread <= 4, "SI").when(spread <= 7, "PARCIAL").otherwise("NO"))


def sobol(df: DataFrame, subs: list[str], n: int = 1024, floor: float = 0.05) -> DataFrame:
    """First-order and total Sobol indices of the mean index with respect to its weights.

    The mean of a linear index needs the column means only, so the simulations
    run over one scalar row.
    """
    d = df.dropna(subset=subs)
    m = d.agg(*[F.avg(s).alias(s) for s in subs])
    mean = [m.select(s).scalar() for s in subs]
    p = len(subs)
    sim = df.sparkSession.range(n).withColumn("one", F.lit(1))
    sim = sim.withColumns({f"{x}{k}": hash_unit(F.lit(x), F.col("id"), F.lit(k)) for x in "AB" for k in range(p)})
    sim = sim.withColumns({f"m{k}": mean[k] for k in range(p)})

    def out(cols):
        w = [F.greatest(F.lit(floor), F.col(c)) for c in cols]
        tot = reduce(lambda a, b: a + b, w)
        return reduce(lambda a, b: a + b, [x / tot * F.col(f"m{k}") for k, x in enumerate(w)])

    sim = sim.withColumns({"YA": out([f"A{k}" for k in range(p)]), "YB": out([f"B{k}" for k in range(p)]),
                           **{f"Y{i}": out([f"{'B' if k == i else 'A'}{k}" for k in range(p)]) for i in range(p)}})
    ybar = (F.avg("YA") + F.avg("YB")) / 2
    var = (F.avg(F.col("YA") ** 2) + F.avg(F.col("YB") ** 2)) / 2 - ybar * ybar
    row = sim.agg(var.alias("v"), *[e for i in range(p) for e in (F.avg(F.col("YB") * (F.col(f"Y{i}") - F.col("YA"))).alias(f"s{i}"),
                                                                  (0.5 * F.avg((F.col("YA") - F.col(f"Y{i}")) ** 2)).alias(f"t{i}"))])
    cells = F.array(*[F.struct(F.lit(s).alias("score"), (F.col(f"s{i}") / F.col("v")).alias("first_order"), (F.col(f"t{i}") / F.col("v")).alias("total")) for i, s in enumerate(subs)])
    return row.select(F.explode(cells).alias("e")).select("e.*").withColumn("interaction", F.col("total") - F.col("first_order"))


# -------------------------------------------------------------- uncertainty


def index_bands(df: DataFrame, subs: dict[str, float] = ERROR_SHARES, by: str = "kind", index: str = "composite", weight: float = 0.20) -> DataFrame:
    """90 % and 95 % bands of every listing's index: score errors plus the covariances within its kind."""
    names = list(subs)
    full = reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    cov = df.where(full).groupBy(by).agg(F.count("*").alias("_n"), *[F.covar_samp(a, b).alias(f"_c_{a}_{b}") for a, b in pairs])
    cross = F.when(F.col("_n") >= 30, reduce(lambda a, b: a + b, [F.col(f"_c_{a}_{b}") for a, b in pairs]) * (2 * weight * weight)).otherwise(0.0)
    d = df.join(cov.select(by, cross.alias("_cross")), by, "left")
    own = reduce(lambda a, b: a + b, [F.pow(F.coalesce(F.col(s), F.lit(0.0)) * (e * weight), 2) for s, e in subs.items()])
    d = d.withColumn("sigma", F.sqrt(F.greatest(F.lit(0.0), own + F.coalesce(F.col("_cross"), F.lit(0.0))))).drop("_cross")
    return d.withColumns({f"{n}{p}": F.col(index) + s * z * F.col("sigma") for p, z in (("90", 1.645), ("95", 1.96)) for n, s in (("low", -1), ("high", 1))})


def gravity_bands(df: DataFrame, score: str, count: str, radius: float, gps: float = 10.0) -> DataFrame:
    """95 % band of a gravity score from the position error of the coordinates."""
    s = F.when(F.col(count) > 0, F.col(score) * (gps / (radius / 2.0)) / F.sqrt(F.col(count))).otherwise(0.0)
    return df.withColumns({"sigma": s, "low": F.col(score) - 1.96 * s, "high": F.col(score) + 1.96 * s})


def zone_bands(df: DataFrame, zone: str, index: str = "composite") -> DataFrame:
    """Mean index per zone with its standard error and 95 % and 99 % intervals."""
    a = df.where(F.col(index) > 0).groupBy(zone).agg(F.count("*").alias("n"), F.avg(index).alias("mean"), F.stddev_samp(index).alias("sd"))
    a = a.withColumn("se", F.col("sd") / F.sqrt("n"))
    return a.withColumns({f"{n}{p}": F.col("mean") + s * z * F.col("se") for p, z in (("95", 1.96), ("99", 2.576)) for n, s in (("low", -1), ("high", 1))})
