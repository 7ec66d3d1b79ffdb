"""Price outliers: density noise, explanations, calibrated radius, isolation forest, review."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import labels as lb
from plotwise.operators.clusters import density_clusters
from plotwise.operators.geo import spread
from plotwise.operators.neighbours import Leaves, euclid, take
from plotwise.operators.ranking import exact_quantiles, join_on, medians, value_positions
from plotwise.operators.upsert import latest_per_key
from plotwise.session import stage

# Density parameters, anomaly ratios, feature names, rerun rules.
EPS, MIN_POINTS, MIN_GROUP = 1.5, 5, 10
RATIO_HIGH, RATIO_LOW = 3.0, 0.25
FEATURES = {"price_m2": "Precio/m²", "area": "Área construida", "stratum": "Estrato"}
MIN_NEW, MAX_DAYS = 30, 7


def prepare(listings: DataFrame, by: list[str]) -> DataFrame:
    """Price/m², area and median-imputed stratum per listing, and their standardized forms within the group.

    Groups below the minimum size are left out.
    """
    d = listings.where("price is not null and area > 0").withColumn("price_m2", F.col("price") / F.col("area"))
    d = stage(d, "priced")  # read several times below
    med = exact_quantiles(d, "stratum", {"_ms": 0.5}, by)
    d = join_on(d, med, by, "left").withColumn("stratum_f", F.coalesce(F.col("stratum").cast("double"), F.col("_ms"), F.lit(3.0))).drop("_ms")
    cols = ["price_m2", "area", "stratum_f"]
    st = d.groupBy(*by).agg(F.count("*").alias("_n"), *[e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    d = join_on(d, st.where(F.col("_n") >= MIN_GROUP), by)
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return d.withColumns({f"z{i}": z(c) for i, c in enumerate(cols)}).drop("_n", *[f"_{p}_{c}" for c in cols for p in "ms"])


def density_noise(df: DataFrame, zs: list[str], by: list[str] = (), eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """Add `noise`: true for points that DBSCAN leaves outside every cluster.

    Noise needs no clusters, only core points, and those need no pair lists:
    equal points are collapsed; a cell of side eps/sqrt(d) with `min_points`
    points makes all of them core at once; only points in thinner cells - fewer
    than `min_points` per cell - look around, so every point meets a bounded
    number of partners however dense its surroundings are.
    """
    by, d = list(by), len(zs)
    side, reach = eps / math.sqrt(d), math.ceil(math.sqrt(d))
    cells = [f"_g{i}" for i in range(d)]
    spots = df.groupBy(*by, *zs).agg(F.count("*").alias("_k")).withColumns({g: F.floor(F.col(z) / side) for g, z in zip(cells, zs)})
    sizes = spots.groupBy(*by, *cells).agg(F.sum("_k").alias("_cell"))
    spots = stage(join_on(spots, sizes, by + cells).withColumn("_dense", F.col("_cell") >= min_points).drop("_cell"), "spots")
    thin = spots.where(~F.col("_dense"))
    around = spread(thin.select(*by, *[F.col(z).alias(f"_p{z}") for z in zs], *cells), cells, reach)
    d2 = sum(((F.col(z) - F.col(f"_p{z}")) ** 2 for z in zs), F.lit(0.0))
    pkey = by + [f"_p{z}" for z in zs]
    near = join_on(spots, around, by + cells).where(d2 <= eps * eps)
    seen = near.groupBy(*pkey).agg(F.sum("_k").alias("_n"), F.bool_or("_dense").alias("_touch")).withColumnsRenamed({f"_p{z}": z for z in zs})
    thin = stage(join_on(thin, seen, by + zs).withColumn("_core", F.col("_n") >= min_points), "thin")
    cores = thin.where("_core").select(*by, *zs, *cells)
    lonely = thin.where("not _core and not _touch")
    probe = spread(lonely.select(*by, *[F.col(z).alias(f"_p{z}") for z in zs], *cells), cells, reach)
    saved = join_on(cores, probe, by + cells).where(d2 <= eps * eps).select(*pkey).distinct().withColumnsRenamed({f"_p{z}": z for z in zs})
    noise = lonely.select(*by, *zs).join(saved, by + zs, "left_anti").withColumn("noise", F.lit(True))
    return join_on(df, noise, by + zs, "left").fillna(False, ["noise"])


def explanations(df: DataFrame, by: list[str]) -> DataFrame:
    """`reasons`: features far from the group median, with ratio and wording."""
    names = list(FEATURES)
    df = stage(df, "explained")  # each median reads it twice
    d = join_on(df, medians(df, names, by), by, "left")

    def reason(n):
        ratio = F.col(n) / F.nullif(F.col(f"med_{n}").cast("double"), F.lit(0.0))
        text = F.when(ratio > 1, F.format_string(f"{FEATURES[n]} %.1fx por encima de la mediana", ratio)).otherwise(F.format_string(f"{FEATURES[n]} %.2fx de la típica", ratio))
        return F.when((ratio > RATIO_HIGH) | (ratio < RATIO_LOW), F.struct(F.lit(n).alias("feature"), F.round(F.col(n).cast("double"), 2).alias("value"),
                                                                         F.round(F.col(f"med_{n}").cast("double"), 2).alias("median"), F.round(ratio, 2).alias("ratio"), text.alias("text")))

    return d.withColumn("reasons", F.array_compact(F.array(*[reason(n) for n in names]))).drop(*[f"med_{n}" for n in names])


def classify(listings: DataFrame, by: list[str], reviewed: DataFrame | None = None) -> DataFrame:
    """Listings that are noise in their group and have an extreme feature.

    Reviewed listings (id, status) keep their status and are not classified again.
    """
    base = listings if reviewed is None else listings.join(reviewed.select("id"), "id", "left_anti")
    d = explanations(density_noise(prepare(base, by), ["z0", "z1", "z2"], by), by)
    found = d.where(F.col("noise") & (F.size("reasons") > 0)).select("id", "reasons", F.lit("pending").alias("status"))
    if reviewed is None:
        return found
    kept = reviewed.select("id", F.lit(None).cast(found.schema["reasons"].dataType).alias("reasons"), "status")
    return found.unionByName(kept)


# ------------------------------------------------------- calibrated radius


def k_distances(df: DataFrame, zs: list[str], ident: str, k: int = 5) -> DataFrame:
    """Distance of every point to its k-th nearest other point."""
    fs = [f"_f{z}" for z in zs]
    dist = lambda c: F.round(F.sqrt(sum(((c(z) - c(f)) ** 2 for z, f in zip(zs, fs)), F.lit(0.0))), 9)
    leaves = Leaves(df.select(F.col(ident).alias("_f"), *[F.col(z).alias(f) for z, f in zip(zs, fs)]), fs, "_f")
    measure, lower = euclid(zs, fs)
    near = leaves.nearest(df.select(*zs).distinct(), zs, k + leaves.same_id(), measure=measure, lower=lower, dist=dist, slack=2e-9)
    best = take(df.select(ident, *zs), near, zs, ident, k, "_f", True)
    return best.groupBy(ident).agg(F.max("dist").alias("k_dist"), F.count("*").alias("_c")).where(F.col("_c") == k).drop("_c")


def elbow(kd: DataFrame, col: str = "k_dist") -> DataFrame:
    """Value at the largest second difference of the sorted distances, and their quartiles.

    Neighbouring values in the sorted order meet by position, so nothing is
    sorted in one place.
    """
    p = stage(value_positions(kd, col).select(F.col(col).alias("v"), "cnt", "before", (F.col("before") + F.col("cnt")).alias("after")))
    nxt = p.select(F.col("before").alias("after"), F.col("v").alias("next"))
    prv = p.select(F.col("after").alias("before"), F.col("v").alias("prev"))
    j = p.join(nxt, "after").join(prv, "before", "left")
    rise = F.when(F.col("cnt") > 1, F.col("next") - F.col("v")).otherwise(F.col("next") - F.col("v") - (F.col("v") - F.col("prev")))
    best = j.withColumn("_r", F.round(rise, 9)).where("_r is not null").agg(F.min_by("v", F.struct(-F.col("_r"), F.col("before"))).alias("eps"))
    q = exact_quantiles(kd, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return best.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k").drop("_k")


def calibrated_clusters(df: DataFrame, zs: list[str], ident: str = "id", k: int = 5) -> DataFrame:
    """Density clusters at the elbow of the k-distances, rounded to four digits: `label`, `core` and `eps` per row."""
    eps = elbow(stage(k_distances(df, zs, ident, k), "k-distances")).select(F.round("eps", 4)).first()
    eps = float(eps[0]) if eps and eps[0] is not None else 0.0
    return density_clusters(df, zs, eps=eps, min_points=k, ident=ident).withColumn("eps", F.lit(eps))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """One row: radius, rows, clusters found, noise and its share in per cent."""
    noise = F.count(F.when(F.col("label").isNull(), 1))
    return clusters.agg(F.max("eps").alias("eps"), F.count("*").alias("n"), F.count_distinct("label").alias("n_clusters"), noise.alias("n_outliers"), F.round(noise / F.count("*") * 100, 2).alias("pct_outliers"))


# -------------------------------------------------------- isolation forest


def _c(n):
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)


TREE = "tree int, node int, col int, cut double, left int, right int, depth double"


def tree_samples(df: DataFrame, cols: list[str], ident: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, rank, cols): the `sample` rows with the smallest hash of tree and row, for every tree by itself.

    A hash bound that four times as many rows meet on average goes first, so a
    tree ranks a bounded number of rows whatever the size of the table. Rows
    with a null take no part.
    """
    known = df.select(ident, *cols).dropna(subset=cols)
    n = known.count()
    bound = int(4 * sample / n * 2.0**63) if n > 4 * sample else 2**63 - 1
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col(ident), *cols), 1).alias("h")))
    few = known.withColumn("_d", F.explode(F.filter(drawn, lambda x: x["h"] <= bound))).select("_d.tree", "_d.h", F.col(ident).alias("_id"), *cols)
    w = Window.partitionBy("tree").orderBy("h", "_id", *cols)
    return few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample).select("tree", "rank", *cols)


def grow_tree(X: np.ndarray, rng, tree: int = 0) -> list[tuple]:
    """Nodes of one isolation tree; a leaf has no children and the expected depth of its rows."""
    limit = math.ceil(math.log2(max(len(X), 2)))
    nodes, todo = [None], [(0, np.arange(len(X)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        j = int(rng.integers(X.shape[1]))
        lo, hi = (X[rows, j].min(), X[rows, j].max()) if len(rows) else (0.0, 0.0)
        if depth >= limit or lo == hi:
            nodes[node] = (tree, node, 0, 0.0, -1, -1, depth + _c(len(rows)))
            continue
        cut, left = rng.uniform(lo, hi), len(nodes)
        nodes[node] = (tree, node, j, cut, left, left + 1, float(depth))
        nodes += [None, None]
        below = X[rows, j] < cut
        todo += [(left, rows[below], depth + 1), (left + 1, rows[~below], depth + 1)]
    return nodes


def path_lengths(nodes, X: np.ndarray) -> np.ndarray:
    """Expected depth of every row in one tree, given its nodes in order."""
    at = np.zeros(len(X), dtype=int)
    col, cut, left, right, depth = (nodes[c].to_numpy() for c in ("col", "cut", "left", "right", "depth"))
    while (inner := left[at] >= 0).any():
        below = X[np.arange(len(X)), col[at]] < cut[at]
        at = np.where(inner, np.where(below, left[at], right[at]), at)
    return depth[at]


def isolation_scores(df: DataFrame, cols: list[str], ident: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Anomaly score of every row; higher is stranger. A row with a null has none.

    Every tree draws its own 256 rows from the whole table and grows on the
    executors. The model, at most 2 * sample nodes a tree, is all the driver sees.
    """
    def grow(pdf):
        t = int(pdf["tree"].iloc[0])
        X = pdf.sort_values("rank")[cols].to_numpy(dtype=float)
        return pd.DataFrame(grow_tree(X, np.random.default_rng([seed, t]), t), columns=[c.split(" ")[0] for c in TREE.split(", ")])

    drawn = stage(tree_samples(df, cols, ident, trees, sample, seed), "iso_sample")
    m = drawn.where("tree = 0").count()
    model = drawn.groupBy("tree").applyInPandas(grow, TREE).toPandas().sort_values(["tree", "node"])
    forest = [g for _, g in model.groupby("tree")]
    norm = _c(m) or 1.0

    def score(batches):
        for pdf in batches:
            M = pdf[cols].to_numpy(dtype=float)
            d = np.mean([path_lengths(t, M) for t in forest], axis=0) if forest else np.zeros(len(M))
            yield pdf.assign(iso_score=pd.Series(2.0 ** (-d / norm), index=pdf.index).where(~np.isnan(M).any(axis=1)))

    return df.mapInPandas(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", iso_score double")


def isolation_outliers(df: DataFrame, cols: list[str], ident: str, share: float = 0.05, **kw) -> DataFrame:
    """Flag the `share` of rows with the highest scores."""
    d = stage(isolation_scores(df, cols, ident, **kw), "iso")
    cut = exact_quantiles(d, "iso_score", {"q": 1 - share}).first()["q"]
    return d.withColumn("iso_outlier", F.col("iso_score") > float(cut))


# ------------------------------------------------------------------ review


def review(flags: DataFrame, decisions: DataFrame, order: Column) -> DataFrame:
    """Status of every flag after the latest decision on it: confirmed, reinstated or pending."""
    last = latest_per_key(decisions.withColumn("_o", order), ["id"], F.col("_o")).select("id", "decision")
    d = flags.join(last, "id", "left")
    status = F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "reinstate", "reinstated").otherwise("pending")
    return d.withColumns({"status": status, "is_outlier": status != "reinstated"}).drop("decision")


def rerun_decision(df: DataFrame, ts: str, last_run: Column | None, now: Column) -> DataFrame:
    """Whether to classify again: enough new listings, or new ones and a week gone by."""
    ok = df.where("price > 0 and area > 0")
    if last_run is None:
        n = ok.agg(F.count("*").alias("n_new"))
        return n.withColumn("reasons", F.when(F.col("n_new") >= MIN_NEW, "first_run").otherwise("")).withColumn("trigger", F.col("reasons") != "")
    n = ok.where(F.col(ts) > last_run).agg(F.count("*").alias("n_new"))
    days = F.datediff(now, last_run)
    why = F.concat_ws(",", F.when(F.col("n_new") >= MIN_NEW, "new_listings"), F.when((F.col("n_new") > 0) & (days >= MAX_DAYS), "days_without_run"))
    return n.withColumn("reasons", why).withColumn("trigger", F.col("reasons") != "")
