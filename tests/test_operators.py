"""Operators against brute force and closed forms on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotwise.functions import labels as lb
from plotwise.functions import mathx as mx
from plotwise.functions import spatial as sp
from plotwise.operators import geo
from plotwise.operators import gram as gm
from plotwise.operators import outliers as ou
from plotwise.operators import ranking as rk
from plotwise.operators import regression as rg
from plotwise.operators import search as se
from plotwise.operators import upsert as up
from plotwise.operators import weights as wt
from plotwise.operators.relational import lag_by_time
from plotwise.streaming import jobs as st

rng = np.random.default_rng(5)


def hav(lon1, lat1, lon2, lat2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.sqrt(np.minimum(1, a)))


def hot_points(n, seed):
    """A third of all points at one spot, another third in a tight cluster, the rest spread out."""
    g = np.random.default_rng(seed)
    lon = np.where(np.arange(n) % 3 == 0, -74.1, np.where(np.arange(n) % 3 == 1, -74.08 + g.normal(0, 1e-4, n), g.uniform(-74.2, -74.0, n)))
    lat = np.where(np.arange(n) % 3 == 0, 4.6, np.where(np.arange(n) % 3 == 1, 4.65 + g.normal(0, 1e-4, n), g.uniform(4.45, 4.85, n)))
    return pd.DataFrame({"id": np.arange(n), "lon": lon, "lat": lat})


def test_ranks_with_heavy_ties(spark):
    v = np.where(np.arange(3000) % 3 == 0, 7.0, np.round(rng.normal(size=3000), 1))
    pdf = pd.DataFrame({"id": range(3000), "g": np.where(np.arange(3000) % 5 < 4, "a", "b"), "v": v})
    got = rk.with_ranks(spark.createDataFrame(pdf), {"u_": ("v", ["g"], False), "d_": ("v", [], True)}).toPandas().sort_values("id")
    assert (got.u_rank.values == pdf.groupby("g").v.rank(method="min").values).all()
    assert np.allclose(got.u_avg_rank.astype(float).values, pdf.groupby("g").v.rank().values)
    assert (got.d_rank.values == pdf.v.rank(method="min", ascending=False).values).all()


def test_null_and_single_row_ranks(spark):
    got = rk.with_rank(spark.createDataFrame([(1, None), (2, 3.0)], "id int, v double"), "v").orderBy("id").collect()
    assert got[0]["rank"] is None and got[1]["rank"] == 1 and got[1]["pct_rank"] == 0.0


def test_exact_quantiles(spark):
    pdf = pd.DataFrame({"g": np.repeat(["x", "y"], [501, 1000]), "v": np.concatenate([rng.integers(0, 9, 501), rng.lognormal(size=1000)])})
    got = rk.exact_quantiles(spark.createDataFrame(pdf), "v", {"a": 0.1, "b": 0.5, "c": 0.93}, ["g"]).toPandas().set_index("g")
    for g, d in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(d.v, [0.1, 0.5, 0.93]))


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_with_hot_spot(spark, k):
    p, f = hot_points(240, 1), hot_points(150, 2)
    got = geo.nearest(spark.createDataFrame(p), spark.createDataFrame(f.rename(columns={"id": "fid", "lon": "flon", "lat": "flat"})), k, fid="fid").toPandas()
    got = p.merge(got[["lon", "lat", "fid", "dist", "rn"]], on=["lon", "lat"]).sort_values(["id", "rn"])
    for i, r in p.iterrows():
        d = np.round(hav(r.lon, r.lat, f.lon.values, f.lat.values), 3)
        want = sorted(zip(d, f.id))[:k]
        assert list(got[got.id == r.id].fid) == [x for _, x in want]


def test_nearest_excludes_self_and_respects_radius(spark):
    p = hot_points(90, 3)
    f = spark.createDataFrame(p.rename(columns={"id": "fid", "lon": "flon", "lat": "flat"}))
    got = geo.nearest(spark.createDataFrame(p), f, 2, fid="fid", exclude_self="id", within=1500.0).toPandas()
    for _, r in p.iterrows():
        d = np.round(hav(r.lon, r.lat, p.lon.values, p.lat.values), 3)
        want = [x for _, x in sorted((a, b) for a, b in zip(d, p.id) if b != r.id and a <= 1500)[:2]]
        assert list(got[got.id == r.id].sort_values("rn").fid) == want


def test_radius_aggregate_counts_copies(spark):
    p, f = hot_points(120, 4), hot_points(200, 5)
    got = geo.radius_aggregate(spark.createDataFrame(p), spark.createDataFrame(f), 900, {"n": F.sum("mult")}, fill={"n": 0}).toPandas().set_index("id").n
    for _, r in p.iterrows():
        assert got[r.id] == (hav(r.lon, r.lat, f.lon.values, f.lat.values) <= 900).sum()


def test_latitude_beyond_promise_fails(spark):
    d = spark.createDataFrame([(1, 0.0, 60.0)], "id int, lon double, lat double")
    with pytest.raises(Exception, match="max_lat"):
        geo.radius_pairs(d.select("lon", "lat"), geo.as_features(d), 100).collect()


RINGS = {"ell": [[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]], "hole": [[(10, 0), (14, 0), (14, 4), (10, 4), (10, 0)], [(11, 1), (13, 1), (13, 3), (11, 3), (11, 1)]],
         "left": [[(20, 0), (21, 0), (21, 1), (20, 1), (20, 0)]], "right": [[(21, 0), (22, 0), (22, 1), (21, 1), (21, 0)]]}


def polygons(spark):
    rows = [(n, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rs]) for n, rs in RINGS.items()]
    return spark.createDataFrame(rows, "name string, rings array<array<struct<x:double,y:double>>>")


def test_point_in_polygon_edges_and_holes(spark):
    pts = {(0.5, 1.5): {"ell"}, (1.5, 1.5): set(), (12.0, 2.0): set(), (10.5, 2.0): {"hole"}, (21.0, 0.5): {"right"}, (20.5, 0.5): {"left"}, (50.0, 50.0): set()}
    p = spark.createDataFrame(list(pts), "lon double, lat double")
    got = {}
    for r in geo.point_in_polygon(p, polygons(spark), size=0.7).collect():
        got.setdefault((r.lon, r.lat), set()).add(r["name"])
    assert {k: got.get(k, set()) for k in pts} == pts
    both = geo.point_in_polygon(p, polygons(spark), size=0.7, closed=True).where("lon = 21").collect()
    assert {r["name"] for r in both} == {"left", "right"}


def test_centroid_interior_and_projection(spark):
    cx, cy = sp.ring_centroid(F.get("rings", 0))
    px, py = sp.interior_point(F.col("rings"))
    r = polygons(spark).select("name", cx.alias("cx"), cy.alias("cy"), px.alias("px"), py.alias("py")).toPandas().set_index("name")
    assert np.allclose(r.loc["ell", ["cx", "cy"]].astype(float), [5 / 6, 5 / 6])
    assert not (11 < r.loc["hole", "px"] < 13 and 1 < r.loc["hole", "py"] < 3)
    x, y = sp.NATIONAL_GRID.forward(F.lit(-74.07750791666666), F.lit(4.596200416666666))
    o = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(o.x - 1e6) < 1e-4 and abs(o.y - 1e6) < 1e-4


def test_nearest_polygon_against_brute_force(spark):
    sq = lambda x, y, w: [[{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + w}, {"x": x, "y": y + w}, {"x": x, "y": y}]]
    boxes = [(i, -74.2 + 0.05 * (i % 4), 4.5 + 0.07 * (i // 4), 0.002 + 0.03 * (i % 2)) for i in range(12)]
    polys = spark.createDataFrame([(i, sq(x, y, w)) for i, x, y, w in boxes], "pid int, rings array<array<struct<x:double,y:double>>>")
    p = pd.DataFrame({"lon": rng.uniform(-74.25, -73.95, 60), "lat": rng.uniform(4.4, 4.8, 60)})
    inside = lambda r: any(x <= r.lon < x + w and y <= r.lat < y + w for _, x, y, w in boxes)
    p = p[~p.apply(inside, axis=1)]
    got = geo.nearest_polygon(spark.createDataFrame(p), polys, poly_id="pid").toPandas()
    k = math.pi * 6371000 / 180
    for _, r in got.iterrows():
        gap = lambda x, y, w: math.hypot(max(x - r.lon, 0, r.lon - x - w) * math.cos(math.radians(r.lat)) * k, max(y - r.lat, 0, r.lat - y - w) * k)
        assert min((round(gap(x, y, w), 3), i) for i, x, y, w in boxes)[1] == r.pid


@pytest.mark.parametrize("hot", [False, True])
def test_density_noise_against_brute_force(spark, hot):
    n = 300
    Z = rng.normal(size=(n, 3)) * np.where(rng.random((n, 1)) < 0.15, 4, 1)
    if hot:
        Z[: n // 3] = Z[0]
    pdf = pd.DataFrame(Z, columns=["z0", "z1", "z2"]).assign(id=range(n))
    got = ou.density_noise(spark.createDataFrame(pdf), ["z0", "z1", "z2"], [], 0.8, 5).toPandas().sort_values("id").noise.values
    D = np.sqrt(((Z[:, None] - Z[None]) ** 2).sum(-1)) <= 0.8
    core = D.sum(1) >= 5
    assert (got == (~core & ~(D & core[None]).any(1))).all()


def test_k_distances(spark):
    Z = np.vstack([rng.normal(size=(80, 2)), np.zeros((20, 2))])
    pdf = pd.DataFrame(Z, columns=["z0", "z1"]).assign(id=range(100))
    got = ou.k_distances(spark.createDataFrame(pdf), ["z0", "z1"], "id", 3).toPandas().set_index("id").k_dist
    D = np.sort(np.sqrt(((Z[:, None] - Z[None]) ** 2).sum(-1)), axis=1)
    assert np.allclose([got[i] for i in range(100)], D[:, 3], atol=1e-8)


def test_isolation_forest_ranks_far_points_first(spark):
    Z = np.vstack([rng.normal(size=(400, 3)), np.full((4, 3), 12.0)])
    d = ou.isolation_scores(spark.createDataFrame(pd.DataFrame(Z, columns=list("abc")).assign(id=range(404))), list("abc"), "id").toPandas().sort_values("iso_score")
    assert set(d.id.tail(4)) == {400, 401, 402, 403}


def test_least_squares_matches_numpy(spark):
    X = rng.normal(size=(400, 3))
    X[:, 2] = 2 * X[:, 0] + 1e-3 * X[:, 2]
    y = 1 + X @ [0.5, -1, 0.25] + rng.normal(size=400)
    g = gm.gram(spark.createDataFrame(pd.DataFrame(X, columns=list("abc")).assign(y=y)), ["y", "a", "b", "c"])
    f = g.fit("y", ["a", "b", "c"])
    A = np.column_stack([np.ones(400), X])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose([f.intercept, *f.coef.values()], beta, rtol=1e-5)
    assert abs(f.ssr - ((y - A @ beta) ** 2).sum()) < 1e-6
    assert abs(g.sse("y", ["a", "b", "c"], list(f.coef.values()), f.intercept) - f.ssr) < 1e-6


def test_race_ridge_and_lasso_properties(spark):
    X = rng.normal(size=(500, 4))
    d = spark.createDataFrame(pd.DataFrame(X, columns=list("abcd")).assign(y=3 * X[:, 0] + rng.normal(size=500) * 0.1, id=range(500)))
    folds = list(gm.grams(d.withColumn("f", gm.hash_fold(F.col("id"), 5)), ["y", *"abcd"], ["f"]).values())
    r = rg.race(folds, "y", list("abcd"))
    assert all(abs(r[m]["raw"][0] - 3) < 0.05 for m in r)
    A, c = gm.total(folds).cross(list("abcd")), gm.total(folds).cross(["y", *"abcd"])[1:, 0]
    assert np.allclose(rg.elastic_path(A, c, 500, 1e6, 1.0), 0)
    assert np.allclose(rg.elastic_path(A, c, 500, 0.0, 1.0), np.linalg.solve(A, c), atol=1e-6)


def test_quantile_regression_splits_the_data(spark):
    x = rng.uniform(0, 5, 800)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + rng.exponential(1, 800)}))
    fits = rg.quantile_fits(d, "y", ["x"])
    q = rg.quantile_position(d, fits, "y", ["x"]).groupBy("position").count().toPandas().set_index("position")["count"]
    assert abs(q["below_q25"] - 200) < 12 and abs(q["above_q75"] - 200) < 12


def test_distribution_tails():
    assert abs(mx.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(mx.f_sf(4.0, 3, 20) - 0.0221) < 2e-4
    assert abs(mx.t_quantile(0.95, 2) - 2.919985580) < 1e-6
    assert abs(mx.t_sf2(2.228138852, 10) - 0.05) < 1e-8


def test_normal_columns(spark):
    r = spark.createDataFrame([(0.975, 1.0)], "p double, z double").select(mx.normal_quantile(F.col("p")).alias("q"), mx.normal_cdf(F.col("z")).alias("c")).first()
    assert abs(r.q - 1.959963985) < 1e-6 and abs(r.c - 0.8413447461) < 1e-6


def test_decay_kernels(spark):
    s = lb.calibrated_sigma(1000)
    r = spark.range(0, 2001, 100).select(F.col("id").cast("double").alias("d")).select(
        "d", lb.gaussian_decay(F.col("d"), F.lit(s)).alias("g"), lb.linear_decay(F.col("d"), 1000.0).alias("l"), lb.inverse_decay(F.col("d")).alias("i")).toPandas()
    assert abs(r.g[10] - 0.05) < 1e-12 and r.g.is_monotonic_decreasing and r.l.min() == 0 and r.i.max() == 0.02


def test_pairwise_weights(spark):
    rows = [(1, 0, 1, 2.0), (1, 0, 2, 4.0), (1, 1, 2, 2.0), (2, 0, 1, 9.0), (2, 0, 2, 1 / 9), (2, 1, 2, 9.0)]
    r = wt.pairwise_weights(spark.createDataFrame(rows, "u int, i int, j int, value double"), "u", ["a", "b", "c"]).toPandas().set_index("u")
    assert np.allclose(r.loc[1, ["w_a", "w_b", "w_c"]].astype(float), [4 / 7, 2 / 7, 1 / 7]) and r.loc[1, "consistent"] and not r.loc[2, "consistent"]


def test_hybrid_weights_sum_to_one():
    for a in (0.0, 0.3, 1.0):
        assert abs(sum(wt.hybrid_weights(wt.EXPERT_WEIGHTS, wt.DATA_WEIGHTS, a).values()) - 1) < 1e-3
    with pytest.raises(ValueError):
        wt.hybrid_weights(wt.EXPERT_WEIGHTS, wt.DATA_WEIGHTS, 1.2)


QUERIES = [("q1", "apartamento cerca de un hospital a 500 metros, menos de 600M", 500, ["ips"], ["Apartamento"], None, 600_000_000),
           ("q2", "casa a 10 minutos a pie de un colegio con 3 habitaciones", 800, ["colegio"], ["Casa"], None, None),
           ("q3", "lote entre 300 y 500M en Suba", 500, [], ["Lote"], 300_000_000, 500_000_000),
           ("q4", "apto pegado a un parque y a 1,5 km de transmilenio", 1500, ["parque", "transmilenio"], ["Apartamento"], None, None),
           ("q5", "oficina muy cerca del supermercado, más de 200 millones", 300, ["supermercado"], ["Oficina"], 200_000_000, None)]


def test_query_features(spark):
    log = spark.createDataFrame([(q[0], q[1]) for q in QUERIES], "id string, q string")
    got = {r["id"]: r for r in se.parse_queries(log, "id", "q").collect()}
    for i, _, m, cats, kinds, lo, hi in QUERIES:
        r = got[i]
        assert (r.max_m, list(r.categories), list(r.kinds), r.price_min, r.price_max) == (m, cats, kinds, lo, hi), i
    assert got["q3"].locality == "SUBA" and got["q2"].rooms_min == 3


def test_upsert_actions(spark):
    t = F.lit("2024-01-01").cast("timestamp")
    cur = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "k string, p int, s string").withColumns({"first_seen": t, "last_seen": t, "scrapes": F.lit(1)})
    new = spark.createDataFrame([("a", 1, None, 1), ("b", 5, "y", 1), ("d", 9, "w", 1), ("b", 4, "y", 2)], "k string, p int, s string, o int")
    r = {x.k: x for x in up.upsert(cur, new, ["k"], ["p", "s"], F.lit("2024-02-01").cast("timestamp"), F.col("o")).collect()}
    assert {k: x.action for k, x in r.items()} == {"a": "unchanged", "b": "updated", "c": "kept", "d": "inserted"}
    assert r["a"].s == "x" and r["b"].p == 4 and r["b"].changes == ["p"] and r["b"].scrapes == 3 and r["c"].scrapes == 1


def test_lag_by_time_on_a_hot_key(spark):
    pdf = pd.DataFrame({"key": np.where(np.arange(400) % 3 == 0, "hot", "k" + pd.Series(np.arange(400) % 7).astype(str)),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 30 * 24, 400), "h"), "i": range(400), "v": rng.integers(0, 50, 400)})
    got = lag_by_time(spark.createDataFrame(pdf), "key", "ts", ["ts", "i"], ["v"]).toPandas().sort_values("i")
    want = pdf.sort_values(["ts", "i"]).groupby("key").v.shift(1).sort_index()
    assert np.array_equal(got.prev_v.values.astype(float), want.values.astype(float), equal_nan=True)
    assert (got.is_first.values == want.isna().values).all()


def test_change_audit_over_several_batches(spark, tmp_path):
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), p) for k in "ab" for d, p in enumerate([1, 1, 2, 3, 3, 1])]
    pdf = pd.DataFrame(rows, columns=["k", "ts", "p"])
    src = str(tmp_path / "in")
    for i, part in enumerate([pdf[pdf.ts < "2024-01-03"], pdf[pdf.ts >= "2024-01-03"]]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = st.change_audit(stream, "k", ["p"], ["ts"], "audit-test").orderBy("key", "ts").toPandas()
    a = got[got.key == "a"]
    assert list(a.action) == ["created", "updated", "updated", "updated"] and list(a.new)[1:] == ["2", "3", "1"]


@pytest.mark.parametrize("planar", [False, True])
def test_radius_pairs_hold_every_feature_once(spark, planar):
    pts = spark.range(300).selectExpr("id", "-74.1 + (id % 17) * 0.003 AS lon", "4.6 + (id % 13) * 0.004 AS lat")
    feats = geo.as_features(spark.range(60).selectExpr("id AS f", "-74.1 + (id % 7) * 0.005 AS lon", "4.6 + (id % 11) * 0.003 AS lat"))
    got = geo.radius_pairs(pts, F.broadcast(feats), 800, planar=planar)
    plan = got._jdf.queryExecution().executedPlan().toString()
    held = plan[plan.index("BroadcastExchange"):]
    assert "Generate" not in held
    far = F.sqrt(F.pow(sp.local_xy("lon", "lat")[0] - sp.local_xy("flon", "flat")[0], 2) + F.pow(sp.local_xy("lon", "lat")[1] - sp.local_xy("flon", "flat")[1], 2)) if planar else sp.haversine("lon", "lat", "flon", "flat")
    want = pts.crossJoin(feats).where(far <= 800).select("id", "f")
    assert want.count() > 0 and sorted(got.select("id", "f").collect()) == sorted(want.collect())
