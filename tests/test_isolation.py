"""Isolation trees: samples, path lengths, scores."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plotwise.operators import outliers as ou


def test_every_tree_draws_its_smallest_hashes(spark):
    pdf = pd.DataFrame({"id": np.arange(3000) // 2, "a": np.random.default_rng(1).normal(size=3000)})
    df = spark.createDataFrame(pdf)
    got = ou.tree_samples(df, ["a"], "id", 5, 16, 7).toPandas()
    hashes = df.select("a", *[F.shiftrightunsigned(F.xxhash64(F.lit(7), F.lit(t), "id", "a"), 1).alias(str(t)) for t in range(5)]).toPandas()
    for t in range(5):
        assert got[got.tree == t].sort_values("rank").a.tolist() == hashes.sort_values(str(t)).a.head(16).tolist()


def plain_length(nodes, x):
    n = nodes[0]
    while n[4] >= 0:
        n = nodes[n[4] if x[n[2]] < n[3] else n[5]]
    return n[6]


def test_path_lengths_equal_plain_walks():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 256):
        X = np.round(rng.normal(size=(n, 2)), 1)
        nodes = ou.grow_tree(X, rng)
        P = rng.normal(size=(100, 2))
        frame = pd.DataFrame(nodes, columns=["tree", "node", "col", "cut", "left", "right", "depth"])
        assert ou.path_lengths(frame, P).tolist() == [plain_length(nodes, x) for x in P]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(i, float(i % 7), 1) for i in range(40)] + [(40, None, 2)], "id int, a double, tree int")
    got = {r.id: r.iso_score for r in ou.isolation_scores(df, ["a"], "id", trees=5).collect()}
    assert got[40] is None and all(0 < got[i] < 1 for i in range(40))
    assert ou.isolation_scores(df.limit(0), ["a"], "id", trees=5).isEmpty()
