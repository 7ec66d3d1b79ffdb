"""Exact centroid clustering over integers with a vantage-point tree.

Components become integers, so that assignments, sums and means are exact and
every run gives the same result. In each round a vantage-point tree over the
centroids is rebuilt and broadcast (k centroids, a parameter). Every vector
walks it best-first: it opens the node with the smallest lower bound, compares
itself with that node's centroids in exact integers, and stops once no open
node's bound is within its best distance. That radius is inclusive, so a
centroid just as near is always met, and the smaller number wins. A batch of
vectors takes its steps together; each keeps bounds of its own.

Tasks add up their members per centroid, and Spark the tasks' sums: the driver
sees k sums a round, never vectors. No vectors are shuffled, so copies of one
vector, however many, are no hot group.

Kept are vectors of exactly `dim` components, none of them null, non-finite or
beyond 2^53 once multiplied. Vectors with equal hashes (repeated ids) start in
the order of their components; a null id is hashed as no digits. Fewer vectors
than k give fewer centroids, an empty table an empty result. A distance or sum
beyond 64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import batches
from plotwise.session import stage

K, ROUNDS, DIM, SCALE, SEED, LEAF = 8, 10, 64, 1024, "3:", 2
EXACT = 2.0**22  # up to here sums of 64 squares of differences are exact in doubles
SLACK = 1e-9  # relative, for the square roots in bounds
CELLS = 1 << 22  # bounds held at once for a batch


class Tree:
    """Vantage-point tree over integer centroids, numbered as given."""

    def __init__(self, centroids: list[list[int]], leaf: int = LEAF):
        self.c = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        self.small = bool((abs(self.c) <= EXACT).all()) and self.c.shape[1] <= DIM
        self.flat = self.c.astype(np.float64)
        self.nodes: list[tuple] = []  # (centroids to compare, [(child, nearest, farthest member)])
        self.grow(list(range(len(centroids))), leaf)

    def grow(self, items: list[int], leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((items, []))
        if len(items) > leaf + 1:
            top, rest = items[0], items[1:]
            d = np.sqrt(((self.c[rest] - self.c[top]) ** 2).sum(1).astype(np.float64))
            order, half = np.argsort(d, kind="stable"), len(rest) // 2
            parts = [(self.grow([rest[i] for i in part], leaf), d[part].min(), d[part].max()) for part in (order[:half], order[half:])]
            self.nodes[at] = ([top], parts)
        return at

    def squares(self, x: np.ndarray, items: list[int]) -> np.ndarray:
        """Exact squared distances of integer-valued rows to some centroids."""
        if self.small and np.abs(x).max(initial=0) <= EXACT:
            c = self.flat[items]
            return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        big = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
        return np.stack([((big - self.c[i]) ** 2).sum(1) for i in items], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Number of the nearest centroid and the squared distance to it, for integer-valued rows."""
        size, at, far = max(1, CELLS // len(self.nodes)), [np.zeros(0, np.int64)], []
        for i in range(0, len(x), size):
            k, d = self.walk(x[i : i + size])
            at.append(k)
            far += [int(v) for v in d]
        return np.concatenate(at), far

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(x))
        bounds = np.full((len(x), len(self.nodes)), np.inf)
        bounds[:, 0] = 0
        exact = self.small and np.abs(x).max(initial=0) <= EXACT
        best, mine = np.full(len(x), np.inf, np.float64 if exact else object), np.full(len(x), len(self.c))
        while len(rows):
            node = bounds[rows, :].argmin(1)
            bound = bounds[rows, node]
            open_ = (bound < np.inf) & (bound <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK))
            rows, node, bound = rows[open_], node[open_], bound[open_]
            bounds[rows, node] = np.inf
            for j in np.unique(node):
                here = node == j
                r, low = rows[here], bound[here]
                items, parts = self.nodes[j]
                d = self.squares(x[r], items)
                for col, k in enumerate(items):
                    better = (d[:, col] < best[r]) | ((d[:, col] == best[r]) & (k < mine[r]))
                    best[r[better]], mine[r[better]] = d[better, col], k
                top = np.sqrt(d[:, 0].astype(np.float64))
                for child, near, most in parts:
                    gap = np.maximum(top - most, near - top) - SLACK * (top + most)
                    bounds[r, child] = np.maximum(low, gap)
        return mine, best


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): the kept vectors, with whole numbers as doubles."""
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < 2.0**53))
    kept = vectors.where((F.size("embedding") == dim) & F.coalesce(fine, F.lit(False))).select("vec_id", "embedding")

    def whole(b):
        x = np.floor(matrix(b["embedding"], dim) * scale)
        return {"vec_id": b["vec_id"], "vec": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, x.ravel())}

    return batches(kept, whole, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, vec array<double>")


def start(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    ident = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    first = kept.select(F.sha2(F.concat(F.lit(seed), ident), 256).alias("h"), "vec").orderBy("h", "vec").limit(k)
    return [[int(v) for v in r.vec] for r in first.collect()]


def means(kept: DataFrame, tree: Tree, dim: int) -> dict[int, list[int]]:
    """Floored mean of every non-empty centroid's members."""
    held = kept.sparkSession.sparkContext.broadcast(tree)  # k centroids

    def add(it):
        total, n = {}, {}
        for b in it:
            x = matrix(b["vec"], dim)
            if not len(x):
                continue
            at, _ = held.value.nearest(x)
            for k in np.unique(at).tolist():
                part = x[at == k]
                if np.abs(part).max() * len(part) < 2.0**53:
                    part = part.sum(0)[None]
                total[k] = [t + sum(int(v) for v in c) for t, c in zip(total.get(k, [0] * dim), part.T)]
                n[k] = n.get(k, 0) + int((at == k).sum())
        rows = [{"k": k, "n": n[k], "total": [Decimal(t) for t in total[k]]} for k in total]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))]))

    sums = kept.select("vec").mapInArrow(add, "k int, n long, total array<decimal(38,0)>").select("k", "n", F.posexplode("total").alias("at", "part"))
    got = sums.groupBy("k", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()  # k * dim rows
    out = {r.k: [0] * dim for r in got}
    for r in got:
        out[r.k][r.at] = int(r.total) // r.n
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector."""
    spark = vectors.sparkSession
    kept = stage(integers(vectors, dim, scale), "centroid-vectors")
    centroids = start(kept, k, seed)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        new = means(kept, Tree(centroids), dim)
        centroids = [new.get(i, c) for i, c in enumerate(centroids)]
    tree = spark.sparkContext.broadcast(Tree(centroids))

    def assign(b):
        at, far = tree.value.nearest(matrix(b["vec"], dim))
        return {"vec_id": b["vec_id"], "cluster": at.astype(np.int32), "distance": [d if d < 2**63 else None for d in far]}

    done = stage(batches(kept, assign, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), "centroid-members")
    # A sum is null where one of its distances is.
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.total for r in done.groupBy("cluster").agg(whole.alias("total")).collect()}  # k rows
    fits = lambda v: int(v) if v is not None and v < 2**63 else None
    total = fits(sum(sums.values())) if None not in sums.values() else None
    table = spark.createDataFrame([(i, fits(sums.get(i)), total, digest(c)) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
