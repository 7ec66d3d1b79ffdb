"""Least squares from sufficient statistics.

One distributed aggregate yields the cross-product matrix of a handful of
columns per group; everything after that is p-by-p algebra (p is at most a few
dozen), on the executors for groups of any number, on the driver for a few.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GROUPS = 5000


@dataclass
class Fit:
    y: str
    xs: list[str]
    coef: dict[str, float]
    intercept: float
    n: float
    ssr: float
    sst: float
    k: int = field(init=False)

    def __post_init__(self):
        self.k = len(self.xs)

    @property
    def r2(self):
        return 1 - self.ssr / self.sst if self.sst > 0 else 0.0

    @property
    def r2_adj(self):
        return 1 - (1 - self.r2) * (self.n - 1) / max(self.n - self.k - 1, 1)

    @property
    def loglik(self):
        s2 = self.ssr / self.n
        return -0.5 * self.n * (math.log(2 * math.pi) + math.log(s2) + 1) if s2 > 0 else float("nan")

    @property
    def aic(self):
        return -2 * self.loglik + 2 * (self.k + 2)

    @property
    def bic(self):
        return -2 * self.loglik + (self.k + 2) * math.log(self.n)

    def predict(self) -> Column:
        return reduce(lambda a, b: a + b, [F.col(x).cast("double") * float(c) for x, c in self.coef.items()], F.lit(float(self.intercept)))


@dataclass
class Gram:
    """Count, sums and cross products of columns shifted by `shift`."""

    names: list[str]
    shift: np.ndarray
    n: float
    s: np.ndarray
    S: np.ndarray

    def __add__(self, o):
        return Gram(self.names, self.shift, self.n + o.n, self.s + o.s, self.S + o.S)

    def __sub__(self, o):
        return Gram(self.names, self.shift, self.n - o.n, self.s - o.s, self.S - o.S)

    def idx(self, names):
        return [self.names.index(x) for x in names]

    def mean(self, names=None):
        m = self.shift + self.s / self.n
        return m if names is None else m[self.idx(names)]

    def cross(self, names=None):
        """Centred cross products."""
        C = self.S - np.outer(self.s, self.s) / self.n
        if names is None:
            return C
        i = self.idx(names)
        return C[np.ix_(i, i)]

    def cov(self, names=None, ddof=1):
        return self.cross(names) / (self.n - ddof)

    def corr(self, names=None):
        C = self.cross(names)
        d = np.sqrt(np.diag(C))
        d[d == 0] = np.nan
        R = C / np.outer(d, d)
        np.fill_diagonal(R, 1.0)
        return R

    def fit(self, y: str, xs: list[str]) -> Fit:
        C = self.cross([y, *xs])
        b = solve(C[1:, 1:], C[1:, 0])
        ssr = max(C[0, 0] - float(b @ C[1:, 0]), 0.0)
        m = self.mean([y, *xs])
        return Fit(y, list(xs), dict(zip(xs, map(float, b))), float(m[0] - b @ m[1:]), self.n, ssr, float(C[0, 0]))

    def sse(self, y: str, xs: list[str], b: np.ndarray, a: float) -> float:
        """Squared error of a given linear model on this data."""
        i = self.idx([y, *xs])
        v = np.concatenate([[1.0], -np.asarray(b)])
        sh = self.shift[i]
        c = float(v @ sh) - a
        return float(v @ self.S[np.ix_(i, i)] @ v + 2 * c * (v @ self.s[i]) + self.n * c * c)


def solve(A: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Minimum-norm solution on the scaled system, so collinear columns are shared out."""
    if not len(c):
        return np.zeros(0)
    d = np.sqrt(np.maximum(np.diag(A), 0))
    d[d == 0] = 1.0
    w, V = np.linalg.eigh(A / np.outer(d, d))
    keep = w > 1e-10 * max(w.max(), 1e-300)
    return (V[:, keep] @ ((V[:, keep].T @ (c / d)) / w[keep])) / d


FLUSH = 20_000  # groups a task holds before it passes their sums on


@dataclass
class GroupGrams:
    """Cross products of any number of groups: a table (by..., v), read group by group on the executors."""

    names: list[str]
    by: list[str]
    shift: np.ndarray
    table: DataFrame

    def gram(self, v) -> Gram:
        p, v = len(self.names), np.asarray(v, dtype=float)
        S = np.zeros((p, p))
        S[np.triu_indices(p)] = v[1 + p :]
        return Gram(list(self.names), self.shift, float(v[0]), v[1 : 1 + p], S + S.T - np.diag(np.diag(S)))

    def rows(self, fn, schema: str) -> DataFrame:
        """`fn(key, gram)` gives the rows (tuples) of one group."""
        by, names = self.by, [f.split()[0] for f in schema.split(", ")]
        me = GroupGrams(self.names, self.by, self.shift, None)

        def run(batches):
            import pandas as pd

            for pdf in batches:
                keys = list(zip(*[pdf[b] for b in by])) if by else [()] * len(pdf)
                out = [r for k, v in zip(keys, pdf["v"]) for r in fn(k, me.gram(v))]
                yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

        return self.table.mapInPandas(run, schema)

    def fits(self, y: str, xs: list[str]) -> DataFrame:
        """by..., n, ssr, sst, intercept, coef (in the order of xs): one least-squares fit per group."""
        types = dict(self.table.dtypes)
        schema = ", ".join([f"{b} {types[b]}" for b in self.by] + ["n double", "ssr double", "sst double", "intercept double", "coef array<double>"])

        def one(key, g):
            f = g.fit(y, xs)
            return [(*key, f.n, f.ssr, f.sst, f.intercept, [f.coef[x] for x in xs])]

        return self.rows(one, schema)


def group_grams(df: DataFrame, names: list[str], by: list[str] = ()) -> GroupGrams:
    """Cross-product statistics per group over complete rows.

    Every task multiplies its Arrow batches into one matrix per group and emits a
    single row for each; Spark adds those up by key. Columns are shifted by their
    overall means first, which keeps the sums small. Rows without a group are left
    out. The number of groups has no bound: nothing per group reaches the driver.
    """
    by, p = list(by), len(names)
    d = df.select(*by, *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(names)])
    row = d.agg(*[F.avg(F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))).alias(f"x{i}") for i in range(p)]).first()
    shift = np.array([m if m is not None else 0.0 for m in row])
    cols, (iu, ju) = [f"x{i}" for i in range(p)], np.triu_indices(p)

    def partial(batches):
        import pandas as pd

        def out(acc):
            t = pd.DataFrame(list(acc), columns=by) if by else pd.DataFrame(index=range(1))
            t["v"] = list(acc.values())
            return t

        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            # Incomplete rows are dropped here: null filters on many derived columns are slow to plan.
            pdf = pdf.dropna()
            if not len(pdf):
                continue
            Z = pdf[cols].to_numpy(dtype=float) - shift
            groups = list(pdf.groupby(by, sort=False).indices.items()) if by else [((), slice(None))]
            if not by or len(groups) * 16 <= len(Z):
                sums = [np.concatenate([[len(z)], z.sum(0), (z.T @ z)[iu, ju]]) for z in (Z[at] for _, at in groups)]
            else:  # many small groups: products of all rows, added up in runs
                order = np.concatenate([at for _, at in groups])
                starts = np.cumsum([0] + [len(at) for _, at in groups[:-1]])
                z = Z[order]
                sums = np.add.reduceat(np.hstack([np.ones((len(z), 1)), z, z[:, iu] * z[:, ju]]), starts)
            for (k, _), v in zip(groups, sums):
                k = k if isinstance(k, tuple) else (k,)
                acc[k] = acc[k] + v if k in acc else v
            if len(acc) > FLUSH:
                yield out(acc)
                acc = {}
        if acc:
            yield out(acc)

    types = dict(d.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["v array<double>"])
    width = 1 + p + len(iu)
    parts = d.mapInPandas(partial, schema)
    sums = parts.groupBy(*by).agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
    return GroupGrams(list(names), by, shift, sums.where(F.get("v", F.lit(0)).isNotNull()))


def grams(df: DataFrame, names: list[str], by: list[str] = ()) -> dict[tuple, Gram]:
    """The same on the driver, for folds, blocks and other groups that are few by nature; their number is checked."""
    by = list(by)
    g = group_grams(df, names, by)
    rows = g.table.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups; read them with group_grams")
    return {tuple(r[b] for b in by): g.gram(r["v"]) for r in rows}


def gram(df: DataFrame, names: list[str]) -> Gram:
    return grams(df, names)[()]


def total(parts) -> Gram:
    return reduce(lambda a, b: a + b, parts)


REPORT = "section string, item string, value double, label string"


def report(spark, rows) -> DataFrame:
    """Small result table: (section, item, value or None, label or None)."""
    def clean(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6)

    data = [(str(a), str(b), clean(c) if not isinstance(c, str) else None, c if isinstance(c, str) else None) for a, b, c in rows]
    return spark.createDataFrame(data, REPORT)


def report_rows(stats: GroupGrams, fn) -> DataFrame:
    """The same table from every group on the executors; `fn(key, gram)` gives (item, value) pairs."""

    def rows(key, g):
        name = "/".join(map(str, key)) or "all"
        return [(name, str(i), None if x is None or math.isnan(x) else round(float(x), 6), None) for i, x in fn(key, g)]

    return stats.rows(rows, REPORT)


def hash_unit(*parts: Column) -> Column:
    """Reproducible uniform number in [0, 1) from the md5 of the parts."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_fold(key: Column, k: int, seed: int = 42) -> Column:
    return F.floor(hash_unit(F.lit(seed), key) * k).cast("int")
