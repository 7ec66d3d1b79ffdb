"""Exact nearest neighbours on leaves: short runs of features in Z-order, each with a box.

Features are sorted once along a Z-order curve over quantile buckets of their
axes and cut into leaves of bounded size; a run of leaves is a chunk. A point
first searches the chunk of its own place, which bounds its k-th distance, and
then, all at once, those chunks that have a leaf within that bound: two rounds.
Inside a task points are searched in short slices against leaves of the chunk,
nearest first, so a point looks at few features and a chunk gives back no more
than the best of it. Features are stored once, and the driver sees one row per
leaf, `MOST` or so of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from plotwise.operators.ranking import join_on, split_points
from plotwise.session import stage

LEAF, BLOCK, MOST, BITS = 512, 1 << 16, 1 << 14, 8
CHUNK, TASKS = 512, 4  # leaves in a chunk at most, chunks for a core of the session at least
NOOK = 128  # features in a leaf inside a task
SLICE, RUN = 128, 32  # points that choose their leaves together, leaves first looked at as one
WORK = 1 << 20  # numbers in one matrix of distances
EARTH = 6371000.0


class Rows:
    """Columns of numbers by name."""

    def __init__(self, cols: dict[str, np.ndarray]):
        self.cols = cols

    def __len__(self) -> int:
        return len(next(iter(self.cols.values())))

    def __getitem__(self, name: str) -> np.ndarray:
        return self.cols[name]

    def rows(self, at) -> Rows:
        return Rows({n: c[at] for n, c in self.cols.items()})


def arrays(t: pa.Table, names: list[str]) -> Rows:
    return Rows({n: t[n].to_numpy().astype(float) for n in names})


def gaps(p: Rows, lo: np.ndarray, hi: np.ndarray, names: list[str]) -> list[np.ndarray]:
    """Distance of every point to every box, per axis."""
    return [np.maximum(0.0, np.maximum(lo[None, :, i] - x[:, None], x[:, None] - hi[None, :, i])) for i, x in enumerate(p[n] for n in names)]


def grid(x: np.ndarray, y: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Values of points and features that meet all with all, or, if aligned, one with one."""
    return (x, y) if aligned else (x[:, None], y[None, :])


def apart(p: Rows, f: Rows, pcol: str, fcol: str, aligned: bool = False) -> np.ndarray:
    x, y = grid(p[pcol], f[fcol], aligned)
    return y - x


def where_allowed(pairs, measure):
    """`measure` of the pairs that `pairs` allows, infinite for all others."""
    def some(p, f):
        ok = pairs(p, f)
        d = np.full(ok.shape, np.inf)
        r, c = np.nonzero(ok)
        d[r, c] = measure(p.rows(r), f.rows(c), True)
        return d

    return some


def euclid(ps: list[str], fs: list[str]):
    """`measure` and `lower` of the straight distance."""
    def measure(p, f):
        s = np.zeros((len(p), len(f)))
        for a, b in zip(ps, fs):
            s += apart(p, f, a, b) ** 2
        return np.sqrt(s)

    return measure, lambda p, lo, hi: np.sqrt(sum(g * g for g in gaps(p, lo, hi, ps)))


def sphere(lon: str, lat: str, flon: str, flat: str):
    """`measure` of the great-circle distance, and `lower` for boxes whose axes are lon, lat."""
    def measure(p, f, aligned=False):
        x, y = grid(np.radians(p[lat]), np.radians(f[flat]), aligned)
        h = np.sin((y - x) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin(np.radians(apart(p, f, lon, flon, aligned)) / 2) ** 2
        return 2 * EARTH * np.arcsin(np.sqrt(np.minimum(1.0, h)))

    def lower(p, lo, hi):
        x, y = p[lon][:, None], p[lat][:, None]
        dx, dy = gaps(p, lo, hi, [lon, lat])
        # The way round the other side may be the shorter one.
        dx = np.minimum(dx, np.maximum(0.0, 360.0 - np.maximum(np.abs(x - lo[None, :, 0]), np.abs(x - hi[None, :, 0]))))
        least = np.maximum(0.0, np.minimum(np.cos(np.radians(lo[None, :, 1])), np.cos(np.radians(hi[None, :, 1]))))
        h = np.sin(np.radians(dy) / 2) ** 2 + np.maximum(0.0, np.cos(np.radians(y))) * least * np.sin(np.radians(dx) / 2) ** 2
        return 2 * EARTH * np.arcsin(np.sqrt(np.minimum(1.0, h))) * (1 - 1e-9)

    return measure, lower


def spans(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Rows of some leaves, given the first row of every leaf and the end."""
    size = starts[which + 1] - starts[which]
    return np.repeat(starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum())


class Nook:
    """Features of one group in one task, in Z-order and cut into leaves with boxes."""

    def __init__(self, f: Rows, z: np.ndarray, axes: list[str], size: int, run: int):
        self.f, self.z, self.run = f, z, run
        first = np.arange(0, len(z), size)
        self.starts = np.append(first, len(z))
        edge = lambda how, at, of: np.stack([how.reduceat(of(i), at) for i in range(len(axes))], axis=1)
        self.lo, self.hi = edge(np.minimum, first, lambda i: f[axes[i]]), edge(np.maximum, first, lambda i: f[axes[i]])
        some = np.arange(0, len(first), run)
        self.alo, self.ahi = edge(np.minimum, some, lambda i: self.lo[:, i]), edge(np.maximum, some, lambda i: self.hi[:, i])

    def search(self, q: Rows, z: np.ndarray, bound: np.ndarray, k: int, slack: float, measure, lower, work: int):
        """(point, feature) pairs that may be among the k nearest, and the k-th distance of each point or its bound."""
        starts, top, parts = self.starts, np.full((len(q), k), np.inf), []
        cut = lambda: np.minimum(top[:, -1], bound)

        def look(rows: np.ndarray, leaves: np.ndarray) -> None:
            at = spans(starts, leaves)
            f = self.f.rows(at)
            step = max(1, work // len(at))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                d = measure(q.rows(r), f)
                better = np.flatnonzero((d < top[r, -1:]).any(1))
                both = np.concatenate([top[r[better]], d[better]], axis=1)
                top[r[better]] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
                x, y = np.nonzero((d <= cut()[r, None] + slack) & np.isfinite(d))
                parts.append((r[x], at[y], d[x, y]))

        home = np.unique((np.searchsorted(self.z, z, side="right") - 1).clip(0) // (starts[1] - starts[0]))
        look(np.arange(len(q)), home)
        b = lower(q, self.alo, self.ahi)
        runs = np.flatnonzero((np.isfinite(b) & (b <= cut()[:, None] + slack)).any(0))
        near = np.setdiff1d(spans(np.append(np.arange(0, len(starts) - 1, self.run), len(starts) - 1), runs), home)
        b = lower(q, self.lo[near], self.hi[near])
        b = np.where(b <= cut()[:, None] + slack, b, np.inf)
        order = np.argsort(b.min(0), kind="stable") if len(near) else near
        near, b = near[order], b[:, order]
        i, step = 0, 4
        while i < len(near):
            need = np.isfinite(b[:, i : i + step]) & (b[:, i : i + step] <= cut()[:, None] + slack)
            rows, leaves = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0))
            if len(rows):
                look(rows, near[i + leaves])
            i, step = i + step, min(64, step * 2)
        r, c, d = (np.concatenate([x[i] for x in parts]) for i in range(3))
        ok = d <= cut()[r] + slack
        return r[ok], c[ok], cut()


class Leaves:
    """Features cut into leaves. `axes` are numeric columns of the features, `by` columns have to agree with a point's."""

    def __init__(self, features: DataFrame, axes: list[str], fid: str, by: list[str] = ()):
        self.by, self.axes, self.fid = list(by), list(axes), fid
        d = features.dropna(subset=[*axes, *self.by]).select(*self.by, fid, *[F.col(a).cast("double").alias(a) for a in axes])
        # Equal rows are one feature that counts `_m` times.
        d = stage(d.groupBy(*d.columns).agg(F.count("*").alias("_m")), "features")
        self.types = dict(d.dtypes)
        total = d.count()
        leaf = LEAF
        while total > leaf * MOST:
            leaf *= 2
        self.leaf, self.cores = leaf, features.sparkSession.sparkContext.defaultParallelism
        chunk = leaf * max(1, min(CHUNK * LEAF, total // (TASKS * self.cores)) // leaf)
        self.cuts = split_points(d, axes, 1 << BITS) if total else [[] for _ in axes]
        d = d.withColumns({"_g": self.group(), "_z": self.place(axes)})
        d = d.repartitionByRange("_g", "_z", *axes).sortWithinPartitions("_g", "_z", *axes)
        number = F.monotonically_increasing_id()
        self.table = stage(d.withColumns({"_leaf": F.floor(number / leaf).cast("long"), "_chunk": F.floor(number / chunk).cast("long")}), "leaves")
        ends = [e for a in axes for e in (F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}"))]
        box = self.table.groupBy("_leaf", "_chunk").agg(F.min(F.struct("_g", "_z")).alias("_s"), F.max("_g").alias("_e"), F.count("*").alias("n"), *ends)
        box = box.select("_leaf", "_chunk", "_s.*", "_e", "n", *[f"{e}_{a}" for a in axes for e in ("lo", "hi")]).toPandas()  # a row a leaf
        self.boxes = box.sort_values(["_g", "_z", "_leaf"]).reset_index(drop=True)

    def same_id(self) -> int:
        """How many different features of a group share one id at most."""
        return self.table.where(F.col(self.fid).isNotNull()).groupBy(*self.by, self.fid).count().agg(F.max("count")).first()[0] or 0

    def group(self) -> Column:
        return F.xxhash64(*self.by) if self.by else F.lit(0).cast("long")

    def place(self, cols: list[str]) -> Column:
        """Z-order code of a row over the features' quantile buckets."""
        cuts = [np.array(c) for c in self.cuts]

        def code(*axes: pd.Series) -> pd.Series:
            z = np.zeros(len(axes[0]), np.int64)
            for i, (x, c) in enumerate(zip(axes, cuts)):
                at = np.searchsorted(c, x.to_numpy(float), side="right")
                for b in range(BITS + 1):
                    z |= (at >> b & 1) << (b * len(axes) + i)
            return pd.Series(z)

        return F.pandas_udf(code, "long")(*cols)

    def nearest(self, points: DataFrame, cols: list[str], k: int, *, measure, lower, dist, slack: float, where=None, most: float = np.inf) -> DataFrame:
        """`points` with `_near`, their k nearest features as an array of (dist, id, _m) in that order.

        `points` holds distinct rows of `by` and numeric columns, with the first
        columns `cols` in place of the axes. `dist` and `where` decide in Spark:
        they get a function from a name to the column of the point or the axis.
        `measure` gives the same distances for arrays, infinite for excluded
        pairs, and `lower` a bound for boxes; `slack` covers the rounding of
        `dist`. No answer is farther than `most`.
        """
        by, axes, fid, boxes = self.by, self.axes, self.fid, self.boxes
        spark = points.sparkSession
        kinds = dict(points.dtypes)
        nums = [c for c in points.columns if c not in by]
        found = f"array<struct<`{fid}`:{self.types[fid]},_m:bigint,{','.join(f'`{a}`:double' for a in axes)}>>"
        near = f"array<struct<dist:double,id:{self.types[fid]},_m:bigint>>"
        if not len(boxes):
            return points.where("false").withColumn("_near", F.array().cast(near))
        shared = spark.sparkContext.broadcast((boxes["_leaf"].to_numpy(), boxes["_chunk"].to_numpy(), boxes["_g"].to_numpy(), boxes["_z"].to_numpy(), boxes["_e"].to_numpy(),
                                               boxes[[f"lo_{a}" for a in axes]].to_numpy(float), boxes[[f"hi_{a}" for a in axes]].to_numpy(float)))
        small, run, cut, work = min(NOOK, LEAF), RUN, SLICE, WORK
        keys = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"`{c}` double" for c in nums], "_g long, _z long, _chunk long, _b double"])
        names = [*by, *nums, "_g", "_z", "_chunk", "_b"]

        def own(g: pa.Array, z: pa.Array) -> np.ndarray:
            """Chunk at the place of each point."""
            _, chunk, bg, bz, *_ = shared.value
            order = np.lexsort((np.r_[np.zeros(len(bg)), np.ones(len(g))], np.r_[bz, z], np.r_[bg, g]))
            at = np.empty(len(order), int)
            at[order] = np.cumsum(order < len(bg)) - 1
            return chunk[np.maximum(at[len(bg):], 0)]

        def meeting(carry: list[str], schema: str):
            """Points of one block against the features of one chunk: the points with `_b`, the least k-th distance known, and `_c`, what may be an answer."""
            target = to_arrow_schema(_parse_datatype_string(schema))

            def meet(a: pa.Table, b: pa.Table) -> pa.Table:
                b = b.take(pa.array(np.lexsort((b["_z"].to_numpy(), b["_g"].to_numpy()))))
                a = a.take(pc.sort_indices(a, [(c, "ascending") for c in ("_g", "_z", *axes, fid)], null_placement="at_start"))
                g, z, f = a["_g"].to_numpy(), a["_z"].to_numpy(), arrays(a, axes)
                # Of features in one spot only the k smallest ids can be answers.
                new = np.r_[True, g[1:] != g[:-1]][: len(g)]
                for n in axes:
                    new[1:] |= f[n][1:] != f[n][:-1]
                place = np.arange(len(g))
                few = np.flatnonzero(place - np.maximum.accumulate(np.where(new, place, 0)) < k)
                g, z, f = g[few], z[few], f.rows(few)
                pg, pz, p, bound = b["_g"].to_numpy(), b["_z"].to_numpy(), arrays(b, nums), b["_b"].to_numpy().copy()
                got = [(np.zeros(0, int), np.zeros(0, int))]
                for group in np.unique(pg):
                    lo, hi = np.searchsorted(g, [group, group + 1]) if group < np.iinfo(np.int64).max else (np.searchsorted(g, group), len(g))
                    if lo == hi:
                        continue
                    nook = Nook(f.rows(slice(lo, hi)), z[lo:hi], axes, small, run)
                    first, last = np.searchsorted(pg, group), np.searchsorted(pg, group, side="right")
                    for i in range(first, last, cut):
                        part = slice(i, min(last, i + cut))
                        r, c, bound[part] = nook.search(p.rows(part), pz[part], bound[part], k, slack, measure, lower, work)
                        got.append((r + i, c + lo))
                r, c = (np.concatenate(x) for x in zip(*got))
                order = np.argsort(r, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(pg)))]).astype(np.int32)
                kind = target.field("_c").type
                hits = a.select([fid, "_m", *axes]).take(pa.array(few[c[order]])).combine_chunks()
                flat = pa.StructArray.from_arrays([one(hits[x.name]).cast(x.type) for x in kind.value_type], fields=list(kind.value_type))
                cols = {c: one(b[c]) for c in carry} | {"_b": pa.array(bound), "_c": pa.ListArray.from_arrays(pa.array(ends), flat, type=kind)}
                return pa.Table.from_arrays([cols[x.name] for x in target], schema=target)

            return meet

        def searched(p: DataFrame, carry: list[str], schema: str) -> DataFrame:
            asked = p.groupBy("_chunk").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_qb"))
            right = p.join(asked, "_chunk").withColumn("_q", F.pmod(F.xxhash64(*nums), F.col("_qb")).cast("int")).drop("_qb")
            left = self.table.join(asked, "_chunk").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qb") - 1))).select("_chunk", "_q", "_g", "_z", fid, "_m", *axes)
            return left.groupBy("_chunk", "_q").cogroup(right.groupBy("_chunk", "_q")).applyInArrow(meeting(carry, schema), schema)

        visited = f"_p long, {keys}, _c {found}"
        target = to_arrow_schema(_parse_datatype_string(visited))

        def visits(batches):
            """A row for every other chunk with a leaf in reach of a point; the first of them holds what was found, as does the only row of a settled point, which has no chunk."""
            leaf, chunk, g, _, e, lo, hi = shared.value
            starts = np.arange(0, len(leaf), run)
            ag, ae, alo, ahi = np.minimum.reduceat(g, starts), np.maximum.reduceat(e, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
            for batch in batches:
                p, gs, mine, bound = arrays(batch, nums), batch["_g"].to_numpy(), batch["_chunk"].to_numpy(), batch["_b"].to_numpy()
                for i in range(0, len(gs), cut):
                    # Points of a slice lie together, so most runs of leaves are too far for all of them.
                    t = slice(i, min(len(gs), i + cut))
                    q, reach = p.rows(t), bound[t, None] + slack
                    runs = np.flatnonzero((ae >= gs[t].min()) & (ag <= gs[t].max()))
                    b = lower(q, alo[runs], ahi[runs])
                    near = np.flatnonzero(np.isin(np.arange(len(leaf)) // run, runs[(np.isfinite(b) & (b <= reach)).any(0)]))
                    b = lower(q, lo[near], hi[near])
                    ok = np.isfinite(b) & (b <= reach) & (g[near][None, :] <= gs[t, None]) & (e[near][None, :] >= gs[t, None]) & (chunk[near][None, :] != mine[t, None])
                    r, c = np.nonzero(ok)
                    pairs = np.unique(np.stack([r, chunk[near[c]]], axis=1), axis=0) if len(r) else np.zeros((0, 2), int)
                    rest = np.setdiff1d(np.arange(len(q)), pairs[:, 0])
                    row, to = np.concatenate([pairs[:, 0], rest]), np.concatenate([pairs[:, 1], np.zeros(len(rest), int)])
                    again = np.r_[False, row[1:] == row[:-1]]
                    out = batch.slice(i, len(q)).take(pa.array(row))
                    cols = {n: out[n] for n in ("_p", *names, "_c")}
                    cols["_chunk"] = pa.array(to, mask=np.arange(len(row)) >= len(pairs))
                    cols["_c"] = batch["_c"].slice(i, len(q)).take(pa.array(row, mask=again))
                    yield pa.RecordBatch.from_arrays([cols[x.name].cast(x.type) for x in target], schema=target)

        p = points.dropna(subset=[*cols, *by]).select(*by, *[F.col(c).cast("double").alias(c) for c in nums])
        p = p.withColumns({"_g": self.group(), "_z": self.place(cols)})
        home = F.pandas_udf(lambda g, z: pd.Series(own(g, z)), "long")
        p = stage(p.withColumns({"_chunk": home("_g", "_z"), "_b": F.lit(float(most))}), "points")
        first = searched(p, [*by, *nums, "_g", "_z", "_chunk"], f"{keys}, _c {found}").withColumn("_p", F.monotonically_increasing_id())
        first = stage(first.select("_p", *names, "_c").mapInArrow(visits, visited), "found")
        open_, done = first.where("_chunk is not null"), first.where("_chunk is null")
        got = done.select(*by, *nums, "_c")
        if not open_.isEmpty():
            more = searched(open_.drop("_c"), ["_p", *by, *nums, "_g", "_z", "_chunk"], visited)
            both = open_.select("_p", *by, *nums, "_c").unionByName(more.select("_p", *by, *nums, "_c"))
            got = got.unionByName(both.groupBy("_p", *by, *nums).agg(F.flatten(F.collect_list("_c")).alias("_c")).drop("_p"))
        at = lambda x: lambda name: x[name] if name in axes else F.col(name)
        hits = F.col("_c") if where is None else F.filter("_c", lambda x: where(at(x)))
        hits = F.transform(hits, lambda x: F.struct(dist(at(x)).alias("dist"), x[fid].alias("id"), x["_m"].alias("_m")))
        hits = hits if most == np.inf else F.filter(hits, lambda x: x["dist"] <= most)
        got = got.withColumn("_near", F.slice(F.sort_array(hits), 1, k)).where(F.size("_near") > 0)
        return got.select(*[F.col(c).cast(kinds[c]).alias(c) for c in points.columns], F.col("_near").cast(near).alias("_near"))


def one(column) -> pa.Array:
    """The column of a table as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def take(rows: DataFrame, near: DataFrame, keys: list[str], ident: str, k: int, fid: str, other: bool) -> DataFrame:
    """ident, keys, `fid`, dist, rn: the first k of `_near` for every row; with `other`, features of the row's own id are left out.

    Equal rows count as often as they occur, on both sides, as in a join.
    """
    d = join_on(rows.groupBy(*dict.fromkeys([ident, *keys])).agg(F.count("*").alias("_s")), near, [c for c in keys if c != ident])
    own = F.filter("_near", lambda x: x["id"] != F.col(ident)) if other else F.col("_near")
    times = lambda x: F.least(x["_m"] * F.col("_s"), F.lit(k)).cast("int")
    each = F.slice(F.flatten(F.transform(own, lambda x: F.array_repeat(x, times(x)))), 1, k)
    d = d.select(*dict.fromkeys([ident, *keys]), F.posexplode(each).alias("rn", "_x"))
    return d.select(*dict.fromkeys([ident, *keys]), F.col("_x.id").alias(fid), F.col("_x.dist").alias("dist"), (F.col("rn") + 1).alias("rn"))
