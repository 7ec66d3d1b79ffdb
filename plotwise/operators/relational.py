"""Joins, set operations, top-k and feeds with the reference's semantics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.session import stage


def name_join(a: DataFrame, b: DataFrame, a_name: str, b_name: str, how: str = "inner") -> DataFrame:
    """Join on names regardless of case, accents and spacing."""
    from plotwise.functions.text import fold

    l = a.withColumn("_nk", fold(F.col(a_name)))
    r = b.withColumn("_nk", fold(F.col(b_name)))
    return l.join(r, "_nk", how).drop("_nk")


def having_all(df: DataFrame, rows: DataFrame, key: str, name: str, wanted: list[str]) -> DataFrame:
    """Rows of `df` whose key has every wanted name."""
    ok = rows.where(F.col(name).isin(wanted)).groupBy(key).agg(F.count_distinct(name).alias("_k")).where(F.col("_k") == len(wanted))
    return df.join(ok, key, "left_semi")


def weight_in_boxes(x: np.ndarray, y: np.ndarray, w: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
    """Summed weight of the points in every closed box (x low, x high, y low, y high).

    Points in order of x are cut into blocks of 1, 2, 4, ...; a range of x is at
    most two blocks a level, and in a block sorted by y a range is two lookups.
    """
    out = np.zeros(len(box[0]), np.int64)
    n = len(x)
    by_x = np.argsort(x, kind="stable")
    xs, ys, rank = x[by_x], np.sort(y), np.searchsorted(np.sort(y), y[by_x])
    left, right = np.searchsorted(xs, box[0], "left"), np.searchsorted(xs, box[1], "right")
    low, high = np.searchsorted(ys, box[2], "left"), np.searchsorted(ys, box[3], "right")
    block = np.arange(n)
    while (left < right).any():
        key = block * (n + 1) + rank
        order = np.argsort(key, kind="stable")
        key, total = key[order], np.r_[0, np.cumsum(w[by_x][order])]
        for at, take in ((left, (left < right) & (left % 2 == 1)), (right - 1, (left < right) & (right % 2 == 1))):
            q = np.flatnonzero(take)
            ends = [np.searchsorted(key, at[q] * (n + 1) + r[q], "left") for r in (low, high)]
            out[q] += np.where(high[q] > low[q], total[ends[1]] - total[ends[0]], 0)
        left, right, block = (left + 1) // 2, right // 2, block // 2
    return out


def band_counts(subjects: DataFrame, others: DataFrame, by: list[str], bands: dict[str, float]) -> DataFrame:
    """For each subject, how many others of the same group lie within relative bands of both measures.

    The two measures are cut into logarithmic bins four bands wide, so a row
    meets two neighbouring bins a measure at most; equal rows are collapsed
    first. A bin's rows are counted in its task by blocks of powers of two, so no
    pair of rows is looked at.
    """
    (x, wx), (y, wy) = bands.items()
    names = [x, y]
    s = subjects.where(reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names]))
    o = others.where(reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names])).dropna(subset=by).groupBy(*by, *names).agg(F.count("*").alias("_m"))
    spots = s.select(*by, *names).dropna(subset=by).distinct()
    # |x'/x - 1| <= w  implies  |ln x' - ln x| <= -ln(1 - w)
    width = {n: -math.log(1 - w) * 1.000001 for n, w in bands.items()}
    cell = lambda n, off=0: F.floor((F.ln(F.col(n).cast("double")) + off * width[n]) / (4 * width[n]))
    spots = spots.withColumns({f"_b{n}": cell(n) for n in names})
    for n in names:
        o = o.withColumn(f"_b{n}", F.explode(F.sequence(cell(n, -1), cell(n, 1))))
    keys = by + [f"_b{n}" for n in names]

    o = o.withColumnsRenamed({c: f"_o{c}" for c in [*keys, *names]})

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p, q = a[x].to_numpy(float), a[y].to_numpy(float)
        hits = weight_in_boxes(b[f"_o{x}"].to_numpy(float), b[f"_o{y}"].to_numpy(float), b["_m"].to_numpy(), [p * (1 - wx), p * (1 + wx), q * (1 - wy), q * (1 + wy)])
        return a[[*by, *names]].assign(matches=hits)

    types = dict(spots.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in [*by, *names]) + ", matches long"
    hits = spots.groupBy(*keys).cogroup(o.groupBy(*[f"_o{c}" for c in keys])).applyInPandas(count, schema)
    return s.join(stage(hits, "band-counts"), by + names, "left").fillna(0, ["matches"])


def set_difference_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def top_overlap(df: DataFrame, ident: str, a: str, b: str, k: int) -> DataFrame:
    """How many of the k best by `a` are also among the k best by `b`."""
    best = lambda x: df.orderBy(F.col(x).desc_nulls_last(), ident).limit(k).select(ident)
    return best(a).join(best(b), ident, "left_semi").agg(F.count("*").alias("overlap"))


def repeatable_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows in pseudo-random order of the key; the same rows on every run."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def weighted_best(df: DataFrame, weights: dict[str, float], where: Column | None, k: int, ident: str = "id") -> DataFrame:
    """Best rows by a caller-given weighted sum; missing values count as zero."""
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) * F.lit(float(w)) for n, w in weights.items()])
    d = df if where is None else df.where(where)
    return d.withColumn("weighted", score).orderBy(F.desc("weighted"), ident).limit(k)


def activity_feed(sources: dict[str, tuple[DataFrame, str, list[str]]], k: int = 50) -> DataFrame:
    """Newest k entries over several event tables, aligned to (type, at, detail)."""
    parts = [d.select(F.lit(n).alias("type"), F.col(ts).alias("at"), F.to_json(F.struct(*cols)).alias("detail"))
             .orderBy(F.desc("at"), "detail").limit(k) for n, (d, ts, cols) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("at"), "type", "detail").limit(k)


def zone_ranks(df: DataFrame, measures: list[str]) -> DataFrame:
    """Descending rank per measure over an already aggregated zone table (one row per zone)."""
    return df.withColumns({f"rank_{m}": F.rank().over(Window.partitionBy().orderBy(F.col(m).desc_nulls_last())) for m in measures})


def last_turns(turns: DataFrame, session: list[str], order: str, n: int) -> DataFrame:
    """Newest n turns per session; trimmed before the shuffle by Spark's window group limit."""
    w = Window.partitionBy(*session).orderBy(F.desc(order))
    return turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_ids(df: DataFrame, session: list[str], ident: str, order: str, n: int) -> DataFrame:
    """Newest n distinct ids per session, in order of their latest use."""
    last = df.groupBy(*session, ident).agg(F.max(order).alias("_o"))
    w = Window.partitionBy(*session).orderBy(F.desc("_o"), ident)
    top = last.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(*session).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", ident))), lambda x: x[ident]).alias("ids"))


def lag_by_time(df: DataFrame, key: str, ts: str, order: list[str], cols: list[str]) -> DataFrame:
    """Previous values per key without sorting a whole key in one task.

    Rows are windowed per key and day; the first row of a day takes the last row
    of the key's previous day, found on a table of one row per key and day.
    Adds `prev_<col>` and `is_first`.
    """
    d = df.withColumn("_day", F.to_date(ts))
    o = F.struct(*order)
    w = Window.partitionBy(key, "_day").orderBy(*order)
    d = d.withColumns({f"_p_{c}": F.lag(c).over(w) for c in cols}).withColumn("_rn", F.row_number().over(w))
    ends = df.withColumn("_day", F.to_date(ts)).groupBy(key, "_day").agg(F.max_by(F.struct(*cols), o).alias("_e"))
    ends = ends.withColumn("_prev", F.lag("_e").over(Window.partitionBy(key).orderBy("_day"))).drop("_e")
    j = d.join(ends, [key, "_day"])
    head = F.col("_rn") == 1
    out = j.withColumns({f"prev_{c}": F.when(head, F.col(f"_prev.{c}")).otherwise(F.col(f"_p_{c}")) for c in cols})
    return out.withColumn("is_first", head & F.col("_prev").isNull()).drop("_day", "_rn", "_prev", *[f"_p_{c}" for c in cols])
