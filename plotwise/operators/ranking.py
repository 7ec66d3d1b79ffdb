"""Ranks, percentiles and score normalization that never sort a whole group in one task.

Everything starts from `value_positions`: rows are first reduced to distinct
values with counts, the values are spread over range buckets cut at global
quantiles, and each bucket is numbered on its own. Offsets between buckets
come from a summary of at most `BUCKETS + 1` rows per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def split_points(df: DataFrame, cols: list[str], buckets: int = BUCKETS) -> list[list[float]]:
    """At most `buckets - 1` increasing cut values per column; one small row to the driver."""
    probs = [i / buckets for i in range(1, buckets)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), probs, 20 * buckets).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [sorted({float(x) for x in (r or [])}) for r in row]


def bucket_of(col: str, splits: list[float]) -> Column:
    """Number of split points <= value, by binary search over a literal array."""
    if not splits:
        return F.lit(0)
    steps, s = [], 1
    while s <= len(splits):
        steps.insert(0, s)
        s *= 2
    cuts, v = F.lit([float(x) for x in splits]), F.col(col).cast("double")
    n = len(splits)
    return F.aggregate(F.lit(steps), F.lit(0),
                       lambda lo, st: F.when((lo + st <= n) & (F.get(cuts, lo + st - 1) <= v), lo + st).otherwise(lo))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join that keeps one copy of the keys."""
    r = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return a.join(r, cond, how).drop(*[f"__{k}" for k in keys])


def value_positions(df: DataFrame, col: str, by: list[str] = (), counts: dict[str, Column] | None = None,
                    splits: list[float] | None = None) -> DataFrame:
    """One row per (by, value): `cnt` rows hold it, `before` rows are smaller, `total` in the group.

    Null and NaN values are left out. `counts` names further counters to cumulate
    side by side: {"a": agg} gives cnta, beforea, totala.
    """
    by, counts = list(by), counts or {"": F.count("*")}
    seen = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    v = seen.groupBy(*by, col).agg(*[e.alias(f"cnt{k}") for k, e in counts.items()])
    v = v.withColumn("_b", bucket_of(col, split_points(df, [col])[0] if splits is None else splits))
    within = Window.partitionBy(*by, "_b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    local = v.withColumns({f"_in{k}": F.coalesce(F.sum(f"cnt{k}").over(within), F.lit(0)) for k in counts})
    # At most BUCKETS rows per group from here on.
    cells = v.groupBy(*by, "_b").agg(*[F.sum(f"cnt{k}").alias(f"_c{k}") for k in counts])
    across = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "_b", *[e for k in counts for e in (
        F.coalesce(F.sum(f"_c{k}").over(across), F.lit(0)).alias(f"_off{k}"), F.sum(f"_c{k}").over(Window.partitionBy(*by)).alias(f"total{k}"))])
    out = join_on(local, cells, by + ["_b"])
    return out.withColumns({f"before{k}": F.col(f"_in{k}") + F.col(f"_off{k}") for k in counts}).drop(
        "_b", *[f"{x}{k}" for k in counts for x in ("_in", "_off")])


def with_ranks(df: DataFrame, specs: dict[str, tuple]) -> DataFrame:
    """Several rankings at once: `specs` maps a prefix to (column, by, descending).

    Adds `{prefix}rank` (ties share the lowest), `{prefix}avg_rank`, `{prefix}pct_rank`
    and `{prefix}n`; rows with a null value keep null ranks. Every rank table is made
    from `df` itself, so the plan grows with the number of rankings only. Stage a
    costly `df` first.
    """
    cols = list(dict.fromkeys(col for col, _, _ in specs.values()))
    cuts = dict(zip(cols, split_points(df, cols)))
    out = df
    for prefix, (col, by, descending) in specs.items():
        by = list(by)
        p = value_positions(df, col, by, splits=cuts[col])
        before = (F.col("total") - F.col("before") - F.col("cnt")) if descending else F.col("before")
        ranks = p.select(
            *by, F.col(col).alias("_v"),
            (before + 1).alias(f"{prefix}rank"),
            (before + (F.col("cnt") + 1) / 2).alias(f"{prefix}avg_rank"),
            F.when(F.col("total") > 1, before / F.nullif(F.col("total") - 1, F.lit(0))).otherwise(F.lit(0.0)).alias(f"{prefix}pct_rank"),
            F.col("total").alias(f"{prefix}n"))
        out = join_on(out.withColumn("_v", F.col(col)), ranks, by + ["_v"], "left").drop("_v")
    return out


def with_rank(df: DataFrame, col: str, by: list[str] = (), *, descending: bool = False, prefix: str = "") -> DataFrame:
    """One ranking, see `with_ranks`."""
    return with_ranks(df, {prefix: (col, by, descending)})


def average_ranks(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """`df` with the columns replaced by their average ranks."""
    d = with_ranks(df, {f"_{c}__": (c, by, False) for c in cols})
    keep = [c for c in df.columns if c not in cols]
    return d.select(*keep, *[F.col(f"_{c}__avg_rank").alias(c) for c in cols])


def row_numbers(df: DataFrame, by: list[str], order: list, name: str = "rn", limit: int | None = None) -> DataFrame:
    """Row number per group; with `limit` Spark trims each group before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= limit) if limit else out


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per group, exact and distributed."""
    p = value_positions(df, col, by)
    aggs, outs = [], []
    for i, (name, q) in enumerate(probs.items()):
        pos = F.lit(float(q)) * (F.col("total") - 1)
        reach = F.col("before") + F.col("cnt")
        v = F.col(col).cast("double")
        aggs += [F.min(F.when(reach > F.floor(pos), v)).alias(f"_lo{i}"),
                 F.min(F.when(reach > F.ceil(pos), v)).alias(f"_hi{i}")]
        frac = F.lit(float(q)) * (F.col("_n") - 1)
        frac = frac - F.floor(frac)
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
    return p.groupBy(*by).agg(F.max("total").alias("_n"), *aggs).select(*by, *outs)


def medians(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Exact medians of several columns, one row per group."""
    by = list(by)
    parts = [exact_quantiles(df, c, {f"med_{c}": 0.5}, by) for c in cols]
    if not by:
        one = [p.withColumn("_k", F.lit(1)) for p in parts]
        return reduce(lambda a, b: a.join(b, "_k", "full"), one).drop("_k")
    base = df.select(*by).distinct()
    return reduce(lambda a, b: join_on(a, b, by, "left"), parts, base)


# ------------------------------------------------------------ normalization


def minmax_score(df: DataFrame, col: str, out: str, *, lo: float | None = None, hi: float | None = None,
                 scale: float = 5.0, by: list[str] = (), constant: float = 2.5) -> DataFrame:
    """Min-max to [0, scale]; bounds from the data unless given; `constant` when they coincide."""
    by = list(by)
    if lo is not None and hi is not None:
        df2, a, b = df, F.lit(float(lo)), F.lit(float(hi))
    else:
        stats = df.groupBy(*by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
        if by:
            df2 = join_on(df, stats, by, "left")
        else:  # a single row
            df2 = df.withColumns({"_mn": stats.select("_mn").scalar(), "_mx": stats.select("_mx").scalar()})
        a, b = F.col("_mn"), F.col("_mx")
    score = F.when(b == a, F.lit(float(constant))).otherwise((F.col(col) - a) / F.nullif(b - a, F.lit(0)) * scale)
    score = F.when(F.col(col).isNotNull(), F.least(F.lit(scale), F.greatest(F.lit(0.0), score)))
    return df2.withColumn(out, score).drop("_mn", "_mx")


def zscore_score(df: DataFrame, col: str, out: str, n_std: float = 3.0, scale: float = 5.0) -> DataFrame:
    """z-score mapped from ±n_std to [0, scale] and clipped; half the scale when there is no spread."""
    st = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))
    d = df.withColumns({"_m": st.select("m").scalar(), "_s": st.select("s").scalar()})
    z = (F.col(col) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    mapped = (z + n_std) / (2 * n_std) * scale
    return d.withColumn(out, F.when(F.col(col).isNull(), None).when(F.col("_s") == 0, F.lit(scale / 2)).otherwise(
        F.least(F.lit(scale), F.greatest(F.lit(0.0), mapped)))).drop("_m", "_s")


def percent_score(df: DataFrame, col: str, out: str, by: list[str] = (), scale: float = 5.0) -> DataFrame:
    """`scale * percent_rank` within the group."""
    r = with_rank(df, col, by, prefix="_")
    return r.withColumn(out, F.col("_pct_rank") * scale).drop("_rank", "_avg_rank", "_pct_rank", "_n")


def gaussian_ecdf_score(df: DataFrame, col: str, out: str, scale: float = 5.0) -> DataFrame:
    """Average rank / (n + 1) -> normal quantile -> min-max to [0, scale]."""
    from plotwise.functions.mathx import normal_quantile

    r = with_rank(df, col, prefix="_").withColumn("_z", normal_quantile(F.col("_avg_rank") / (F.col("_n") + 1)))
    r = r.drop("_rank", "_avg_rank", "_pct_rank", "_n")
    # The extreme z values belong to the extreme ranks, so they follow from the tie counts alone.
    return minmax_score(r, "_z", out, scale=scale, constant=scale / 2).drop("_z")


def average_percent_score(df: DataFrame, col: str, out: str, scale: float = 5.0) -> DataFrame:
    """Percent rank from average ranks: scale * (r - 1) / (n - 1)."""
    r = with_rank(df, col, prefix="_")
    v = (F.col("_avg_rank") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)) * scale
    return r.withColumn(out, v).drop("_rank", "_avg_rank", "_pct_rank", "_n")
