"""Comparison of score normalizations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.functions.mathx import normal_quantile
from plotwise.operators.ranking import average_ranks, with_ranks
from plotwise.session import stage

SCHEMES = ["minmax", "gaussian", "percent"]


def normalized_all(df: DataFrame, scores: list[str]) -> DataFrame:
    """Every score under every scheme, and the mean per scheme."""
    r = stage(with_ranks(df, {f"_{s}_": (s, [], False) for s in scores}))
    z = {s: normal_quantile(F.col(f"_{s}_avg_rank") / (F.col(f"_{s}_n") + 1)) for s in scores}
    ends = r.agg(*[e for s in scores for e in (F.min(s).alias(f"{s}_lo"), F.max(s).alias(f"{s}_hi"),
                                               F.min(z[s]).alias(f"{s}_zl"), F.max(z[s]).alias(f"{s}_zh"))]).first()
    span = lambda x, lo, hi: F.lit(2.5) if hi - lo < 1e-10 else (x - lo) / (hi - lo) * 5.0
    cols = {}
    for s in scores:
        cols[f"minmax_{s}"] = span(F.col(s), ends[f"{s}_lo"], ends[f"{s}_hi"])
        cols[f"gaussian_{s}"] = span(z[s], ends[f"{s}_zl"], ends[f"{s}_zh"])
        cols[f"percent_{s}"] = (F.col(f"_{s}_avg_rank") - 1) / (F.col(f"_{s}_n") - 1) * 5.0
    out = r.select(*df.columns, *[e.alias(n) for n, e in cols.items()])
    return out.withColumns({k: reduce(lambda a, b: a + b, [F.col(f"{k}_{s}") for s in scores]) / len(scores) for k in SCHEMES})


def compare_normalizations(df: DataFrame, scores: list[str], current: str, ident: str = "id", top: int = 10) -> DataFrame:
    """Per scheme: distribution statistics, rank agreement with the current index, overlap of the best.

    Columns: scheme, item, value.
    """
    df = stage(df.dropna(subset=scores + [current]), "scores")  # every ranking reads it
    wide = stage(normalized_all(df, scores))
    stats = []
    for name in SCHEMES:
        for s in scores + [""]:
            x = f"{name}_{s}" if s else name
            for item, agg in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_pop), ("skew", F.skewness)):
                stats.append((name, f"{item}_{s}" if s else item, agg(x)))
    pairs = [(current, s) for s in SCHEMES] + [("minmax", "gaussian")]
    ranked = average_ranks(wide.select(ident, current, *SCHEMES), [current, *SCHEMES])

    def melt(row, items):
        structs = [F.struct(F.lit(a).alias("scheme"), F.lit(b).alias("item"), F.col(f"v{i}").cast("double").alias("value")) for i, (a, b) in enumerate(items)]
        return row.select(F.explode(F.array(*structs)).alias("e")).select("e.*")

    out = melt(wide.agg(*[e.alias(f"v{i}") for i, (_, _, e) in enumerate(stats)]), [(a, b) for a, b, _ in stats])
    rho = melt(ranked.agg(*[F.corr(a, b).alias(f"v{i}") for i, (a, b) in enumerate(pairs)]), [(b, f"spearman_vs_{a}") for a, b in pairs])
    best = {x: wide.orderBy(F.col(x).desc(), ident).limit(top).select(ident) for x in [current, *SCHEMES]}
    over = [best[a].join(best[b], ident, "left_semi").agg(F.count("*").cast("double").alias("value")).select(
        F.lit(b).alias("scheme"), F.lit(f"top_overlap_vs_{a}").alias("item"), "value") for a, b in pairs]
    return reduce(lambda a, b: a.unionByName(b), [out, rho, *over]).withColumn("value", F.round("value", 6))
