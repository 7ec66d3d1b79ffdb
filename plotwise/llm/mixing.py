"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; a document's expected number of copies
is target / source size, at most 2. Whole copies are certain, the fractional
rest is decided by pivotal rounding: two open documents of a source trade mass
so that their expected words stay the same, until one is whole. Each step
moves `size * probability` words from one to the other, so a source's total
never changes; only its last open document is drawn alone, and the source ends
within one document of its target.

Distribution: open documents are dealt to buckets of a source (a hot source
has many), each bucket rounds its own and passes on one residual, and
residuals meet in buckets FAN times fewer, level by level, until one per
source is left. Draws depend on ids, level and bucket only, so reruns agree.

Null source is a source of its own, last in order. Null or wordless texts have
size 0 and are taken 0 words. Rows that share an id and all else are rows of
their own. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from plotwise.llm.common import WORD_SQL, mixed
from plotwise.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, CEILING = 1.5, 2.0
BUCKET, FAN = 2_000, 256


def words():
    """Number of words of a text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size")


def ordered(sources: DataFrame) -> DataFrame:
    """Rank of each source by code point, null last, without a global window.

    Range partitions number their rows; the driver adds up one count per partition.
    """
    sources = stage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("_at", 33)
    counts = sorted((r.p, r.n) for r in sources.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    if not before:
        return sources.withColumn("rank", F.lit(0).cast("long")).drop("_at")
    row = F.col("_at") - F.shiftleft(part, 33)
    return sources.withColumn("rank", row + F.create_map(*before)[part]).drop("_at")


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target): weights share budget * words; what a source may not take goes to the others."""
    s = ordered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stage(s.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(ceiling)), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # Sources at their cap keep it; the rest share what is left by weight.
        capped = F.col("cap") <= F.col("weight") * level
        got = s.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count(F.when(capped, 1))).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (budget * total - got[0]) / got[1]
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def pivotal(p: list[float], size: list[float], u: list[float]) -> tuple[list[float], int]:
    """Round all but one of the open probabilities; u are draws in 0..1.

    Returns the rounded values and the position left open, or -1. p[i] * size[i]
    summed over all positions stays as it was.
    """
    p, i = list(p), -1
    for j in range(len(p)):
        if i < 0:
            i = j
            continue
        # In words: what i can gain from j, and lose to j, before one of them is whole.
        fill, give = (1 - p[i]) * size[i], p[j] * size[j]
        drain, take = p[i] * size[i], (1 - p[j]) * size[j]
        up, down = min(fill, give), min(drain, take)
        if u[j] * (up + down) < down:
            p[i], p[j] = (1.0, (give - up) / size[j]) if fill <= give else (p[i] + up / size[i], 0.0)
        else:
            p[i], p[j] = (0.0, p[j] + down / size[j]) if drain <= take else ((drain - down) / size[i], 1.0)
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
        i = next((k for k in (i, j) if p[k] not in (0.0, 1.0)), -1)
    return p, i


def rounding(seed: int, last: bool):
    """Pivotal rounding of one bucket; `last`: the open rest is drawn, too."""

    def run(pdf):
        pdf = pdf.sort_values(["key", "id", "size"], kind="stable").reset_index(drop=True)
        # The position parts rows that are alike, so each has a draw of its own.
        h = mixed(pdf["key"].to_numpy().astype(np.int64).view(np.uint64) + np.arange(len(pdf), dtype=np.uint64), seed)
        u = ((h >> np.uint64(11)).astype(np.float64) / float(1 << 53)).tolist()
        p, i = pivotal(pdf["p"].tolist(), pdf["size"].tolist(), u)
        if last and i >= 0:
            p[i] = 1.0 if u[i] < p[i] else 0.0
        pdf["p"] = p
        return pdf

    return run


def copies(rows: DataFrame, seed: int = 5, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Replace each row's expected copies by a whole number; rows need id (long), source, size, expected."""
    whole = F.floor(F.col("expected") + 1e-9)
    rows = stage(rows.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - whole)).withColumn("key", F.xxhash64("id", "size", "source")), "mix-rows")
    shut = (F.col("p") <= 1e-9) | (F.col("size") <= 0)
    decided, left = [rows.where(shut).withColumn("p", F.lit(0.0))], rows.where(~shut)
    most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    width, level = -(-most // bucket), 0
    while most:
        last = width <= 1

        out = stage(left.groupBy("source", F.pmod("key", F.lit(max(1, width))).alias("_bucket")).applyInPandas(rounding(seed + 31 * level, last), rows.schema), "mix-level")
        decided.append(out.where(F.col("p").isin(0.0, 1.0)))
        if last:
            break
        left = out.where(~F.col("p").isin(0.0, 1.0))
        width, level = -(-width // fan), level + 1
    done = decided[0]
    for d in decided[1:]:
        done = done.unionByName(d)
    return done.withColumn("copies", (F.col("whole") + F.col("p")).cast("long")).drop("p", "whole", "key")


def decide(sized: DataFrame, **how) -> DataFrame:
    """sized (id, source, size) with source_size, target and copies."""
    goal = targets(sized, **how).withColumnRenamed("source", "_s")
    rows = sized.join(goal, sized["source"].eqNullSafe(goal["_s"])).drop("_s")
    return copies(rows.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row."""
    sized = stage(docs.select(F.col("doc_id").alias("id"), "source", words()), "mix-sizes")
    return decide(sized, **how).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: every row as often as the mix takes it, with its own columns."""
    row = F.xxhash64(*docs.columns)
    sized = stage(docs.select(row.alias("id"), "source", words()), "mix-sizes")
    per = stage(decide(sized, **how).groupBy(F.col("id").alias("_row")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0"), "mix-copies")
    joined = docs.withColumn("_row", row).join(per, "_row")
    # Equal rows share their copies, the first ones one more; the join has sorted them already.
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    n = F.floor(F.col("_copies") / F.col("_rows")) + F.when(nth <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return joined.withColumn("_n", n.cast("int")).where("_n > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select(*docs.columns)
