"""Keyed upsert, deduplication with back-fill, and field-level change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose two values differ, nulls comparing equal."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()]))


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key with the greatest `order`; a map-side aggregate, so hot keys stay cheap."""
    rest = [x for x in df.columns if x not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{x}").alias(x) for x in rest])


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], fields: list[str], now: Column, batch_order: Column) -> DataFrame:
    """Full outer merge into a new snapshot.

    Incoming non-null fields win, missing ones keep the stored value. `action` is
    inserted, updated, unchanged or kept; `changes` lists the fields that moved.
    The batch is reduced to its latest row per key first; `seen` counts its rows.
    """
    cnt = batch.groupBy(*keys).agg(F.count("*").alias("_seen"))
    inc = latest_per_key(batch.withColumn("_o", batch_order), keys, F.col("_o")).join(cnt, keys)
    cur = current.select(*keys, *[F.col(f).alias(f"_c_{f}") for f in fields], "first_seen", "last_seen", "scrapes", F.lit(True).alias("_cur"))
    new = inc.select(*keys, *[F.col(f).alias(f"_n_{f}") for f in fields], "_seen", F.lit(True).alias("_new"))
    j = cur.join(new, keys, "full")
    merged = {f: F.coalesce(f"_n_{f}", f"_c_{f}") for f in fields}
    is_new, is_old = F.col("_cur").isNull(), F.col("_new").isNull()
    moved = changed_fields({f: (merged[f], F.col(f"_c_{f}")) for f in fields})
    changes = F.when(is_new | is_old, F.array().cast("array<string>")).otherwise(moved)
    action = F.when(is_new, "inserted").when(is_old, "kept").when(F.size(moved) > 0, "updated").otherwise("unchanged")
    return j.select(*keys, *[m.alias(f) for f, m in merged.items()],
                    F.coalesce("first_seen", now).alias("first_seen"),
                    F.when(is_old, F.col("last_seen")).otherwise(now).alias("last_seen"),
                    (F.coalesce("scrapes", F.lit(0)) + F.coalesce("_seen", F.lit(0))).alias("scrapes"),
                    action.alias("action"), changes.alias("changes"))


def dedupe_backfill(df: DataFrame, keys: list[str], fields: list[str], priority: Column) -> DataFrame:
    """One row per key; each field from the best-priority row where it is not null."""
    return df.withColumn("_p", priority).groupBy(*keys).agg(
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_p"))).alias(f) for f in fields], F.count("*").alias("copies"))


def insert_missing(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of `rows` whose key is not stored yet."""
    return rows.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def change_history(df: DataFrame, key: str, ts: str, order: list[str], fields: list[str]) -> DataFrame:
    """Old and new value per changed field, one row each; the first sighting gives no row."""
    from plotwise.operators.relational import lag_by_time

    d = lag_by_time(df, key, ts, order, fields).where(~F.col("is_first"))
    entries = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"prev_{f}")), F.struct(
        F.lit(f).alias("field"), F.col(f"prev_{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new"))) for f in fields])
    return d.select(key, ts, F.explode(F.array_compact(entries)).alias("e")).select(key, ts, "e.field", "e.old", "e.new")
