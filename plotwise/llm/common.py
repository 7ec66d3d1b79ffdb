"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.session import STAGED, configure, stage

WORD = re.compile(r"[^ \t-\r]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
FEW_GROUPS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def thin(df: DataFrame, keys: list[str], bound: int, groups: list[str] | None = None) -> DataFrame:
    """About `bound` rows (per group) chosen by a hash of `keys`; all rows where there are fewer.

    Only for rows a model is fitted on. Counts first, so no sort and no window.
    """
    h = (F.xxhash64(*keys).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30))
    if groups:
        n = stage(df.groupBy(*groups).agg(F.count("*").alias("_n")), "thin")
        n = F.broadcast(n) if n.count() <= FEW_GROUPS else n  # else the rows are shuffled by group
        return df.join(n, groups).where(h * F.col("_n") < bound).drop("_n")
    n = df.count()
    return df.where(h * float(n) < bound)


def batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """`fn(record batch) -> dict of columns` over Arrow batches, without a shuffle."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(it):
        for b in it:
            if b.num_rows:
                cols = fn(b)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def settle(spark: SparkSession, *staged: DataFrame) -> None:
    """Give back the disk of finished steps: staged tables that nobody reads any more, and shuffle files of dropped plans."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in staged:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if any(folder.endswith(p.rpartition("/")[2]) for p in STAGED):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()  # the context cleaner drops shuffles whose plans are gone


@contextmanager
def sifted(spark: SparkSession):
    """Within: a join whose other side is small sifts its large side by a Bloom filter of the keys before rows are shuffled.

    The filter has Spark's own bounds; beyond them more rows travel, none is lost. Settings return to what they were.
    """
    base = "spark.sql.optimizer.runtime.bloomFilter."
    new = {f"{base}enabled": "true", f"{base}applicationSideScanSizeThreshold": "0", f"{base}creationSideThreshold": "1g"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mixed(a: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of a well-known integer hash, seeded."""
    z = a.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges (a, b): the smallest id reachable.

    Alternating stars on staged edge tables: in each round every node hooks
    its larger neighbours, then its smaller ones, to the smallest id it
    knows. Only a row count comes back to the driver. A node with very many
    neighbours appears as one aggregate, never as one list.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "cc-large")
        low2 = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct()
        new = stage(small, "cc")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).union(new.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        e = new
