"""Session settings, shared scratch space and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Hot join keys (a dense grid cell, one dominant city) are split at run time.
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # The default suits no single machine; a cluster keeps its own value.
        spark.conf.set("spark.sql.shuffle.partitions", str(max(2, spark.sparkContext.defaultParallelism)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    A temporary folder is made only on a single machine whose session names
    none; a cluster must name one that driver and executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plotwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths of this session's staged tables, until `release`.
STAGED: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the staged tables; call it once their results are written. Returns how many went."""
    jvm, gone = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while STAGED:
        path = jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, as an iteration leaves behind."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            for path in [p for p in STAGED if folder.endswith(p.rpartition("/")[2])]:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
                STAGED.remove(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage before a costly input is used several times; survives the
    loss of executors because nothing stays in executor-local storage.
    """
    path = fresh_path(df.sparkSession, label)
    STAGED.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
