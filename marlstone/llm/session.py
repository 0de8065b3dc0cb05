"""Session plumbing shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: what a batch between the JVM and Python holds at most, by the usual value that it takes the place of
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(16 << 20))}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, keep batches small, and make sure that a checkpoint folder is set.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Where none is named, a local
    session (tests) gets a temporary one and a cluster the warehouse, which all executors share.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    for k, (usual, v) in _BATCH.items():
        if spark.conf.get(k) == usual:
            spark.conf.set(k, v)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            named = tempfile.mkdtemp(prefix="marlstone-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(named)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder. ``spread``: one that has fewer splits than there are cores is dealt to all of them first."""
    prepare(spark)  # before any function is sent to workers: it takes their settings along
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


def tidy(spark: SparkSession):
    """While it lasts, the shuffle files of a write are removed when it ends."""
    return _setting(spark, _CLEAN, "true")


def cut(df: DataFrame) -> DataFrame:
    """Write to a table in the shared checkpoint folder and read that, so that nothing later depends on one executor.

    The shuffle files behind it are of no more use and are removed when the write ends.
    """
    spark = df.sparkSession
    path = folder(spark, f"marlstone-{uuid.uuid4().hex}")
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame | str) -> None:
    """Remove what ``cut`` wrote (or folders), once nothing that is still to be computed reads it."""
    for t in tables:
        spark = SparkSession.getActiveSession() if isinstance(t, str) else t.sparkSession
        path = t if isinstance(t, str) else t._cut_path
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keys(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many parts what is derived from ``df`` is dealt to: grows with the bytes of its sources, without a bound.

    Never under ``spark.sql.shuffle.partitions``. Sources whose size isn't known count by their partitions.
    """
    spark = df.sparkSession
    prepare(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length())]
    if any(s >= 1 << 60 for s in sizes):
        least = max(least, df.rdd.getNumPartitions())
    return max(least, sum(s for s in sizes if s < 1 << 60) // bytes_each)


def partitions(df: DataFrame, bytes_each: int = 16 << 20, most: int = 200_000) -> int:
    """Partitions for a shuffle of what is derived from ``df``. Beyond ``most``, which keeps the shuffle's index files sane, a
    partition has several keys; those are handled one after another."""
    return min(most, keys(df, bytes_each))
