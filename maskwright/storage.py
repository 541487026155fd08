"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset a single machine (master local) gets a temporary folder
    of its own; a cluster has none that all executors see, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="maskwright-")
    _at_exit(spark, own)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _at_exit(spark: SparkSession, path: str) -> None:
    """The JVM deletes the folder when it ends, also after the session was stopped."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _OWN:
        _OWN.add(key)
        system, folder = _path(spark, path)
        system.mkdirs(folder)
        system.deleteOnExit(folder)


def own_path(spark: SparkSession, label: str) -> str:
    """A path for a table or checkpoint of our own, deleted when the JVM ends."""
    own = f"{shared_dir(spark)}/maskwright-{spark.sparkContext.applicationId}"
    _at_exit(spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, computes df once.

    The table lasts until ``discard`` or the end of the JVM.
    """
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            system, folder = _path(df.sparkSession, path)
            system.delete(folder, True)
