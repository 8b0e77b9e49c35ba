"""Readers for the test tables and checkpoint helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder; Parquet's own schema is used, so no job runs to infer it."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is named, a local session gets one of its own, which
    goes with the driver; a cluster has no such folder to fall back to, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarryline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name under the shared one; the folder goes when the driver's Python ends in the usual way, for lazy
    results still read it before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing df as Parquet under the shared folder and reading it again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the folder is then left to its owner
        pass


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows to fit a model on, chosen by a hash of their keys; the same rows for the same table.

    A threshold on the hash, from the row count, leaves about three times as many rows before the exact cut, so no task
    sees more than that whatever the size of the table. A small table is taken whole.
    """
    n = df.count()
    h = F.xxhash64(*keys)
    share = min(1.0, 3 * most / max(1, n))
    some = df if share == 1.0 else df.where(F.pmod(h, F.lit(1_000_003)) < int(share * 1_000_003))
    return some.withColumn("_h", h).orderBy("_h").limit(most).drop("_h")
