"""Where a job may keep intermediate tables that every executor can read."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="arborix-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/arborix/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    The copy survives lost executors. It lives as long as the shared folder: use drop() for
    those that are over before the result is read. Options are those of the Parquet writer.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arborix_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Removes a table that written() made."""
    path = getattr(df, "_arborix_path", None)
    if path:
        remove(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Has the shuffle files of ended jobs removed now. Spark keeps them until the driver happens to collect its garbage (spark.cleaner.periodicGC.interval: 30 minutes)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
