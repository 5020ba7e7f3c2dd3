"""Shared helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import drop, new_path, released, written  # noqa: F401

ROWS_PER_BATCH = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts may hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def as_bytes(col: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that gone(_id, _text: xxhash64 of the bytes) does not have; null ids are told apart by their texts."""
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(as_bytes(text_col)) == F.col("_text")), "left_anti")


def crc_mod(col: str, n: int):
    """crc32 of the column's value as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
