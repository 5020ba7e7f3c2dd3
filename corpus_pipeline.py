"""A corpus pipeline: toxicity, exact dedup, near dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents. Near dedup links by the SimHash tables of op5 first, and what is
too far apart for Hamming balls by minwise ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborix.functions.shared import new_path
from arborix.llm.bpe import encode
from arborix.llm.common import table
from arborix.llm.decontaminate import drop_contaminated
from arborix.llm.exact_dedup import drop_exact_duplicates
from arborix.llm.simhash import drop_similar
from arborix.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs, shingle=5, similarity=0.8, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Toxicity and near duplicates have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
