"""Counting words of whole texts, partly in the tasks and then by a grouped sum."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LETTERS = re.compile(r"[^\W\d_]+")
#: A task hands on its counts whenever it holds so many different words.
FLUSH = 200_000


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _count(once: bool):
    def run(batches):
        from collections import Counter

        def out():
            keys = [(c, w) for c in counts for w in counts[c]]
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([counts[c][w] for c, w in keys], pa.int64())], ["label", "word", "n"]
            )

        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                counts.setdefault(label, Counter()).update(set(found) if once else found)
            if sum(map(len, counts.values())) > FLUSH:
                yield out()
                counts.clear()
        yield out()

    return run


def word_counts(labelled: DataFrame, once: bool = False) -> DataFrame:
    """(label, word, n) over all rows of labelled(text, label); once: a text counts a word once."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", F.col("label").cast("string").alias("label")).where("label IS NOT NULL")
    return rows.mapInArrow(_count(once), "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))
