"""Language identification by words first, backing off to ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word adds the mean over its
longest n-grams that are known, from 5 characters down to 1, word ends included. Words and n-grams are counted over all words of
all training rows. Of each language the model keeps its own most frequent ones, so that a large language does not squeeze out a
small one, by bounds that are parameters; what is broadcast does not grow with the corpus.

Defined cases: a null text, or one without letters, is `und` with score 0; if nothing was learned all are `und`; ties go to the first
language in alphabetical order; repeated rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, table, written
from .words import FLUSH, word_counts, words_of

#: Bounds of the model over all languages, dealt out evenly, the least count of a word, and the longest n-gram.
WORDS, GRAMS, LEAST, LONGEST = 100_000, 200_000, 2, 5
CACHE = 300_000


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


#: A character below 2^CODE_BITS is so many bits of a number that stands for an n-gram; words with others are counted as strings.
CODE_BITS = 12
#: n-gram numbers of a length that a task adds up at once.
SUM_AT = 1 << 21


def _numbers(words: list[str], counts, longest: int):
    """For each length (its n-grams as numbers, how often each occurs); all characters are below 2^CODE_BITS."""
    import numpy as np

    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
    weight = np.repeat(np.asarray(counts, np.int64), sizes)
    number = np.zeros(len(codes), np.int64)
    for n in range(1, longest + 1):
        number = (number[: len(codes) - n + 1] << CODE_BITS) | codes[n - 1 :]
        fits = left[: len(number)] >= n
        yield n, number[fits], weight[: len(number)][fits]


def _summed(parts):
    """One pair (numbers, sums) of many."""
    import numpy as np

    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([w for _, w in parts])).astype(np.int64)


def _spelled(numbers, n: int) -> list[str]:
    import numpy as np

    codes = np.stack([(numbers >> (CODE_BITS * (n - 1 - k))) & ((1 << CODE_BITS) - 1) for k in range(n)], axis=1)
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + n] for i in range(0, len(text), n)]


def _count_grams(longest: int):
    if longest * CODE_BITS > 62:
        raise ValueError("n-grams do not fit a number")

    def run(batches):
        from collections import Counter

        sums: dict[tuple[str, int], list] = {}
        rest: dict[str, Counter] = {}

        def batch_of(label, words, n):
            return pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["label", "word", "n"])

        for batch in batches:
            by_label: dict[str, tuple[list, list]] = {}
            for label, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if word.isascii() or ord(max(word)) < 1 << CODE_BITS:
                    words, counts = by_label.setdefault(label, ([], []))
                    words.append(word)
                    counts.append(n)
                else:
                    for k in range(1, longest + 1):
                        for g in grams(word, k):
                            rest.setdefault(label, Counter())[g] += n
            for label, (words, counts) in by_label.items():
                for k, numbers, weights in _numbers(words, counts, longest):
                    parts = sums.setdefault((label, k), [])
                    parts.append((numbers, weights))
                    if sum(len(x) for x, _ in parts) > SUM_AT:
                        sums[label, k] = [_summed(parts)]
                        if len(sums[label, k][0][0]) > SUM_AT // 2:
                            keys, n = sums.pop((label, k))[0]
                            yield batch_of(label, _spelled(keys, k), n)
            if sum(map(len, rest.values())) > FLUSH:
                for label, counts in rest.items():
                    yield batch_of(label, list(counts), list(counts.values()))
                rest.clear()
        for (label, k), parts in sums.items():
            keys, n = _summed(parts)
            yield batch_of(label, _spelled(keys, k), n)
        for label, counts in rest.items():
            yield batch_of(label, list(counts), list(counts.values()))

    return run


def _most_frequent(counts: DataFrame, langs: list[str], size: int, least: int) -> dict[str, list[int]]:
    """{word: its count in each language} of each language's most frequent words of counts(label, word, n); size bounds them all together."""
    each = max(1, size // len(langs))
    tops = [counts.where((F.col("label") == c) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(each).select("word") for c in langs]
    chosen = tops[0]
    for t in tops[1:]:
        chosen = chosen.unionByName(t)
    at, out = {c: i for i, c in enumerate(langs)}, {}
    for r in counts.join(F.broadcast(chosen.distinct()), "word", "left_semi").collect():  # at most `size` words
        out.setdefault(r.word, [0] * len(langs))[at[r.label]] += r.n
    return out


def train(labelled: DataFrame, words: int = WORDS, max_grams: int = GRAMS, least: int = LEAST, longest: int = LONGEST) -> dict:
    """labelled(text, label) -> model."""
    counts = written(word_counts(labelled), "wordcounts")
    langs = sorted(r.label for r in counts.select("label").distinct().collect())
    if not langs:
        return {"langs": [], "words": {}, "grams": {}}
    by_gram = counts.select("label", "word", "n").mapInArrow(_count_grams(longest), "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))
    by_gram = written(by_gram, "gramcounts")

    def logs(kept):
        sums = [sum(c[i] for c in kept.values()) + 0.5 * len(kept) for i in range(len(langs))]
        return {k: [math.log((x + 0.5) / s) for x, s in zip(c, sums)] for k, c in kept.items()}

    kept, table_of = _most_frequent(by_gram, langs, max_grams, 1), {}
    for n in range(1, longest + 1):
        table_of |= logs({k: c for k, c in kept.items() if len(k) == n})
    return {"langs": langs, "words": logs(_most_frequent(counts, langs, words, least)), "grams": table_of, "longest": longest}


def word_score(model: dict, word: str) -> list[float]:
    known = model["words"].get(word)
    if known:
        return known
    for n in range(model["longest"], 0, -1):
        found = [v for g in grams(word, n) if (v := model["grams"].get(g))]
        if found:
            return [sum(x) / len(found) for x in zip(*found)]
    return [0.0] * len(model["langs"])


def _predict(shared):
    def run(batches):
        import numpy as np

        model = shared.value
        langs, seen = model["langs"], {}
        scores = np.zeros((1024, max(1, len(langs))))
        for batch in batches:
            best, sure = [], []
            for text in batch.column(1).to_pylist():
                found = words_of(text) if langs else []
                if not found:
                    best.append("und")
                    sure.append(0.0)
                    continue
                if len(seen) > CACHE:
                    seen.clear()
                at = []
                for w in found:
                    i = seen.get(w)
                    if i is None:
                        i = seen[w] = len(seen)
                        if i >= len(scores):
                            scores = np.concatenate([scores, np.zeros_like(scores)])
                        scores[i] = word_score(model, w)
                    at.append(i)
                total = scores[at].sum(0)
                p = np.exp(total - total.max())
                k = int(total.argmax())
                best.append(langs[k])
                sure.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(best, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names[2:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.lit(0).alias("_"), F.col(text_col).alias("_text"), F.col(id_col))
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"`{id_col}` {kind}, lang_pred string, score double")


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()).select("text", F.col("lang").alias("label")))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
