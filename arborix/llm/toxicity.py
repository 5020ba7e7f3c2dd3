"""Toxicity by two class-conditional Kneser-Ney models of word pairs.

Each class estimates a word after another from its discounted pair counts; what is discounted falls back to the word's
continuation counts in the class (after how many different words it came), and what is discounted there to those that the classes share.
So a rare expression, or one seen in a single wording, takes the shared estimate. A text counts an expression once.

A text's score compares its toxic and ordinary log-likelihoods, normalised by a power of its length: evidence sits in few words,
so the square root keeps long texts comparable with short ones. Expressions whose counts do not differ between the
classes by more than chance, by the likelihood-ratio statistic G2, are pruned: a pair to its word and a word to the shared estimate, which
favours no class. How much is pruned, and the threshold, are chosen on a fold of the training rows that the counts leave out.

The models are fitted on TRAIN_ROWS labelled rows at most, those of the smallest hashes of their ids; so the ids that are broadcast to the
texts have a bound, and so has what is left of the counts after pruning. Everything else reads all rows and whole texts.

Defined cases: null and empty texts have no evidence and a score below 0.5; labels that are null are left out and of repeated ones the larger counts; with one class only, or no labels, every score is 0; repeated
rows get repeated results; further columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, small_batches, table, without, written
from .words import FLUSH, words_of

#: Labelled rows that the models and the threshold are fitted on, at most.
TRAIN_ROWS = 50_000
DISCOUNT, POWER = 0.75, 0.5
#: Values of G2 below which an expression is pruned; one is chosen.
PRUNE = (12.0, 16.0, 20.0, 30.0, 60.0, 120.0, 240.0)
#: How much recall weighs against precision in the choice.
BETA = 0.5
STEP = 0.02


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    """Each word with the one before it, the empty one at the start."""
    return set(zip(["", *words], words))


def _count(batches):
    """(label, u, w, n): in how many texts a word w stands, with u null, and stands after u."""
    from collections import Counter

    def out():
        keys = [(c, k) for c in counts for k in counts[c]]
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in keys], pa.int32()), pa.array([k[0] for _, k in keys], pa.string()), pa.array([k[1] for _, k in keys], pa.string()), pa.array([counts[c][k] for c, k in keys], pa.int64())], ["label", "u", "w", "n"]
        )

    counts: dict[int, Counter] = {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = words_of(text)
            counts.setdefault(label, Counter()).update([*pairs_of(found), *((None, w) for w in set(found))])
        if sum(map(len, counts.values())) > 2 * FLUSH:
            yield out()
            counts.clear()
    yield out()


def _g2(a: str, b: str, texts: tuple[int, int]) -> F.Column:
    """The likelihood-ratio statistic of an expression that a of the ordinary and b of the toxic texts have."""
    n0, n1 = map(float, texts)
    both = (F.col(a) + F.col(b)) / (n0 + n1)
    part = lambda x, n, q: F.when(x > 0, x * F.log(x / n / q)).otherwise(0.0)
    terms = (part(F.col(c), n, both) + part(n - F.col(c), n, 1 - both) for c, n in ((a, n0), (b, n1)))
    return 2 * sum(terms, F.lit(0.0))


def train(labelled: DataFrame, discount: float = DISCOUNT, least: float = min(PRUNE)) -> dict | None:
    """labelled(text, label 0/1) -> {"words": {w: (log ratio, G2)}, "pairs": {(u, w): ...}}, or None if a class is missing."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    texts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(texts) < 2:
        return None
    texts = (texts[0], texts[1])
    sums = rows.mapInArrow(_count, "label int, u string, w string, n long").groupBy("u", "w").agg(*(F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)))
    counts = written(sums, "classcounts")
    pairs = counts.where("u IS NOT NULL")
    continued = written(pairs.groupBy("w").agg(*(F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)), F.count("*").alias("k")), "continued")
    k0, k1, k, t0, t1 = continued.agg(F.sum("k0"), F.sum("k1"), F.sum("k"), F.count_if(F.col("k0") > 0), F.count_if(F.col("k1") > 0)).first()
    if not k0 or not k1:
        return None
    lower = lambda c, total, types: F.greatest(F.col(f"k{c}") - discount, F.lit(0.0)) / float(total) + discount * types / total * F.col("k") / float(k)
    words = continued.select("w", lower(0, k0, t0).alias("p0"), lower(1, k1, t1).alias("p1"))
    g2 = _g2("n0", "n1", texts).alias("g2")
    one = counts.where("u IS NULL").select("w", g2).where(F.col("g2") >= least).join(words, "w").select("w", F.log(F.col("p1") / F.col("p0")).alias("r"), "g2")
    after = pairs.groupBy("u").agg(*(f for c in (0, 1) for f in (F.sum(f"n{c}").alias(f"c{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"f{c}"))))
    two = pairs.select("u", "w", "n0", "n1", g2).where(F.col("g2") >= least).join(words, "w").join(after, "u")
    higher = lambda c: F.when(F.col(f"c{c}") == 0, F.col(f"p{c}")).otherwise((F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) + discount * F.col(f"f{c}") * F.col(f"p{c}")) / F.col(f"c{c}"))
    two = two.select("u", "w", F.log(higher(1) / higher(0)).alias("r"), "g2")
    return {"words": {r.w: (r.r, r.g2) for r in one.collect()}, "pairs": {(r.u, r.w): (r.r, r.g2) for r in two.collect()}}


def evidence(model: dict, words: list[str], prune: tuple[float, ...] = PRUNE) -> list[float]:
    """Log-likelihood ratio of a text's words for each amount of pruning."""
    single, pairs = model["words"], model["pairs"]
    out = [0.0] * len(prune)
    for i in [i for i, w in enumerate(words) if w in model["heads"]]:
        tries = [x for x in (pairs.get((words[i - 1] if i else "", words[i])), single.get(words[i])) if x]
        for k, least in enumerate(prune):
            for r, g2 in tries:
                if g2 >= least:
                    out[k] += r
                    break
    return out


def _compare(shared, power: float):
    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                long = max(1, len(found)) ** power
                out.append([x / long for x in evidence(model, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.float64()))], ["id", "v", "ratio"])

    return run


def ratios(docs: DataFrame, model: dict, power: float = POWER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v, ratio): the text's hash and the length-normalised log-likelihood ratio, for each amount of pruning."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(as_bytes(text_col)).alias("v"))
    model = model | {"heads": frozenset(model["words"]) | {w for _, w in model["pairs"]}}
    return rows.mapInArrow(_compare(spark.sparkContext.broadcast(model), power), f"id {kind}, v long, ratio array<double>")


def calibrate(judged: DataFrame) -> tuple[int, float, float]:
    """judged(ratio, label) -> (pruning, threshold, slope) of the best F-measure, from a histogram of bounded size."""
    cells = judged.select("label", F.posexplode("ratio").alias("k", "x")).withColumn("bin", F.floor(F.greatest(F.least("x", F.lit(20.0)), F.lit(-20.0)) / STEP))
    rows = cells.groupBy("k", "bin").agg(F.expr("count_if(label = 1)").alias("pos"), F.expr("count_if(label = 0)").alias("neg")).collect()
    best = (-1.0, 0, 1.0, 1.0)
    for k in range(len(PRUNE)):
        of = sorted((r.bin, r.pos, r.neg) for r in rows if r.k == k)
        pos, neg = sum(x[1] for x in of), sum(x[2] for x in of)
        if not pos or not neg:
            continue
        apart = sum(x[0] * x[1] for x in of) * STEP / pos - sum(x[0] * x[2] for x in of) * STEP / neg
        tp, fp, below = pos, neg, None
        for b, p, n in of:
            if below is not None:
                f = (1 + BETA**2) * tp / (BETA**2 * pos + tp + fp)
                at = max(STEP, (below + 1 + b) / 2 * STEP)  # without evidence, at 0, a text is not toxic
                if f > best[0]:
                    best = (f, k, at, 8 / max(apart, 1e-6))
            tp, fp, below = tp - p, fp - n, b
    return best[1:]


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """toxicity with _text, the text's hash."""
    fold = crc_mod(id_col, folds)
    known = labels.where("toxic IS NOT NULL").where(crc_mod("doc_id", folds) > 0).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("label"))
    known = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    texts = docs.select(id_col, F.col(text_col).alias("text")).where(fold >= 2)
    model = train(texts.join(known, F.col(id_col) == F.col("_id")).select("text", "label"))
    held = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select(id_col, F.xxhash64(as_bytes(text_col)).alias("_text"), held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    all_rows = written(ratios(docs, model, POWER, id_col, text_col).withColumnsRenamed({"id": id_col, "v": "_text"}), "toxicity")
    k, at, slope = calibrate(all_rows.where(fold == 1).join(known, F.col(id_col) == F.col("_id")).select("ratio", "label"))
    score = 1 / (1 + F.exp(-slope * (F.col("ratio")[k] - at)))
    return all_rows.select(id_col, "_text", held, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: id, held_out (fold 0), score, predicted. Labels are read in the folds other than 0."""
    return _judged(docs, labels, id_col, text_col, folds).drop("_text")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bad = _judged(docs, labels, id_col, text_col, 5).where("predicted = 1").select(F.col(id_col).alias("_id"), "_text")
    return without(docs, bad, id_col, text_col)


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
