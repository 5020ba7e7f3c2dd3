"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of 13 words. A window is found in a document only if all of its words are
there, so with the words of a window ordered by rarity (their count over all documents) its prefix is one word:
a document that lacks the rarest word cannot hold the window. Windows are indexed by that word and its offset.
A document's words probe the index; position and length bounds discard what would not fit, and the
words left are compared exactly. The probe side is never shuffled: the index is dealt out by
broadcast in blocks of items whose size is checked, as many blocks as it takes.

Defined cases: null and empty texts have no words; items without words are ignored; items that
repeat an id are taken together; repeated documents give repeated rows; an empty benchmark
hits nothing; items without an id hit words but are not counted; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, table, without

WINDOW = 13
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20

#: Bytes that separate words become spaces, A-Z become a-z; the others are parts of words.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def item_windows(texts: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    out = set()
    for words in map(_words, texts):
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out.add(tuple(words[i : i + size]))
    return out


def _count(vocabulary):
    def run(batches):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(filter(vocabulary.__contains__, _words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def _find(index):
    """index: rarest word -> [(offset, window, item ids)]."""
    keys = index.keys()

    def run(batches):
        for batch in batches:
            n_words, hits, items = [], [], []
            for text in batch.column(1).to_pylist():
                words = _words(text)
                n, found, spans = len(words), set(), []
                rare = keys & set(words)
                if rare:
                    for at, w in enumerate(words):
                        if w in rare:
                            for offset, window, ids in index[w]:
                                begin = at - offset
                                if begin >= 0 and begin + len(window) <= n and tuple(words[begin : begin + len(window)]) == window:
                                    found.update(ids)
                                    spans.append((begin, begin + len(window)))
                merged: list[list[int]] = []
                for b, e in sorted(spans):
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([b, e])
                n_words.append(n)
                hits.append([{"b": b, "e": e} for b, e in merged])
                items.append(sorted(found))
            kind = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))], ["id", "v", "n_words", "spans", "items"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES):
    """Yields, for each block of items, (id, v, n_words, spans, items) of every document; v is the text's hash."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), as_bytes(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + int(2 * size // block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    for k in range(blocks):
        by_window: dict[tuple[bytes, ...], set[str]] = {}
        for r in items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).collect() if size else []:
            for w in item_windows([bytes(r.t)], window):
                by_window.setdefault(w, set()).update(() if r.item is None else (r.item,))
        vocabulary = frozenset(x for w in by_window for x in w)
        counts = {}
        if vocabulary:
            part = docs.select(as_bytes(text_col).alias("t")).mapInArrow(_count(vocabulary), "word binary, n long")
            counts = {bytes(r.word): r.n for r in part.groupBy("word").agg(F.sum("n").alias("n")).collect()}
        index: dict[bytes, list] = {}
        for w, ids in by_window.items():
            rare = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            if counts.get(w[rare], 0):  # else no document has it
                index.setdefault(w[rare], []).append((rare, w, tuple(sorted(ids))))
        yield docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("t"), F.xxhash64(as_bytes(text_col)).alias("v")).mapInArrow(_find(index), f"id {kind}, v long, n_words long, spans array<struct<b:long,e:long>>, items array<string>")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES, **names) -> DataFrame:
    """contamination with _text, the text's hash."""
    parts = list(hits(docs, benchmark, window, id_col, text_col, block_bytes=block_bytes, **names))
    out = parts[0]
    if len(parts) > 1:
        # rows that repeat have the same hits in a block, and come back as often as they were
        once = [x.groupBy("id", "v").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n_words", "spans", "items"))) for x in parts]
        out = once[0]
        for x in once[1:]:
            out = out.unionByName(x)
        # a document's spans come together: at most one for each of its words
        out = out.groupBy("id", "v").agg(F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        merge = """aggregate(spans, CAST(array() AS array<struct<b:bigint,e:bigint>>), (a, s) ->
            CASE WHEN size(a) > 0 AND s.b <= element_at(a, -1).e
                 THEN concat(slice(a, 1, size(a) - 1), array(named_struct('b', element_at(a, -1).b, 'e', greatest(element_at(a, -1).e, s.e))))
                 ELSE concat(a, array(s)) END)"""
        out = out.withColumn("spans", F.expr(merge)).withColumn("items", F.array_sort(F.array_distinct("items")))
        out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.e - s.b)")
    out = out.select(F.col("id").alias(id_col), F.col("v").alias("_text"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES, **names) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated (a share-th of the words or more are hit), spans."""
    return _judged(docs, benchmark, window, id_col, text_col, share, block_bytes, **names).drop("_text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args) -> DataFrame:
    bad = _judged(docs, benchmark, id_col=id_col, text_col=text_col, **args).where("contaminated").select(F.col(id_col).alias("_id"), "_text")
    return without(docs, bad, id_col, text_col)


def op8_decontaminate(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
