"""Ranked lexical search by the Best Position Algorithm.

Documents are tokenised once. Only postings of terms that some item has are kept; they are dealt with their documents into shards of about
SHARD postings, at random, so a frequent term's list is spread over all shards and none is held whole. Within a shard
every term has an impact list, in falling order of what the term adds to a document's score. For an item its lists are read in parallel from the top;
each document met is looked up in all other lists (direct access), which gives its score and its positions there. A list's best position is the last one up to which all
positions have been seen, by either access. What the lists have at their best positions sums up to a bound on every document not yet seen, and reading stops once
it is strictly below the k-th score. Positions are read a stretch at a time, each twice as long as the last. The k best of the shards are then merged.

Statistics (number and lengths of documents, document frequencies) are those of all documents. Items reach the shards in groups of GROUP, as rows; nothing is broadcast by hand.

Defined cases: null and empty texts have no terms, are no documents and find nothing; rows that share an id are documents of their own; rows without an
id rank after all others of the same score; equal items count once, items that share an id with other texts are items of their own; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, small_batches, table, written
from .streams import copies, dealt

#: Postings of a shard, and items that a shard's task gets at a time.
SHARD, GROUP = 500_000, 500
STRETCH = 32
LAST = (1 << 63) - 1
#: What is no term: all of ASCII but letters and digits.
BREAKS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BREAKS).split()


def _counted(batches):
    """(id, row, n, terms, tfs) of every text that has a term."""
    from collections import Counter

    row = 0
    for batch in batches:
        at, ns, terms, tfs, ends = [], [], [], [], [0]
        for i, text in enumerate(batch.column(1).to_pylist()):
            if found := terms_of(text):
                counts = Counter(found)
                at.append(i)
                ns.append(len(found))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
                if len(terms) > 1_000_000:
                    yield _rows(batch, at, row, ns, terms, tfs, ends)
                    row += len(at)
                    at, ns, terms, tfs, ends = [], [], [], [], [0]
        yield _rows(batch, at, row, ns, terms, tfs, ends)
        row += len(at)


def _rows(batch, at, row, ns, terms, tfs, ends):
    ends = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(terms, pa.binary()), pa.array(tfs, pa.int32()))]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(range(row, row + len(at)), pa.int64()), pa.array(ns, pa.int64()), *lists], ["id", "row", "n", "terms", "tfs"])


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(_counted, "id long, row long, n long, terms array<binary>, tfs array<int>")


class Shard:
    """Impact lists of a shard, one after the other, and the way from a document to its positions in them."""

    def __init__(self, doc, term, impact):
        import numpy as np

        self.docs, doc = np.unique(doc, return_inverse=True)  # in the order of their places
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.list = np.repeat(np.arange(len(self.terms)), self.last - self.first)
        self.by_doc = np.argsort(self.doc, kind="stable")  # positions, document by document
        self.begin = np.searchsorted(self.doc[self.by_doc], np.arange(len(self.docs) + 1))

    def best(self, terms, k: int):
        """(documents, scores, positions read): the k best of the item's terms, by the Best Position Algorithm."""
        import numpy as np

        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        of_item = np.zeros(len(self.terms), bool)
        of_item[at] = True
        begin, end = self.first[at], self.last[at]
        best = begin.copy()  # the first position of each list that is not seen
        seen = {int(b): np.zeros(e - b, bool) for b, e in zip(begin, end)}
        known = np.zeros(len(self.docs), bool)
        docs, scores, read, stretch, kth = [], [], 0, STRETCH, None
        while True:
            spans = [np.arange(b + read, min(e, b + read + stretch)) for b, e in zip(begin, end) if b + read < e]
            if not spans:
                break
            read += stretch
            stretch *= 2
            met = self.doc[np.concatenate(spans)]
            new = np.unique(met[~known[met]])
            known[new] = True
            if len(new):  # direct accesses: all positions of the new documents
                sizes = self.begin[new + 1] - self.begin[new]
                flat = np.repeat(self.begin[new] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
                places, owner = self.by_doc[flat], np.repeat(np.arange(len(new)), sizes)
                own = of_item[self.list[places]]
                places, owner = places[own], owner[own]
                total = np.zeros(len(new), np.int64)
                np.add.at(total, owner, self.impact[places])
                docs.append(new)
                scores.append(total)
                places.sort()
                for b, cut in zip(begin, np.split(places, np.searchsorted(places, begin[1:]))):
                    seen[int(b)][cut - b] = True
            bound = 0
            for i, (b, e) in enumerate(zip(begin, end)):
                mark = seen[int(b)]
                rest = mark[best[i] - b :]
                step = int(rest.argmin()) if len(rest) and not rest.all() else len(rest)
                best[i] += step
                if best[i] < e:  # all positions before it are seen; what follows adds no more than the last seen one
                    bound += int(self.impact[best[i] - 1]) if best[i] > b else int(self.impact[b])
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = np.partition(every, len(every) - k)[len(every) - k]
                if bound < kth:
                    break
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        order = np.lexsort((docs, -scores))
        order = order[scores[order] > 0][:k]
        return self.docs[docs[order]], scores[order], read


def _search(k: int):
    """Shards, each followed by groups of items -> each item's k best documents of the shard."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        def built():
            # places in the order of ids (null last), so that equal scores are in theirs
            t = pa.Table.from_batches(held)
            ids = t.column("id").fill_null(LAST).to_numpy()
            order = np.lexsort((t.column("row").to_numpy(), ids))
            t = t.take(pa.array(order))
            sizes = pc.list_value_length(t.column("term")).to_numpy()
            flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
            return ids[order], Shard(np.repeat(np.arange(len(t)), sizes), flat("term"), flat("impact"))

        now, held, shard = None, [], None
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("_kind").to_numpy()
            change = (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])
            for cut in np.split(np.arange(len(batch)), np.flatnonzero(change) + 1):
                if not len(cut):
                    continue
                part = batch.slice(cut[0], len(cut))
                if shards[cut[0]] != now:
                    now, held, shard = shards[cut[0]], [], None
                if kinds[cut[0]] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                shard = shard or built()
                ids, lists = shard
                items, found, score = [], [], []
                for item, terms in zip(part.column("items").to_pylist(), part.column("lists").to_pylist()):
                    for i, t in zip(item, terms):
                        docs, s, _ = lists.best(np.array(t, np.int64), k)
                        items += [i] * len(docs)
                        found.append(ids[docs])
                        score.append(s)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(score))], ["item", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, of those with a score above 0."""
    asked = items.select(F.col(item_id).alias("name"), as_bytes(text_col).alias("t")).distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    small_batches(docs.sparkSession)
    words = asked.select("item", "t").mapInArrow(_item_terms, "item long, term binary")
    words = written(words, "itemterms")
    vocabulary = written(words.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    texts = written(counted(docs, doc_id, text_col).withColumn("part", F.spark_partition_id()), "terms")
    stats = texts.agg(F.count("*").alias("N"), F.sum("n").alias("L"))
    postings = texts.select("id", "part", "row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", "part", "row", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    postings = written(postings.join(vocabulary, "term").select("id", "part", "row", "n", "tid", "tf"), "postings")
    n = postings.count()
    if not n:
        return asked.select(F.col("name").alias(item_id), F.lit(1).alias("rank"), F.lit(0).cast("long").alias(doc_id), F.lit(0).cast("long").alias("score")).limit(0)
    N, L = stats.first()
    shards = max(1, -(-n // shard))
    weight = F.floor(1000 * F.log(F.lit(2.0 * N + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = written(postings.groupBy("tid").agg(F.count("*").alias("df")).select("tid", weight.alias("w")), "weights")
    m = F.expr(f"10 + (90L * n * {N}L) div {L}L")
    impact = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    lists = postings.join(weights, "tid").withColumn("m", m).withColumn("impact", impact)
    # a document's postings together again, all in one shard
    whole = lists.groupBy("part", "row").agg(F.first("id").alias("id"), F.collect_list("tid").alias("term"), F.collect_list("impact").alias("impact"))
    whole = whole.withColumn("shard", F.pmod(F.xxhash64("part", "row"), F.lit(shards)).cast("int"))
    of_item = words.join(vocabulary, "term").groupBy("item").agg(F.sort_array(F.collect_set("tid")).alias("terms"))  # one item's terms
    groups = max(1, -(-asked.count() // GROUP))
    grouped = of_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("item", "terms")).alias("all"))  # GROUP items or so
    grouped = grouped.select(F.col("all.item").alias("items"), F.col("all.terms").alias("lists"))
    found = dealt([whole, copies(grouped, shards, "shard")], ["shard"]).mapInArrow(_search(k), "item long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item", "name"), "item").select(F.col("name").alias(item_id), "rank", F.nullif("id", F.lit(LAST)).alias(doc_id), "score")


def _item_terms(batches):
    for batch in batches:
        items, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set(terms_of(text))
            items += [item] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])


def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""WITH d AS (SELECT doc_id, unnest({_TERM}) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_TERM}) AS term FROM benchmark),
p AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN t USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM p WHERE score > 0) WHERE rank <= 10"""
