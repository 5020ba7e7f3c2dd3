"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in an order that keeps similar ones together (the two nearest of PIVOTS sampled vectors), and runs of BLOCK of them become blocks with a
forward index: the ids and all components. A block also has the largest and smallest value of each component, its term maxima; a query's
components times these sum up to a bound on what it can score in the block. A query takes blocks in the order of their bounds, in waves: a few first, whose results
set its k-th score, then more, and at last all whose bounds are not below it. Blocks whose bound equals the k-th score are still taken if they have a smaller id than the k-th.

Bounds are computed tile by tile (SHELF block summaries against PART queries), scores block by block, with as many copies of a block as its queries
need. Queries with one vector are one query with one more result, of which each then leaves out its own row. Nothing is broadcast, and no task
holds more than a tile or a block.

Defined cases: vectors that are null or hold null or non-finite components take no part; components are floor(256 x), held to 28 bits; vectors
of another length than the query's are no candidates; rows without an id are candidates, after all others of the same score, and no queries; repeated rows are rows
of their own (a query leaves out one row, its own); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .streams import copies, dealt, runs

BLOCK, SHELF, PART = 256, 256, 256
#: The order is fitted on so many rows, those of the smallest hashes; all rows are in it.
PIVOTS = 64
#: How many blocks a query takes in the first waves; all that are left come after them.
WAVES = (4, 32)
SPLIT = 2048
LIMIT = (1 << 28) - 1
LAST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): components as floor(scale * x) in doubles."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)
    held = lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    return rows.select("id", F.transform("v", held).alias("v"))


def _matrix(column, dim: int):
    import numpy as np

    return column.combine_chunks().flatten().to_numpy().reshape(len(column), dim) if len(column) else np.zeros((0, dim), np.int64)


def _products(a, b):
    """a @ b.T in whole numbers: in doubles where they are exact."""
    import numpy as np

    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _coded(pivots: dict[int, list[list[int]]]):
    """Adds the order: the nearest and the second nearest pivot of the vector's length, by inner products."""

    def run(batches):
        import numpy as np

        for batch in batches:
            v = batch.column("v")
            dims = v.value_lengths().to_numpy()
            code = np.zeros(len(v), np.int64)
            for d in np.unique(dims):
                if len(own := pivots.get(int(d), [])) > 1 and d:
                    at = np.flatnonzero(dims == d)
                    s = _products(_matrix(pa.chunked_array([v.take(pa.array(at))]), int(d)), np.array(own))
                    first = s.argmax(axis=1)
                    s[np.arange(len(at)), first] = np.iinfo(np.int64).min
                    code[at] = first * PIVOTS + s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(dims, pa.int32()), pa.array(code)], ["id", "v", "dim", "code"])

    return run


def _blocks(batches):
    """Rows in order -> blocks: ids in order (null last), their components, and for each component the largest and smallest."""
    import numpy as np

    def block(ids, v, dim):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        to = lambda m: pa.array([m.astype("<i4").tobytes()], pa.binary())
        hi, lo = (v.max(axis=0), v.min(axis=0)) if len(v) else (v, v)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), to(v), to(hi), to(lo), pa.array([int(ids[0])])], ["dim", "ids", "x", "hi", "lo", "least"])

    ids, v, dim = [], [], None
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for cut in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
            if not len(cut):
                continue
            part = batch.slice(cut[0], len(cut))
            if dim is not None and dims[cut[0]] != dim and ids:
                yield block(np.concatenate(ids), np.concatenate(v), dim)
                ids, v = [], []
            dim = int(dims[cut[0]])
            new = part.column("id").fill_null(LAST).to_numpy(), _matrix(pa.chunked_array([part.column("v")]), dim)
            ids, v = [*ids, new[0]], [*v, new[1]]
            if sum(map(len, ids)) >= BLOCK:
                all_ids, all_v = np.concatenate(ids), np.concatenate(v)
                full = len(all_ids) - len(all_ids) % BLOCK
                for i in range(0, full, BLOCK):
                    yield block(all_ids[i : i + BLOCK], all_v[i : i + BLOCK], dim)
                ids, v = ([all_ids[full:]], [all_v[full:]]) if full < len(all_ids) else ([], [])
    if ids:
        yield block(np.concatenate(ids), np.concatenate(v), dim)


def index(rows: DataFrame) -> DataFrame:
    """(block, dim, ids, x, hi, lo, least) of rows(id, v); an id of null is the largest long here."""
    sample = rows.orderBy(F.xxhash64("id", "v"), F.col("id")).limit(PIVOTS).collect()
    pivots: dict[int, list[list[int]]] = {}
    for v in dict.fromkeys(tuple(r.v) for r in sample):
        pivots.setdefault(len(v), []).append(list(v))
    coded = rows.mapInArrow(_coded(pivots), "id long, v array<bigint>, dim int, code long")
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    order = ["dim", "code", "v", F.col("id").asc_nulls_last(), "row"]
    blocks = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, "dim int, ids array<bigint>, x binary, hi binary, lo binary, least long")
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _number(blob: bytes, dim: int):
    import numpy as np

    return np.frombuffer(blob, "<i4").astype(np.int64).reshape(-1, dim) if dim else np.zeros((1, 0), np.int64)


def _bounds(most: int | None):
    """Tiles of summaries and queries -> for each query its next blocks in order: (q, block, bound, least)."""

    def run(batches):
        import numpy as np

        now, held = None, []
        for key, kind, rows in runs(batches, ["dim", "shelf", "part"]):
            dim = int(key[0])
            if kind == 0:
                if key != now:
                    now, held = key, []
                held.append(rows)
                continue
            if key != now or not held:
                continue
            if len(held) > 1 or not isinstance(held[0], tuple):
                t = pa.Table.from_batches(held)
                least, block = t.column("least").to_numpy(), t.column("block").to_numpy()
                hi, lo = (np.concatenate([_number(b, dim) for b in t.column(c).to_pylist()]) if dim else np.zeros((len(t), 0), np.int64) for c in ("hi", "lo"))
                held = [(hi, lo, least, block)]
            hi, lo, least, block = held[0]
            q = _matrix(pa.chunked_array([rows.column("v")]), dim)
            bound = _products(np.maximum(q, 0), hi) + _products(np.minimum(q, 0), lo)
            col = lambda c: rows.column(c).to_numpy(zero_copy_only=False)[:, None]
            kth, kid = col("kth"), col("kid")
            left = (bound > kth) | ((bound == kth) & (least[None] < kid))
            # strictly after the last block taken, in the order of bound, least id and block
            cb, cl, ck = col("c_bound"), col("c_least"), col("c_block")
            left &= (bound < cb) | ((bound == cb) & ((least[None] > cl) | ((least[None] == cl) & (block[None] > ck))))
            i, j = np.nonzero(left)
            if most is not None:
                order = np.lexsort((block[j], least[j], -bound[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < most], j[place < most]
            if len(i):
                yield pa.RecordBatch.from_arrays([rows.column("q").take(pa.array(i)), pa.array(block[j]), pa.array(bound[i, j]), pa.array(least[j])], ["q", "block", "bound", "least"])

    return run


def _scores(k: int):
    """Blocks, each followed by the queries that take it -> each query's best k of the block that can still count."""

    def run(batches):
        import numpy as np

        now, x, ids = None, None, None
        for key, kind, rows in runs(batches, ["block", "copy"]):
            if kind == 0:
                now, dim = key, rows.column("dim")[0].as_py()
                ids = rows.column("ids")[0].values.to_numpy()
                x = _number(rows.column("x")[0].as_py(), dim) if dim else np.zeros((len(ids), 0), np.int64)
                continue
            if key != now:
                continue
            s = _products(_matrix(pa.chunked_array([rows.column("v")]), x.shape[1]), x)
            kth = rows.column("kth").to_numpy()[:, None]
            if s.shape[1] > k:
                kth = np.maximum(kth, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None])
            i, j = np.nonzero(s >= kth)
            order = np.lexsort((j, -s[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([rows.column("q").take(pa.array(i)), pa.array(s[i, j]), pa.array(ids[j])], ["q", "score", "id"])

    return run


def top_products(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(id, top): for each of queries(id, v), which are rows of rows(id, v), the k best of all other rows: structs of score and id, best first."""
    blocks = index(rows)
    n_blocks = blocks.count()
    shelf = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n_blocks // SHELF)))).cast("int")
    asked = written(queries.groupBy("v").agg(F.count("*").alias("times")).withColumn("q", F.monotonically_increasing_id()), "asked")
    parts = max(1, -(-asked.count() // PART))
    deep = k + 1  # one more, as a query's own row is among them
    fresh = {"kth": -LAST, "kid": LAST, "c_bound": LAST, "c_least": -1 - LAST, "c_block": -1}
    state = asked.select("q", "v", F.size("v").alias("dim"), *(F.lit(x).cast("long").alias(c) for c, x in fresh.items()))
    best = None
    for most in (*WAVES, None):
        tiles = copies(blocks.select("block", "dim", "hi", "lo", "least", shelf.alias("shelf")), parts, "part")
        asking = copies(state.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")), max(1, -(-n_blocks // SHELF)), "shelf")
        next_ = dealt([tiles, asking], ["dim", "shelf", "part"]).mapInArrow(_bounds(most), "q long, block long, bound long, least long")
        if most is not None:
            place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "least", "block"))
            next_ = next_.withColumn("place", place).where(F.col("place") <= most)
        next_ = written(next_, "next")
        load = next_.groupBy("block").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("copies"))
        if load.isEmpty():
            break
        pairs = next_.select("q", "block").join(load, "block").join(state.select("q", "v", "kth"), "q").withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int"))
        there = blocks.select("block", "dim", "ids", "x").join(load, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        found = dealt([there.drop("copies"), pairs.drop("copies")], ["block", "copy"]).mapInArrow(_scores(deep), "q long, score long, id long")
        found = found if best is None else found.unionByName(best)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        best = written(found.withColumn("_place", place).where(F.col("_place") <= deep).drop("_place"), "best")
        if most is None:
            break
        last = next_.groupBy("q").agg(F.max_by(F.struct("bound", "least", "block"), "place").alias("c"))
        floor = best.groupBy("q").agg(F.count("*").alias("n"), F.max_by(F.struct("score", "id"), F.struct(-F.col("score"), "id")).alias("f")).where(F.col("n") == deep)
        state = written(
            state.join(last, "q").join(floor, "q", "left").select("q", "v", "dim", F.coalesce("f.score", "kth").alias("kth"), F.coalesce("f.id", "kid").alias("kid"), F.col("c.bound").alias("c_bound"), F.col("c.least").alias("c_least"), F.col("c.block").alias("c_block")),
            "state",
        )
    if best is None:
        return queries.select("id", F.array().cast("array<struct<score: bigint, id: bigint>>").alias("top"))
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("top"))  # k + 1 at most
    named = asked.select("q", "v").join(lists, "q", "left")
    own = F.expr("array_position(top, struct(-aggregate(v, 0L, (s, x) -> s + x * x) AS less, id))")
    others = F.slice(F.filter("top", lambda s, i: i + 1 != F.col("own")), 1, k)
    out = queries.join(named, "v").withColumn("own", own)
    return out.select("id", F.transform(others, lambda s: F.struct((-s["less"]).alias("score"), F.nullif(s["id"], F.lit(LAST)).alias("id"))).alias("top"))


def op11_top_products(spark, sf_dir):
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = top_products(rows, rows.where("id % 50 = 0"))
    one = out.select(F.col("id").alias("query_id"), F.posexplode("top").alias("rank", "s"))
    return one.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score"))


OP11_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p) WHERE rank <= 5"""
