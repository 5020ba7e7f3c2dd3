"""Content-addressed store of token ids.

A rolling hash over the last ids of a document cuts its id stream into chunks, so equal stretches are
cut alike wherever they stand. A chunk is named by the hash of its bytes and stored once. Layout of a store:

    chunks/    name binary(16), n int, data binary   ids, little-endian, 2 bytes each if all fit, else 4
    recipes/   id, row long, seq int, name, n       the chunks of every document, in order
    manifest/  id, row long, n_chunks int, n_tokens long, root binary(32), shard long
    shards/    shard long, n_docs long, n_tokens long, root binary(32)

Documents are dealt into shards by ranges of their id, root and row, so neither an id that many share nor rows without one
make a large shard. root of a document is the Merkle root over its chunk names,
root of a shard that over its documents' roots. Reading back hashes every stored chunk again,
combines the chunks' CRCs in recipe order and compares the Merkle roots, so a lost, changed or misplaced
chunk raises; texts of ids can be put together from recipes as well.

Only names and counts are shuffled a second time, chunk bytes once. A chunk that very many documents share
is one row after the first aggregation, which runs in the tasks before the shuffle; the joins on names
are equi-joins that adaptive execution splits.

Defined cases: null is the empty text, which has the end id only; row numbers the documents, so rows that repeat an id, or have none,
are documents of their own: those without an id come first, those of one id in the order of their roots; an empty table
makes an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_symbols
from .common import drop, new_path, small_batches, table, written
from .fragments import Known, buffer, distinct, first_cuts, ragged

VOCABULARY = "word_bpe_49k.json"
#: A cut where the hash of the last RUN ids is 0 in its upper MASK_BITS bits; chunks have LEAST to MOST ids.
RUN, MASK_BITS, LEAST, MOST = 8, 9, 64, 2048
#: Fragments of each of the two generations that a task keeps.
CACHE = 300_000
#: Fragments that are handed to the library at once.
PORTION = 20_000
#: Chunks of a range of documents and the most documents of a shard; the most ranges, and by how much the shards' numbers of two ranges are apart.
SHARD_CHUNKS, SHARDS, PART = 10_000, 20_000, 1 << 30
END_ID = 2

class WordEncoder:
    """Encodes texts with the tokenizers library, each fragment once.

    This vocabulary's pre-tokeniser drops white space and keeps runs of letters and other marks apart, so the ids of a
    text are those of its fragments. Runs of Latin letters, lower-cased, are words to the library's model as they
    are; all other fragments go through the whole tokeniser, and so do texts with special tokens.
    """

    def __init__(self, path: str):
        import json
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        bare = spec | {"added_tokens": [], "truncation": None, "padding": None} | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "decoder"))
        self.tokenize = Tokenizer.from_str(json.dumps(bare)).model.tokenize  # a word's tokens, without an encoding about them
        self.symbol_of = {b: c for c, b in byte_symbols().items()}
        self.lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
        self.space = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
        self.known = Known(self._learn, CACHE)

    def _learn(self, fragments: list[str]):
        """(fragment, its ids as little-endian 4-byte strings) of distinct fragments."""
        import numpy as np

        plain = [f for f in fragments if f.isalpha() and (f.isascii() or max(f) <= "\xff")]
        for at in range(0, len(plain), PORTION):
            part = plain[at : at + PORTION]
            words = "\n".join(part).lower().encode().decode("latin-1").translate(self.symbol_of).split(self.symbol_of[10])
            coded = [[t.id for t in self.tokenize(w)] for w in words]
            data = np.fromiter(chain.from_iterable(coded), "<u4").tobytes()
            bounds = [0, *accumulate(4 * len(c) for c in coded)]
            yield from ((f, data[a:z]) for f, a, z in zip(part, bounds, bounds[1:]))
        done = set(plain)
        others = [f for f in fragments if f not in done]
        for f, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False)):
            yield f, np.array(e.ids, "<u4").tobytes()

    def _encode_plain(self, texts: pa.Array):
        import numpy as np

        data, _, offsets = buffer(texts)
        data = self.lower[data]
        cut = first_cuts(data)
        space = self.space[data]
        cut[1:-1] |= space[1:] & ~space[:-1]  # white space goes with what follows it, and is taken off
        edges, which, fragments = distinct(pa.py_buffer(data), cut, offsets, " \t\n\v\f\r")
        known = self.known.get(fragments)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, ends = ragged(np.frombuffer(b"".join(known), "<u4"), sizes, which)
        return ids, np.append(0, ends)[np.searchsorted(edges, offsets[1:])]

    def encode_batch(self, texts: pa.Array):
        """(ids of all texts after each other, end of each text in them); null is the empty text."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        has = np.zeros(len(texts), bool)
        for s in self.specials:
            has |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ids, ends = self._encode_plain(pc.if_else(pa.array(has), "", texts) if has.any() else texts)
        if has.any():
            rows = np.flatnonzero(has)
            whole = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)]
            sizes = np.zeros(len(texts), np.int64)
            sizes[rows] = [len(w) for w in whole]
            ids = np.insert(ids, np.repeat(ends[rows], sizes[rows]), np.concatenate(whole))
            ends = ends + np.cumsum(sizes)
        return ids, ends


def marks(ids, run: int = RUN, bits: int = MASK_BITS):
    """Places after which a cut may be, by a rolling polynomial hash of the last run ids."""
    import numpy as np

    n = len(ids)
    if n < run:
        return np.zeros(0, np.int64)
    h = np.zeros(n - run + 1, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : n - run + 1 + k]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + run


def cuts(n: int, marks: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a document of n ids; marks are those within it, counted from its first id."""
    out, begin = [], 0
    if n <= least:
        return [n]
    for m in [*marks, n]:
        while m - begin > most:
            begin += most
            out.append(begin)
        if m - begin >= least and m < n:
            begin = m
            out.append(m)
    if not out or out[-1] < n:
        out.append(n)
    return out


def with_end(ids, ends, end_id: int = END_ID):
    """ids and ends with the end id after each document."""
    import numpy as np

    return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


def unpack(data: bytes, n: int):
    import numpy as np

    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def chunk_name(n: int, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=n.to_bytes(8, "little")).digest()


_encoders: dict[str, WordEncoder] = {}


def _chunks(path: str):
    def run(batches):
        import numpy as np

        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        for batch in batches:
            ids, ends = with_end(*encoder.encode_batch(batch.column(2)))
            begins = np.append(0, ends[:-1])
            found = marks(ids)
            # a mark counts if the ids it looks back on are all of its document
            doc = np.searchsorted(ends, found, "left")
            inside = found - begins[doc]
            fits = inside >= RUN
            found, doc = inside[fits], doc[fits]
            bounds = np.searchsorted(doc, np.arange(len(ends) + 1)).tolist()
            found = found.tolist()
            at, seqs, stops = [], [], []
            for row, (a, n) in enumerate(zip(begins.tolist(), (ends - begins).tolist())):
                own = cuts(n, found[bounds[row] : bounds[row + 1]])
                at += [row] * len(own)
                seqs += range(len(own))
                stops += [a + x for x in own]
            stops = np.array(stops, np.int64)
            sizes = np.diff(np.append(0, stops))
            wide = np.maximum.reduceat(ids, stops - sizes) >= 1 << 16 if len(stops) else []
            short, long = ids.astype("<u2").tobytes(), ids.tobytes()
            datas = [long[4 * (z - n) : 4 * z] if w else short[2 * (z - n) : 2 * z] for z, n, w in zip(stops.tolist(), sizes.tolist(), wide)]
            names = [chunk_name(n, d) for n, d in zip(sizes.tolist(), datas)]
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(place), batch.column(1).take(place), pa.array(seqs, pa.int32()), pa.array(names, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(datas, pa.binary())], ["id", "row", "seq", "name", "n", "data"]
            )

    return run


#: Merkle root over an array of binary values in order, as a SQL expression; n values have ceil(log2 n) levels.
def merkle(col: str) -> F.Column:
    level = "transform(sequence(0, greatest(0, int((size(a) - 1) div 2))), i -> unhex(sha2(concat(a[2 * i], coalesce(get(a, 2 * i + 1), X'')), 256)))"
    return F.expr(f"aggregate(sequence(1, 1 + int(ceil(log2(greatest(1, size({col})))))), {col}, (a, k) -> {level}, a -> a[0])")


def _shards(roots: DataFrame, parts: int, size: int) -> DataFrame:
    """roots(id, root, row) with their shard, in ascending order: ranges of (id, root, row), so that one id, or none at all, is dealt as any other.

    A range is cut again after every `size` rows, so a shard has no more than that, whatever the number of ranges.
    """
    order = [F.col("id").asc_nulls_first(), "root", "row"]
    dealt = roots.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("shard", F.shiftright("_m", 33) * F.lit(PART) + F.floor(inside / size)).drop("_m")


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_chunks: int = SHARD_CHUNKS) -> None:
    """Encodes docs and writes a store; path is a folder that all executors can write."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    coded = written(rows.mapInArrow(_chunks(tokenizer), "id long, row long, seq int, name binary, n int, data binary"), "coded")
    coded.groupBy("name").agg(F.first("n").alias("n"), F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    names = coded.select("id", "row", "seq", "name", "n")
    parts = min(SHARDS, max(1, -(-names.count() // shard_chunks)))
    names.repartitionByRange(parts, F.col("id").asc_nulls_first(), "row", "seq").sortWithinPartitions("id", "row", "seq").write.option("compression", "zstd").parquet(f"{path}/recipes")
    per_doc = names.groupBy("id", "row").agg(F.count("*").cast("int").alias("n_chunks"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("names"))
    roots = written(per_doc.withColumn("root", merkle("names.name")).drop("names"), "roots")
    _shards(roots, parts, shard_chunks).write.option("compression", "zstd").parquet(f"{path}/manifest")
    shard_table(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/shards")
    drop(coded)
    drop(roots)


def shard_table(manifest: DataFrame) -> DataFrame:
    per_shard = manifest.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("id", "root", "row"))).alias("roots"))
    return per_shard.withColumn("root", merkle("roots.root")).drop("roots")


def _verify_chunks(batches):
    """Hashes stored chunks again; gives the CRC of their ids as 4-byte integers."""
    for batch in batches:
        crcs = []
        for name, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if chunk_name(n, data) != name:
                raise ValueError(f"chunk {name.hex()} does not match its name")
            crcs.append(zlib.crc32(unpack(data, n).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64())], ["name", "crc"])


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


_zeros: dict[int, list[int]] = {}


def crc_shift(n_bytes: int) -> list[int]:
    """The linear map of a CRC-32 over so many zero bytes, as 32 columns."""
    if n_bytes not in _zeros:
        if n_bytes == 1:
            m = [0] * 32
            for i in range(32):
                c = 1 << i
                for _ in range(8):
                    c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
                m[i] = c
        else:
            half = crc_shift(n_bytes // 2)
            m = [_times(half, x) for x in half]
            if n_bytes % 2:
                one = crc_shift(1)
                m = [_times(one, x) for x in m]
        _zeros[n_bytes] = m
    return _zeros[n_bytes]


def combine(crc: int, more: int, n_bytes: int) -> int:
    """CRC-32 of a string followed by another of n_bytes, from theirs."""
    return _times(crc_shift(n_bytes), crc) ^ more if n_bytes else crc


def _combine_rows(batches):
    """Puts the CRCs of a document's chunks together; parts come last, the other columns are handed on."""
    for batch in batches:
        out = []
        for parts in batch.column(batch.num_columns - 1).to_pylist():
            crc = 0
            for p in parts:
                crc = combine(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], [*batch.schema.names[:-1], "crc"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, row, start, n_tokens, root, crc) of every document, all read from the files and verified."""
    chunks = spark.read.parquet(f"{path}/chunks").select("name", "n", "data").mapInArrow(_verify_chunks, "name binary, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    found = recipes.join(chunks, "name", "left").withColumn("crc", F.coalesce("crc", F.raise_error(F.concat(F.lit("missing chunk "), F.hex("name"))).cast("long")))
    docs = found.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "name"))).alias("parts"))
    docs = docs.withColumn("root", merkle("parts.name"))
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "id", "row", F.col("n_tokens").alias("said"), F.col("root").alias("said_root"))
    docs = manifest.join(docs, "row", "left")
    wrong = F.coalesce((F.col("said") != F.col("n_tokens")) | (F.col("said_root") != F.col("root")), F.lit(True))
    docs = docs.withColumn("root", F.when(wrong, F.raise_error(F.concat(F.lit("document fails its manifest: "), F.col("id").cast("string"))).cast("binary")).otherwise(F.col("root")))
    # ids before a shard are in its table, those before a document within the shard are summed there
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "n_tokens", F.floor(F.col("shard") / PART).alias("part"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("_first"))  # SHARDS rows at most
    shards = shards.join(parts, "part").select("shard", (F.col("_first") + before(Window.partitionBy("part").orderBy("shard"))).alias("before"))
    docs = docs.join(shards, "shard")
    inside = Window.partitionBy("shard").orderBy(F.col("id").asc_nulls_first(), "said_root", "row").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.col("before") + F.coalesce(F.sum("said").over(inside), F.lit(0)))
    parts = F.transform("parts", lambda p: F.struct(p["n"].alias("n"), p["crc"].alias("crc"))).alias("parts")
    return docs.select("id", "row", "start", "n_tokens", "root", parts).mapInArrow(_combine_rows, "id long, row long, start long, n_tokens long, root binary, crc long")


def verify_shards(spark: SparkSession, path: str) -> None:
    """Raises unless each shard's root is that of its manifest."""
    said = spark.read.parquet(f"{path}/shards")
    now = shard_table(spark.read.parquet(f"{path}/manifest")).withColumnsRenamed({"root": "root2", "n_docs": "n2", "n_tokens": "t2"})
    bad = said.join(now, "shard", "full").where("NOT (root <=> root2 AND n_docs <=> n2 AND n_tokens <=> t2)").limit(1).count()
    if bad:
        raise ValueError("a shard fails its Merkle root")


def _rebuild(batches):
    for batch in batches:
        ids = [[int(i) for p in parts for i in unpack(p["data"], p["n"])] for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["id", "row", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, row, ids) of every document, put together from the stored chunks."""
    chunks = spark.read.parquet(f"{path}/chunks").select("name", "data")
    parts = spark.read.parquet(f"{path}/recipes").join(chunks, "name").groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "data"))).alias("parts"))
    return parts.mapInArrow(_rebuild, "id long, row long, ids array<bigint>")


def op1_token_store(spark, sf_dir):
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    verify_shards(spark, path)
    return read_index(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
