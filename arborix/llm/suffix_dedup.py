"""Removal of long byte strings that occur more than once, by merging shard Burrows-Wheeler transforms.

Every start of a `length`-byte string belongs to the smallest k-mer hash of its string, so equal strings belong to equal
k-mers at equal offsets. Consecutive starts of one k-mer are a run. Runs are compared within their k-mer only:

1. Runs whose whole text occurs twice are repeats throughout; k-mers with one run have none. Only k-mers
   that have several different run texts are left, and of these one copy of each text.
2. These texts are dealt by k-mer. In a task, bundles of k-mers are cut into shards. A shard's suffixes are
   sorted by their blocks of BLOCK bytes, which gives its Burrows-Wheeler transform. The transforms are merged
   by refining their interleave: a pass sorts it stably by the symbols before its suffixes, so it is
   ordered by one symbol more; no suffixes of the union are sorted. The passes carry the common prefixes along;
   after length / BLOCK passes suffixes that share `length` bytes are one interval, and intervals of two or more are repeats.
3. A k-mer with more than HOT different texts would not fit a task: the digests of its strings are dealt into as many
   buckets as it takes, and equal ones are found in each. A bucket is read as a stream, of which a task keeps the different digests.

Disk: k-mers that occur once, which most do, are left out before runs are compared; documents are compressed one by one before they
are sent to a join; a table is deleted, and shuffle files are released, as soon as no later step reads them.

Texts and strings of hot k-mers are equal if their 128-bit BLAKE2b digests are; the others are compared as symbols. Runs whose
text is among the FREQUENT most frequent ones are marked by a broadcast of that many digests, so no task gets all of them.

Positions are bytes of the UTF-8 text.

Defined cases: null is the empty text; texts shorter than `length` are kept whole; every row is a document of its own, whether
its id is null, or repeats with the same or another text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop, released, small_batches, table, written

LENGTH, KMER, BLOCK = 400, 32, 100
SHARDS, BUNDLE, HOT = 4, 1 << 20, 2000
#: Bytes of text that are hashed at once; positions in so many, and one text more, fit POSITION_BITS.
PORTION, POSITION_BITS = 4 << 20, 24
#: The number of run texts that are broadcast, and how often each occurs at least.
FREQUENT, OFTEN = 10_000, 1000
BASE = 0x9E3779B97F4A7C15


def _hashes(data, size: int):
    """Polynomial hashes modulo 2^64 of all strings of so many bytes, mixed."""
    import numpy as np

    h, n = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & n:
                # hash of `done` bytes, then of n more
                out = h.copy() if out is None else out[: len(data) - done - n + 1] * np.uint64(pow(BASE, n, 1 << 64)) + h[done : len(data) - n + 1]
                done += n
            if done == size:
                break
            h = h[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + h[n:] if len(h) > n else h[:0]
            n *= 2
        out = out ^ (out >> np.uint64(31))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out = out * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(32))


def find_runs(texts: list[bytes], length: int = LENGTH, kmer: int = KMER, portion: int = PORTION):
    """Yields (row, first start, last start, k-mer hash as a signed long, text of the run).

    Longer texts are taken in portions that overlap by length - 1 bytes, so that all starts are hashed alike.
    """
    import numpy as np

    long = [(r, o, t[o : o + portion + length - 1] if len(t) > portion else t) for r, t in enumerate(texts) for o in range(0, len(t) - length + 1, portion)]
    begin, low = 0, np.uint64((1 << POSITION_BITS) - 1)
    while begin < len(long):
        some, size = [], 0
        while begin < len(long) and (not some or size < portion):
            some.append(long[begin])
            size += len(long[begin][2])
            begin += 1
        joined = b"".join(t for _, _, t in some)
        data = np.frombuffer(joined, np.uint8)
        hashes = _hashes(data, kmer)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        wide, n = length - kmer + 1, 1
        while 2 * n <= wide:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < wide:
            least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
        where = (least & low).astype(np.int64)
        at = 0
        for row, offset, t in some:
            starts = where[at : at + len(t) - length + 1]
            cuts = np.flatnonzero(starts[1:] != starts[:-1]) + 1
            first = [0, *cuts.tolist()]
            last = [*(cuts - 1).tolist(), len(starts) - 1]
            for a, z in zip(first, last):
                yield row, a + offset, z + offset, int(hashes[starts[a]].astype(np.int64)), t[a : z + length]
            at += len(t)


def _runs(length: int):
    def run(batches):
        for batch in batches:
            rows, a, z, h, d = [], [], [], [], []
            for row, first, last, key, text in find_runs(batch.column(1).to_pylist(), length):
                rows.append(row)
                a.append(first)
                z.append(last)
                h.append(key)
                d.append(hashlib.blake2b(text, digest_size=16).digest())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(h, pa.int64()), pa.array(d, pa.binary())], ["id", "v", "a", "z", "h", "d"])

    return run


def stable_order(values):
    """The stable order of integers >= 0; where they leave room for the places, these are sorted along, which is faster than an argsort."""
    import numpy as np

    bits = len(values).bit_length()
    if int(values.max(initial=0)) >> (63 - bits):
        return np.argsort(values, kind="stable")
    return np.sort(values << bits | np.arange(len(values))) & ((1 << bits) - 1)


def shard_bwt(own, ends, depth: int, offset: int):
    """Suffixes of one shard in order, by up to depth symbols, and the symbol before each.

    own: the symbol (>= 1) of the block at each byte; ends: the last byte of its text at which a block fits. A chain is the
    blocks of a text that are BLOCK bytes apart; at its end it has an empty suffix, which sorts first and has position -1.
    """
    import numpy as np

    real = np.flatnonzero(np.arange(len(own)) <= ends)
    place = np.full(len(own), -1, np.int64)
    place[real] = np.arange(len(real))
    names = own[real]
    following = np.where(real + BLOCK <= ends[real], place[np.minimum(real + BLOCK, len(own) - 1)], -1)
    rank, hop, step = names.astype(np.int64), following, 1
    order = stable_order(rank)
    while step < depth:
        after = np.where(hop >= 0, rank[hop], 0)
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = stable_order(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(new)
        hop = np.where(hop >= 0, hop[hop], -1)
        step *= 2
    before = np.zeros(len(real), np.int64)
    before[following[following >= 0]] = names[following >= 0]
    lasts = names[following < 0]
    return np.concatenate([np.full(len(lasts), -1), real[order] + offset]), np.concatenate([lasts, before[order]])


def merge_bwts(shards, passes: int):
    """Merges [(positions, symbols before)] of shards. Gives the interleave, as shard numbers, and the class of each suffix by its first `passes` symbols."""
    import numpy as np

    z = np.concatenate([np.full(len(s), k, np.int16) for k, (s, _) in enumerate(shards)])
    same = np.zeros(len(z), np.int64)
    for _ in range(passes):
        symbols = np.empty(len(z), np.int64)
        for k, (_, b) in enumerate(shards):
            symbols[z == k] = b
        perm = stable_order(symbols)
        z, symbols, before = z[perm], symbols[perm], same[perm]
        new = np.ones(len(z), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | ((before[1:] != before[:-1]) & (symbols[1:] != 0))
        same = np.cumsum(new)
    return z, same


def repeated_starts(texts: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> list[list[int]]:
    """For each text the starts whose `length` bytes also start at another place of the texts."""
    import numpy as np

    if length % BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK}")
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    _, names = np.unique(_hashes(data, BLOCK), return_inverse=True)
    parts, made = np.array_split(np.arange(len(texts)), min(shards, len(texts))), []
    for part in parts:
        lo, hi = begins[part[0]], begins[part[-1]] + sizes[part[-1]]
        ends = np.repeat(begins[part] + sizes[part] - BLOCK, sizes[part]) - lo
        own = names[np.minimum(np.arange(lo, hi), len(names) - 1)] + 1
        made.append(shard_bwt(own, ends, length // BLOCK, lo))
    z, same = merge_bwts(made, length // BLOCK)
    at = np.empty(len(z), np.int64)
    for k, (positions, _) in enumerate(made):
        at[z == k] = positions
    sizes_of = np.bincount(same)
    hit = np.sort(at[(sizes_of[same] > 1) & (at >= 0)])
    text = np.searchsorted(begins, hit, "right") - 1
    start = hit - begins[text]
    full = start + length <= sizes[text]
    out: list[list[int]] = [[] for _ in texts]
    for t, s in zip(text[full].tolist(), start[full].tolist()):
        out[t].append(s)
    return out


def intervals(starts: list[int]) -> list[dict]:
    out: list[dict] = []
    for s in starts:
        if out and s == out[-1]["z"] + 1:
            out[-1]["z"] = s
        else:
            out.append({"a": s, "z": s})
    return out


_SPANS = "array<struct<a:int,z:int>>"


def _contested(length: int):
    def run(batches):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))

        def solve():
            found = [intervals(s) for s in repeated_starts([t for _, _, t in held], length)]
            return pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in held], pa.int64()), pa.array([d for _, d, _ in held], pa.binary()), pa.array(found, kind)], ["h", "d", "spans"])

        held, size = [], 0
        for batch in batches:
            for h, d, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size > BUNDLE and h != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                if held and (h, d) == held[-1][:2]:
                    continue
                held.append((h, d, t))
                size += len(t)
        if held:
            yield solve()

    return run


def _windows(length: int, hot: int):
    """The starts and digests of a text's strings, one row for each bucket of its k-mer that it has some in."""

    def run(batches):
        from collections import defaultdict

        for batch in batches:
            rows, buckets, starts, digests = [], [], [], []
            for r, (t, texts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                n, of = 1 + 2 * texts // hot, defaultdict(list)
                for s in range(len(t) - length + 1):
                    w = hashlib.blake2b(t[s : s + length], digest_size=16).digest()
                    of[int.from_bytes(w[:8], "little") % n].append((s, w))
                for b, found in of.items():
                    rows.append(r)
                    buckets.append(b)
                    starts.append([s for s, _ in found])
                    digests.append(b"".join(w for _, w in found))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(buckets, pa.int64()), batch.column(1).take(at), pa.array(starts, pa.list_(pa.int32())), pa.array(digests, pa.binary())], ["h", "b", "d", "s", "w"])

    return run


def _equal_windows(batches):
    """Starts whose digest occurs twice in a bucket; rows come in the order of (h, b, d)."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
    now, text, seen = None, None, {}  # digest -> its first place, until that is handed on too
    for batch in batches:
        hs, ds, found = [], [], []
        for h, b, d, starts, w in zip(*(c.to_pylist() for c in batch.columns)):
            if (h, b) != now:
                now, text, seen = (h, b), None, {}
            if d == text:
                continue
            text, again = d, []
            for k, s in enumerate(starts):
                x = w[16 * k : 16 * k + 16]
                if x not in seen:
                    seen[x] = (d, s)
                    continue
                again.append(s)
                if seen[x]:
                    first, at = seen[x]
                    seen[x] = None
                    hs.append(h)
                    ds.append(first)
                    found.append([{"a": at, "z": at}])
            if again:
                hs.append(h)
                ds.append(d)
                found.append(intervals(again))
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ds, pa.binary()), pa.array(found, kind)], ["h", "d", "spans"])


def _packed(batches):
    """Compresses the texts (column 1), which then go through a shuffle, and adds their sizes."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        packed = [codec.compress(t, asbytes=True) for t in texts]
        yield batch.set_column(1, "t", pa.array(packed, pa.binary())).append_column("size", pa.array(map(len, texts), pa.int64()))


def _unpacked(codec, packed: bytes, size: int) -> bytes:
    return codec.decompress(packed, size, asbytes=True) if size else b""


def _texts(length: int):
    """Cuts the texts of runs out of their packed documents; a row that repeats the one before is passed over."""

    def run(batches):
        codec, last = pa.Codec("zstd"), None
        for batch in batches:
            h, d, out, texts = [], [], [], []
            for packed, size, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                if wanted == last:
                    continue
                last, t = wanted, _unpacked(codec, packed, size)
                for w in wanted:
                    h.append(w["h"])
                    d.append(w["d"])
                    out.append(t[w["a"] : w["z"] + length])
                    texts.append(w["texts"])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.binary()), pa.array(out, pa.binary()), pa.array(texts, pa.int64())], ["h", "d", "t", "texts"])

    return run


def _cut(length: int):
    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            n, gone, spans, sha, kept = [], [], [], [], []
            for packed, size, found in zip(*(c.to_pylist() for c in batch.columns[1:])):
                t = _unpacked(codec, packed, size)
                merged: list[list[int]] = []
                for s in sorted(found or [], key=lambda s: s["a"]):
                    b, e = s["a"], s["z"] + length
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([b, e])
                parts, at = [], 0
                for b, e in merged:
                    parts.append(t[at:b])
                    at = e
                left = b"".join([*parts, t[at:]])
                n.append(len(t))
                gone.append(len(t) - len(left))
                spans.append([{"a": b, "z": e} for b, e in merged])
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(sha), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (removed byte ranges), kept_sha256, kept (the remaining bytes)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("t"), F.xxhash64(as_bytes(text_col)).alias("v"))
    every = written(texts.mapInArrow(_runs(length), f"id {kind}, v long, a int, z int, h long, d binary"), "allruns")
    # the run of a k-mer that occurs once is no repeat and contests none; read back, both sides are plain, so that a hot k-mer can be split
    again = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    runs = written(every.join(again, "h", "left_semi").select(every.columns), "runs")
    drop(every)
    drop(again)
    released(docs.sparkSession)
    # one row for each text of a k-mer; how many different ones the k-mer has decides how it goes on
    kinds = written(runs.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("id", "v", "a", "z")).alias("one")), "runkinds")
    several = written(kinds.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1"), "several")
    contested = kinds.join(several, "h").select("one", F.struct("h", "d", F.col("one.a").alias("a"), F.col("one.z").alias("z"), "texts").alias("run"))
    wanted = contested.groupBy(F.col("one.id").alias("id2"), F.col("one.v").alias("v2")).agg(F.collect_list("run").alias("runs"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("v") == F.col("v2"))
    packed = texts.mapInArrow(_packed, f"id {kind}, t binary, v long, size long")
    cut = packed.join(wanted, same).select("t", "size", "runs").mapInArrow(_texts(length), "h long, d binary, t binary, texts long")
    cut = written(cut, "contested", compression="zstd")
    released(docs.sparkSession)
    by_bwt = cut.where(F.col("texts") <= hot).select("h", "d", "t").repartition("h").sortWithinPartitions("h", "d").mapInArrow(_contested(length), f"h long, d binary, spans {_SPANS}")
    windows = cut.where(F.col("texts") > hot).select("h", "d", "t", "texts").mapInArrow(_windows(length, hot), "h long, b long, d binary, s array<int>, w binary")
    by_count = windows.repartition("h", "b").sortWithinPartitions("h", "b", "d").mapInArrow(_equal_windows, f"h long, d binary, spans {_SPANS}")
    found = by_bwt.unionByName(by_count).where(F.size("spans") > 0).groupBy("h", "d").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # a run whose text occurs again is a repeat from end to end
    often = written(kinds.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h", "d").limit(FREQUENT).select("h", "d", F.lit(True).alias("often")), "often")
    marked = runs.join(F.broadcast(often), ["h", "d"], "left")
    itself = F.array(F.struct("a", "z")).alias("spans")
    whole = marked.where("often").select("id", "v", itself)
    rare = marked.where("often IS NULL").join(kinds.where(F.col("n") < OFTEN).select("h", "d", "n").unionByName(kinds.where(F.col("n") >= OFTEN).select("h", "d", "n").join(often.select("h", "d"), ["h", "d"], "left_anti")).join(found, ["h", "d"], "left").where("n > 1 OR spans IS NOT NULL"), ["h", "d"])
    moved = F.when(F.col("n") > 1, F.array(F.struct("a", "z"))).otherwise(F.expr("transform(spans, s -> struct(s.a + a AS a, s.z + a AS z))"))
    spans = whole.unionByName(rare.select("id", "v", moved.alias("spans"))).groupBy(F.col("id").alias("id2"), F.col("v").alias("v2")).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    spans = written(spans, "spans")
    for over in (runs, kinds, several, cut, often):
        drop(over)
    released(docs.sparkSession)
    out = packed.join(spans, same, "left").select("id", "t", "size", "spans").mapInArrow(_cut(length), f"id {kind}, n_bytes long, n_removed long, spans array<struct<a:long,z:long>>, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
