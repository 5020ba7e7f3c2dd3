"""SimHash near-duplicates by multi-index hashing.

Fingerprints come from word shingles; a bit is set if it is set in over half of the shingle hashes. Only
distinct fingerprints are linked. The 64 bits are cut into segments, each with a table keyed by the segment's value.
Of two fingerprints within the radius some segment differs by radius / segments bits at most, so each looks up a Hamming ball of that radius around its
value in every table, and what it meets is verified by the complete distance. Of two values one bit apart only the one with an odd number of
set bits looks the other up.

A value that very many fingerprints have is split: there the rest of a fingerprint is the key, with one bit flipped or none, on both sides.
Two that are within the radius meet at the rest in the middle, and at most 65 fingerprints can meet at one, so no key is hot.
Documents then get the smallest id of their fingerprint's connected component.

Defined cases: a null or empty text has fingerprint zero and links like any other; texts shorter than a
shingle give one shingle of all their words; repeated rows give repeated results; a null id is a row of its own that gets the
component of its fingerprint and is never a component's name unless all its ids are null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import as_bytes, small_batches, table, without, written
from .streams import dealt, runs

SEGMENTS = 2
#: Fingerprints with one value of a segment beyond which its table is split.
CROWD = 1000
SEED = 42


def _majority(hashes) -> int:
    """The fingerprint of shingle hashes, as a signed long."""
    import numpy as np

    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(size: int):
    def run(batches):
        import numpy as np
        import xxhash

        join, h = b" ".join, xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D
                if not words:
                    out.append(0)
                    continue
                parts = map(join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [join(words)]
                hashes = np.fromiter(map(h, parts, repeat(SEED)), "<u8")
                out.append(_majority(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("t")).mapInArrow(_fingerprints(shingle), f"id {kind}, fp long")


def links(prints: DataFrame, radius: int = 2, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(u, v): verified links between distinct fingerprints; their components are those of all pairs within the radius."""
    if radius not in (1, 2) or segments < 2 or 64 % segments:
        raise ValueError("radius 1 or 2, and segments that divide the 64 bits")
    width = 64 // segments
    near = radius // segments  # differing bits of the segment that differs least
    whole = prints.select("fp").where("fp IS NOT NULL").distinct()
    bits = "-1L" if width == 64 else f"{(1 << width) - 1}L"
    value = F.expr(f"transform(sequence(0, {segments - 1}), s -> struct(s AS seg, shiftrightunsigned(fp, s * {width}) & {bits} AS value))")
    tables = whole.select("fp", F.explode(value).alias("t")).select("fp", "t.*")
    crowded = tables.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "value", F.lit(True).alias("split"))
    stored = tables.join(crowded, ["seg", "value"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    # the fingerprint outside of the segment, as it is and with each bit flipped
    rest = f"fp & ~shiftleft({bits}, seg * {width})"
    flips = f"transform(filter(sequence(0, 63), i -> i div {width} <> seg), i -> ({rest}) ^ shiftleft(1L, i))"
    by_rest = F.explode(F.expr(f"IF(split, concat(array({rest}), {flips}), array(0L))")).alias("rest")
    ball = "array(value)"
    if near:
        ball = f"IF(bit_count(value) % 2 = 1, concat(array(value), transform(sequence(0, {width - 1}), i -> value ^ shiftleft(1L, i))), array(value))"
    probes = tables.select("fp", "seg", F.explode(F.expr(ball)).alias("value")).join(crowded, ["seg", "value"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    left = probes.select(F.col("fp").alias("u"), "seg", "value", "split", by_rest)
    right = stored.select(F.col("fp").alias("v"), "seg", "value", "split", by_rest)
    met = left.join(right, ["seg", "value", "split", "rest"]).where("u <> v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp, component_id."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = connected_components(links(prints, radius))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    named = least.join(nodes, least.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "component").join(of, "component").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op5_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by a similarity. The fingerprint tables above come first: what they link within the radius is checked exactly by the shingle
# sets and gives the first links. Texts whose shingle sets have a Jaccard similarity of 0.8 differ in about 10 of the 64 bits, though, beyond
# what Hamming balls of segments can reach at a bearable number of probes. For what they leave, further segments are minwise: each holds
# ROWS minima of the shingle hashes, similar texts share a whole segment with probability 1 - (1 - s^ROWS)^BANDS, and
# what the segment tables give is verified: with complete signatures first, then exactly by the shingle sets.

#: A signature's share of equal slots may be so much below the similarity, four standard errors.
BANDS, ROWS, SLOTS, MARGIN = 20, 5, 256, 0.1
#: Members of a bucket in a block, with so many shingles at most if there are several.
BLOCK, SHINGLES = 512, 500_000
#: Members of a bucket's largest group that all others are compared with before the rest.
TRIES = 8


def _signatures(size: int):
    """(id, v, fp, set, size, sig, keys): the fingerprint, a digest of the shingle set, its size, its minwise signature and the keys of its segments."""

    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import xxhash

        join, h = b" ".join, xxhash.xxh64_intdigest
        odd = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SLOTS), dtype=np.uint64)
        times, plus = odd[0][:, None] * np.uint64(2) + np.uint64(1), odd[1][:, None]
        for batch in batches:
            prints, sets, sizes, sig, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                parts = map(join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [join(words)]
                hashes = np.fromiter(map(h, parts, repeat(SEED)), "<u8")
                prints.append(_majority(hashes) if words else 0)
                hashes = np.unique(hashes)
                sets.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(hashes), 4096):
                    part = (hashes[at : at + 4096] ^ plus) * times
                    np.minimum(least, part.min(axis=1), out=least)
                mixed = least ^ (least >> np.uint64(33))
                sig.append(mixed.astype("<u2").tobytes())
                keys.append([_signed(h(least[b * ROWS : b * ROWS + ROWS].tobytes(), b)) for b in range(BANDS)])
            columns = [batch.column("id"), batch.column("v"), pa.array(prints, pa.int64()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "fp", "set", "size", "sig", "keys"])

    return run


def _sets(size: int):
    def run(batches):
        import numpy as np
        import xxhash

        join, h = b" ".join, xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                parts = map(join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [join(words)]
                out.append(np.unique(np.fromiter(map(h, parts, repeat(SEED)), np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "shingles"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _agree(batches):
    import numpy as np

    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SLOTS) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1))], ["u", "v", "share"])


def _similar(similarity: float):
    """The pairs (u, v, a, b) whose shingle sets a and b are similar enough."""

    def run(batches):
        import numpy as np

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
                keep.append(common >= similarity * ((len(a) + len(b)) // 8 - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _within(signed: DataFrame, one: DataFrame, radius: int) -> DataFrame:
    """(u, v): what the fingerprint tables link within the radius; of the sets of one fingerprint each meets the first."""
    prints = written(signed.select("set", "fp").distinct().join(one.select("set", "rep"), "set").select("rep", "fp"), "prints")
    first = prints.groupBy("fp").agg(F.min("rep").alias("first"))
    same = prints.join(first, "fp").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    near = links(prints, radius).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.union(near.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _met(buckets: DataFrame, near: DataFrame) -> DataFrame:
    """(u, v): the members of minwise buckets with the two ends of theirs, but for the pairs near that the fingerprints gave."""
    met = buckets.select("rep", F.explode(F.array("a", "b")).alias("end")).where("rep <> end")
    pairs = met.select(F.least("rep", "end").alias("u"), F.greatest("rep", "end").alias("v")).distinct()
    return pairs.join(near, ["u", "v"], "left_anti")


def _verified(pairs: DataFrame, one: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs that are similar enough, by their signatures first and then exactly by their shingle sets."""
    sigs, s = one.select("rep", "sig"), sets.select("rep", "shingles")
    both = pairs.join(sigs.withColumnsRenamed({"rep": "u", "sig": "su"}), "u").join(sigs.withColumnsRenamed({"rep": "v", "sig": "sv"}), "v")
    maybe = both.select("u", "v", "su", "sv").mapInArrow(_agree, "u long, v long, share double").where(F.col("share") >= similarity - MARGIN)
    full = maybe.join(s.withColumnsRenamed({"rep": "u", "shingles": "a"}), "u").join(s.withColumnsRenamed({"rep": "v", "shingles": "b"}), "v")
    return full.select("u", "v", "a", "b").mapInArrow(_similar(similarity), "u long, v long")


def _probed(least: float, similarity: float):
    """Blocks of a bucket's members, each followed by probes -> (u, v): links of probes to members of other groups.

    A pair is compared in its first common band only. Once a probe's group and another are joined by a link, no more pairs between them are compared,
    so there are fewer links than groups.
    """

    def run(batches):
        import numpy as np

        def columns(rows):
            return (
                rows.column("rep").to_numpy(),
                rows.column("comp").to_numpy().copy(),
                np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, SLOTS),
                [np.frombuffer(s, "<u8") for s in rows.column("shingles").to_pylist()],
                np.array(rows.column("keys").to_pylist(), np.int64).reshape(-1, BANDS),
            )

        now, held, block, names = None, [], None, {}
        for key, kind, rows in runs(batches, ["band", "key", "class", "block"]):
            if key != now:
                now, held, block, names = key, [], None, {}
            if kind == 0:
                held.append(rows)
                continue
            if not held:
                continue
            block = block or columns(pa.Table.from_batches(held))
            rep, comp, sig, sets, keys = block
            band, u, v = int(key[0]), [], []
            for x, own, x_sig, x_set, x_keys in zip(*columns(rows)):
                while own in names:
                    own = names[own]
                other = np.flatnonzero(comp != own)
                if band and len(other):
                    other = other[~(keys[other, :band] == x_keys[:band]).any(axis=1)]
                if len(other):
                    other = other[(sig[other] == x_sig).mean(axis=1) >= least]
                for y in other:
                    if comp[y] != own:
                        common = len(np.intersect1d(x_set, sets[y], assume_unique=True))
                        if common >= similarity * (len(x_set) + len(sets[y]) - common) - 1e-9:
                            u.append(x)
                            v.append(rep[y])
                            names[int(comp[y])] = own
                            comp[comp == comp[y]] = own
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _named(buckets: DataFrame, close: DataFrame) -> DataFrame:
    """buckets(rep, band, key) that have members of several groups of close: with each member's group and the bucket's largest one."""
    groups = connected_components(close).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    named = written(buckets.join(groups, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "members")
    most = named.groupBy("band", "key", "comp").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count("*").alias("groups"))
    most = written(most.where("groups > 1").select("band", "key", "most"), "most")
    return written(named.join(most, ["band", "key"]), "mixed")


def _rest(mixed: DataFrame, one: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links from the members that are not in their bucket's largest group to all others of the bucket.

    A bucket's members are dealt into classes of set sizes, a class reaching only its neighbours, and a class into blocks. Members of the largest group are in one block each; only the others are
    sent to several.
    """
    full = mixed.join(one.select("rep", "sig", "keys", F.floor(F.log("size") / F.log(F.lit(1 / similarity))).cast("int").alias("class")), "rep").join(sets, "rep")
    held = F.greatest(F.lit(1), F.least(F.lit(float(BLOCK)), F.lit(float(SHINGLES)) * F.pow(F.lit(similarity), F.col("class") + 1))).cast("int")
    sizes = mixed.join(one.select("rep", F.floor(F.log("size") / F.log(F.lit(1 / similarity))).cast("int").alias("class")), "rep")
    sizes = written(sizes.groupBy("band", "key", "class").agg(F.count("*").alias("n")).select("band", "key", "class", F.ceil(F.col("n") / held).cast("int").alias("blocks")), "classes")
    members = full.join(sizes, ["band", "key", "class"]).withColumn("block", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    probes = full.where("comp <> most").withColumn("class", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1))).join(sizes, ["band", "key", "class"])
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = ["band", "key", "class", "block", "rep", "comp", "sig", "keys", "shingles"]
    return dealt([members.select(*out), probes.select(*out)], out[:4]).mapInArrow(_probed(similarity - MARGIN, similarity), "u long, v long")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(id, text_hash, component_id, kept_hash) of the documents that have near duplicates: component_id is the smallest id of the group, null last, and kept_hash
    tells the text of that row, if its id has several. Texts are told apart by xxhash64.

    Links within the radius come from the fingerprint tables, all others from the minwise ones, where all members of a bucket are compared. First each with the two ends of its bucket, which are other ones in each table and link most groups. Where that leaves several groups in a bucket,
    the members outside of the largest one are compared with TRIES of its members, and then, outside of what is the largest now, with all
    others of the bucket. Documents whose shingle sets are equal are one for this.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("t")).withColumn("v", F.xxhash64("t"))
    signed = rows.select("id", "t", "v").mapInArrow(_signatures(shingle), f"id {kind}, v long, fp long, set binary, size int, sig binary, keys array<bigint>")
    signed = written(signed, "signatures")
    one = signed.groupBy("set").agg(F.min(F.struct("v", "id")).alias("who"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    one = written(one.withColumn("rep", F.monotonically_increasing_id()), "sigs")
    near = written(_within(signed, one, radius), "near")
    keys = one.select("rep", F.posexplode("keys").alias("band", "key")).withColumn("order", F.xxhash64("band", "rep"))
    ends = keys.groupBy("band", "key").agg(F.min_by("rep", "order").alias("a"), F.max_by("rep", "order").alias("b")).where("a <> b")
    ends = written(ends, "ends")
    buckets = written(keys.drop("order").join(ends, ["band", "key"]), "buckets")
    reps = buckets.select("rep").union(near.select("u")).union(near.select("v")).distinct()
    wanted = reps.join(one.select("rep", "who"), "rep").select("rep", F.col("who.v").alias("_v"), F.col("who.id").alias("_id"))
    texts = rows.join(wanted, (F.col("v") == F.col("_v")) & F.col("id").eqNullSafe(F.col("_id"))).select("rep", "t").dropDuplicates(["rep"])
    sets = written(texts.mapInArrow(_sets(shingle), "rep long, shingles binary"), "shingles")
    close = written(_verified(near, one, sets, similarity), "linked")
    close = written(close.unionByName(_verified(_met(buckets, near), one, sets, similarity)), "close")
    mixed = _named(buckets.select("rep", "band", "key"), close)
    if not mixed.isEmpty():
        slot = F.pmod(F.xxhash64("rep", "band"), F.lit(TRIES))
        tries = mixed.where("comp = most").groupBy("band", "key", slot.alias("slot")).agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("end"))
        more = mixed.where("comp <> most").join(tries, ["band", "key"]).select(F.least("rep", "end").alias("u"), F.greatest("rep", "end").alias("v")).distinct()
        close = written(close.unionByName(_verified(more, one, sets, similarity)), "closer")
        mixed = _named(mixed.select("rep", "band", "key"), close)
        if not mixed.isEmpty():
            close = close.unionByName(written(_rest(mixed, one, sets, similarity), "rest"))
    groups = connected_components(close).select(F.col("node").alias("rep"), "component")
    named = one.select("set", "rep").join(groups, "rep", "left").select("set", F.coalesce("component", "rep").alias("group"))
    of = written(signed.select("id", "v", "set").join(named, "set").select("id", "v", "group"), "grouped")
    first = of.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "kept")
    return of.join(first, "group").select(F.col("id").alias(id_col), F.col("v").alias("text_hash"), F.col("first.id").alias("component_id"), F.col("first.v").alias("kept_hash"))


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id (rows without an id come last).

    Rows are told apart by id and text, so of an id with several texts only those go that are like others; rows that share both share their fate. Null and
    empty texts, which have no words, are alike. Ids may be of any type that has an order.
    """
    found = similar_groups(docs, shingle, similarity, id_col, text_col, radius)
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id")) | (F.col("text_hash") != F.col("kept_hash"))).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_text")).distinct()
    return without(docs, gone, id_col, text_col)
