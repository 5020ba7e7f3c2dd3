"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Sorting the blocks gives each distinct block an
integer name; then the names of adjacent blocks are paired, distinct pairs are sorted and named
in turn, until each text is one name. Names are found by comparing, not by hashing, so two texts share
(level, name) exactly if they are identical. Hashes only route: a name is (bucket of the hash, rank in
the sorted bucket). Everything is DataFrame code.

Skew: the most frequent block hashes are named once from their distinct blocks and joined back by
broadcast, so no bucket gets more than 1/HEAVY of all blocks; above the blocks only distinct pairs are ranked,
and the join back is a plain equi-join that adaptive execution splits.

Defined cases: a null text counts as empty; an id may be null or occur with different texts (every such
row is judged by itself); rows with the same id and text count each in group_size and share one
decision; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, drop, table, without, written

BLOCK_BYTES = 1024
#: At most so many block hashes count as frequent; their distinct blocks are broadcast (2,000 KB-sized blocks).
HEAVY = 2000
HEAVY_LEAST = 32
#: Hash buckets in which names are ranked; with 2^31 ranks each a name fits a long.
BUCKETS = 1 << 20


def _name(order: list[str], hashed) -> F.Column:
    bucket = F.pmod(hashed, F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*order))
    return bucket, F.shiftleft(F.col("bucket"), 32) + rank


def named_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, v, level, name) for every distinct (id, text); v tells the texts of a repeated id apart."""
    text = as_bytes(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), text.alias("t"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("t") / block_bytes)).cast("int"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(t, i * {block_bytes} + 1, {block_bytes}))")
    blocks = rows.select("id", "v", "n", F.posexplode(cut).alias("pos", "block")).withColumn("h", F.xxhash64("block"))

    often = written(
        blocks.groupBy("h").count().where(F.col("count") >= HEAVY_LEAST).orderBy(F.desc("count"), "h").limit(HEAVY).select("h", F.lit(True).alias("heavy")),
        "blockfreq",
    )
    marked = blocks.join(F.broadcast(often), "h", "left")
    bucket, name = _name(["block"], F.col("h"))
    light = marked.where("heavy IS NULL").withColumn("bucket", bucket).select("id", "v", "n", "pos", name.alias("name"))
    hot = marked.where("heavy")
    hot_names = hot.select("block").distinct().withColumn("name", -F.row_number().over(Window.orderBy("block")).cast("long"))
    hot = hot.join(F.broadcast(hot_names), "block").select("id", "v", "n", "pos", "name")
    now = written(light.unionByName(hot), "names0")

    most = now.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while most > 0:
        done.append(now.where("n = 1").select("id", "v", F.lit(level).alias("level"), "name").distinct())
        if most == 1:
            break
        pairs = (
            now.where("n > 1")
            .groupBy("id", "v", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"))
        )
        bucket, name = _name(["a", "b"], F.xxhash64("a", "b"))
        names = pairs.select("a", "b").distinct().withColumn("bucket", bucket).select("a", "b", name.alias("name"))
        now = written(pairs.join(names, ["a", "b"]).select("id", "v", F.expr("int((n + 1) div 2)").alias("n"), "pos", "name"), "names")
        most, level = (most + 1) // 2, level + 1
    if not done:
        return now.select("id", "v", F.lit(0).alias("level"), "name")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """exact_groups with v, which tells the texts of an id apart."""
    text = as_bytes(text_col)
    named = written(named_documents(docs, id_col, text_col, block_bytes), "named")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), F.sha2(text, 256).alias("text_sha256"))
    named = named.withColumnsRenamed({"id": "id2", "v": "v2"})
    rows = rows.join(named, F.col("id").eqNullSafe(F.col("id2")) & (F.col("v") == F.col("v2"))).select("id", "v", "level", "name", "text_sha256")
    groups = rows.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    out = rows.join(groups, ["level", "name"])
    return out.select(F.col("id").alias(id_col), "v", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id (largest id of its group), group_size, kept, text_sha256."""
    return _grouped(docs, id_col, text_col, block_bytes).drop("v")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text no row with a larger id has."""
    gone = _grouped(docs, id_col, text_col, BLOCK_BYTES).where("NOT kept").select(F.col(id_col).alias("_id"), F.col("v").alias("_text"))
    return without(docs, gone, id_col, text_col)


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
