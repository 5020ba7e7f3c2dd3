"""Data preparation: balancing, splits, folds, crops, batches, scoring of tiles by a caller's model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import ranked, ranked_within

TILE = ["image_id", "ox", "oy"]


def digest(seed: int, *columns: str) -> Column:
    """32 pseudo-random bits of a row, from the MD5 digest of the seed and the columns as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def coin(seed: int, *columns: str) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return digest(seed, *columns) / (1 << 32)


def balanced_tiles(tiles: DataFrame, rate: float, seed: int = 0, strong: int = 1000, core: int = 50) -> DataFrame:
    """Tiles with over `strong` truths above 0.1 or over `core` above 0.9, an image's first tile, and a share `rate` of the others."""
    s = tiles.groupBy(*TILE).agg(F.sum((F.col("value") > 0.1).cast("long")).alias("n1"), F.sum((F.col("value") > 0.9).cast("long")).alias("n9"))
    first = F.row_number().over(Window.partitionBy("image_id").orderBy("ox", "oy")) == 1
    return s.withColumn("_f", first).where((F.col("n1") > strong) | (F.col("n9") > core) | F.col("_f") | (coin(seed, *TILE) < rate)).select(*TILE)


def balanced_tiles_by_sum(tiles: DataFrame, rate: float, seed: int = 0, second: str = "value") -> DataFrame:
    """The older rule: mask sum above 5, or over 100 values of the second channel above 150, or a share `rate`."""
    s = tiles.groupBy(*TILE).agg(F.sum("value").alias("s"), F.sum((F.col(second) > 150).cast("long")).alias("n"))
    return s.where((F.col("s") > 5) | (F.col("n") > 100) | (coin(seed, *TILE) < rate)).select(*TILE)


def split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """rows with `validation`: exactly max(1, floor(share * n)) keys, those of the smallest digests."""
    placed = ranked(rows.select(key).distinct().withColumn("_h", digest(seed, key)), ["_h", key], "_k")
    size = placed.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_take"))
    chosen = placed.crossJoin(F.broadcast(size)).select(key, (F.col("_k") < F.col("_take")).alias("validation"))  # one row
    return rows.join(chosen, key)


def fold(name: str, k: int, seed: int = 0) -> Column:
    return (digest(seed, name) % k).cast("int")


def train_and_held(rows: DataFrame, key: str, k: int, held: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    f = fold(key, k, seed)
    return rows.where(f != held), rows.where(f == held)


def random_crops(volumes: DataFrame, voxels: DataFrame, size: tuple[int, int], n: int, seed: int = 0) -> DataFrame:
    """n seeded crops of each image: (image_id, crop, tx, ty, z, value)."""
    w, h = size
    at = lambda c, s, k: (digest(seed + k, "image_id", "crop") % (F.col(c) - s + 1)).cast("int")
    crops = volumes.select("image_id", "nx", "ny", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("crop")).select("image_id", "crop", at("nx", w, 0).alias("ox"), at("ny", h, 1).alias("oy"))
    j = voxels.join(crops, "image_id").where((F.col("x") >= F.col("ox")) & (F.col("x") < F.col("ox") + w) & (F.col("y") >= F.col("oy")) & (F.col("y") < F.col("oy") + h))
    return j.select("image_id", "crop", (F.col("x") - F.col("ox")).alias("tx"), (F.col("y") - F.col("oy")).alias("ty"), "z", "value")


def batches(rows: DataFrame, keys: list[str], order: str, size: int, seed: int | None = None) -> DataFrame:
    """rows with `batch` within their key, in order or in a seeded order."""
    by = [digest(seed, order), F.col(order)] if seed is not None else [F.col(order)]
    placed = ranked_within(rows, keys, by, "_i", "_n")
    return placed.withColumn("batch", F.floor(F.col("_i") / size)).select(*rows.columns, "batch")


def slice_batches(voxels: DataFrame, nz: int, size: int, pad: int = 0) -> DataFrame:
    """Slices in batches of `size` with `pad` neighbours on both sides, clamped to the volume: adds (batch, slot)."""
    n = -(-nz // size)
    wanted = [(b, s, min(nz - 1, max(0, b * size + s - pad))) for b in range(n) for s in range(min(size, nz - b * size) + 2 * pad)]
    spark = voxels.sparkSession
    plan = spark.createDataFrame(wanted, "batch int, slot int, z int")
    return voxels.join(F.broadcast(plan), "z")  # a row for each slice of the volume and its context


def scale_by_tile_maximum(tiles: DataFrame) -> DataFrame:
    most = tiles.groupBy(*TILE).agg(F.max("value").alias("_m"))
    return tiles.join(most, TILE).withColumn("value", F.when(F.col("_m") != 0, F.col("value") / F.col("_m")).otherwise(0.0)).drop("_m")


def score_tiles(tiles: DataFrame, scorer, blank: bool = True) -> DataFrame:
    """A caller's scorer(pandas frame of one tile with tx, ty, z, value) -> the same rows with new values; tiles of one value only are left out.

    A tile is a bounded group by construction.
    """
    kept = tiles
    if blank:
        spread = tiles.groupBy(*TILE).agg(F.min("value").alias("_a"), F.max("value").alias("_b")).where("_a < _b")
        kept = tiles.join(spread.select(*TILE), TILE, "left_semi")
    schema = "image_id string, ox int, oy int, tx int, ty int, z int, value double"
    columns = ["image_id", "ox", "oy", "tx", "ty", "z", "value"]

    def run(frame):
        return scorer(frame)[columns]

    typed = kept.select("image_id", *(F.col(c).cast("int").alias(c) for c in columns[1:6]), F.col("value").cast("double").alias("value"))
    return typed.groupBy(*TILE).applyInPandas(run, schema)


def sample_files(files: DataFrame, n: int, seed: int | None = None, column: str = "file") -> DataFrame:
    """The first n names, in order or in a seeded order."""
    by = [digest(seed, column), F.col(column)] if seed is not None else [F.col(column)]
    return files.orderBy(*by).limit(n)


def pair_by_name(a: DataFrame, b: DataFrame, column: str = "file") -> DataFrame:
    return a.join(b, column)
