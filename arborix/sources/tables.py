"""Readers and writers of the domain tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import remove, written
from ..operators.ranks import ranked

VOXELS = "image_id string, x int, y int, z int, t int, channel int, value double"
SUMMARY = ["x1", "y1", "z1", "x2", "y2", "z2", "diameter", "length", "soam", "clr"]
#: Weight files name their epoch and loss.
WEIGHTS = r"weights\.(\d+)-(\d+\.\d+)\.hdf5$"


def path_column(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def discover_samples(spark: SparkSession, root: str, leave_out: tuple[str, ...] = ("TDA_Summary",), pattern: str = r"/([^/]+)/[Ss]keletons/([^/]+)/") -> DataFrame:
    """(sample_id, mask_id, n_files) from paths root/<sample>/Skeletons/<mask>/...; folders to leave out, such as that of summaries, are no samples."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(F.regexp_extract("path", pattern, 1).alias("sample_id"), F.regexp_extract("path", pattern, 2).alias("mask_id"))
    return parts.where(F.col("sample_id") != "").where(~F.col("sample_id").isin(*leave_out)).groupBy("sample_id", "mask_id").agg(F.count("*").alias("n_files"))


READERS = {"parquet": "parquet", "csv": "csv", "orc": "orc", "json": "json"}


def read_voxels(spark: SparkSession, path: str, schema: str = VOXELS) -> DataFrame:
    """The reader goes by the extension; unknown ones raise."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(READERS[kind]).load(path)


def read_tile(voxels: DataFrame, origin: tuple[int, int], size: tuple[int, int], channels: list[int] | None = None) -> DataFrame:
    """Voxels of a tile, coordinates relative to it."""
    (ox, oy), (w, h) = origin, size
    out = voxels.where(F.col("x").between(ox, ox + w - 1) & F.col("y").between(oy, oy + h - 1))
    if channels is not None:
        out = out.where(F.col("channel").isin(channels))
    return out.withColumn("x", F.col("x") - ox).withColumn("y", F.col("y") - oy)


def read_slice(voxels: DataFrame, z: int) -> DataFrame:
    return voxels.where(F.col("z") == z)


def three_slices(voxels: DataFrame, nz: int, channels: int = 1) -> DataFrame:
    """Slice k becomes slices k, k + 1, k + 2 of the volume stacked as channels; the range of z shrinks by two."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dz).alias("dz")) for i, dz in enumerate((0, 1, 2))))).alias("o")
    moved = voxels.select("*", parts)
    out = moved.withColumn("channel", F.col("o.i") * channels + F.coalesce(F.col("channel"), F.lit(0))).withColumn("z", F.col("z") - F.col("o.dz")).drop("o")
    return out.where(F.col("z").between(0, nz - 3))


def _mounted(path: str) -> str | None:
    """The path as the file system has it, if it names a folder that is mounted wherever tasks run; None for other stores."""
    scheme = re.match(r"(\w+):", path)
    return None if scheme and scheme[1] != "file" else re.sub(r"^file:/*", "/", path)


def _tasks(spark: SparkSession) -> int:
    """A fixed number of tasks: files cost far more than their few bytes, by which adaptive execution would put them together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Folders of a sample whose name is null, as Spark names them.
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_branch_files(lines: DataFrame, path: str) -> None:
    """lines(sample_id, component, branch, pos, value) as path/sample_id=.../Component{i}Branch{j}.txt. A task writes its branches one after the other, under another name until they are whole."""
    spark, top = lines.sparkSession, _mounted(path)
    remove(spark, path)

    def put(batches):
        import os
        import uuid
        from urllib.parse import quote

        import pyarrow as pa

        now, out, begun, n = None, None, None, 0

        def done():
            out.close()
            os.replace(begun, f"{now[0]}/Component{now[1]}Branch{now[2]}.txt")

        for batch in batches:
            folders = {s: f"{top}/sample_id={_NO_NAME if s is None else quote(s, safe=' -_.,+@')}" for s in set(batch["sample_id"].to_pylist())}
            keys = list(zip(map(folders.get, batch["sample_id"].to_pylist()), batch["component"].to_pylist(), batch["branch"].to_pylist()))
            values, i = batch["value"].to_pylist(), 0
            while i < len(keys):
                key, end = keys[i], i + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                if key != now:
                    if now:
                        done()
                    os.makedirs(key[0], exist_ok=True)
                    now, begun, n = key, f"{key[0]}/.{uuid.uuid4().hex}", n + 1
                    out = open(begun, "w")
                out.write("\n".join(values[i:end]) + "\n")
                i = end
        if now:
            done()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    keys = ["sample_id", "component", "branch"]
    dealt = lines.select(*keys, "pos", "value").repartition(_tasks(spark), *keys).sortWithinPartitions(*keys, "pos")
    dealt.drop("pos").mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row


def _read_branch_files(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, component, branch, pos, x, y, z) of the files that write_branch_files() wrote: folders are listed by tasks, and their files are dealt over tasks and read in turn."""
    top = _mounted(path)

    def listed(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for folder in batch["folder"].to_pylist():
                names = [f"{folder}/{e.name}" for e in os.scandir(f"{top}/{folder}") if not e.name.startswith(".")]
                for i in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_pydict({"name": names[i : i + 10_000]})

    def read(batches):
        from urllib.parse import unquote

        import pyarrow as pa

        kinds = pa.schema([("sample_id", pa.string()), ("component", pa.int32()), ("branch", pa.int32()), ("pos", pa.int32()), *((c, pa.float64()) for c in "xyz")])
        rows = []
        for batch in batches:
            for name in batch["name"].to_pylist():
                found = re.fullmatch(r"sample_id=([^/]+)/Component(\d+)Branch(\d+)\.txt", name)
                if not found:
                    continue
                key = (unquote(found[1]), int(found[2]), int(found[3]))
                pos = 0
                with open(f"{top}/{name}") as lines:
                    for line in lines:
                        v = line.split()
                        if len(v) >= 3:
                            rows.append((*key, pos, *map(float, v[:3])))
                            pos += 1
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = [(f.getPath().getName(),) for f in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)]
    names = spark.createDataFrame(folders, "folder string").repartition(_tasks(spark), "folder").mapInArrow(listed, "name string")
    return names.repartition(_tasks(spark), "name").mapInArrow(read, "sample_id string, component int, branch int, pos int, x double, y double, z double")


def read_branch_points(spark: SparkSession, path: str) -> DataFrame:
    """points from text files Component{i}Branch{j}.txt of `x y z` lines, in a folder of the sample; numbering stops at the first gap of branches, then of components.

    A file may also be a folder of that name; folders named column=value stand for their values. A path without a wildcard is the points folder of export_branches().
    """
    from ..operators.geometry import contiguous_prefix

    whole = lambda p: contiguous_prefix(contiguous_prefix(p, ["sample_id", "component"], "branch"), ["sample_id"], "component")
    if "*" not in path and _mounted(path):
        return whole(written(_read_branch_files(spark, path), "branchpoints"))
    lines = spark.read.text(path if "*" in path else f"{path}/*/*/*").select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("_line"))
    name = r"/(?:[^/=]*=)?([^/=]+)/(?:[^/=]*=)?Component(\d+)Branch(\d+)\.txt(?:/[^/]*)?$"
    p = lines.select(F.regexp_extract("file_path", name, 1).alias("sample_id"), *(F.regexp_extract("file_path", name, g).cast("int").alias(c) for g, c in ((2, "component"), (3, "branch"))), F.split(F.trim("value"), r"\s+").alias("v"), "_line")
    p = p.where("component IS NOT NULL AND size(v) >= 3")
    p = p.withColumn("pos", (F.row_number().over(Window.partitionBy("sample_id", "component", "branch").orderBy("_line")) - 1).cast("int"))
    return whole(p.select("sample_id", "component", "branch", "pos", *(F.col("v")[i].cast("double").alias(c) for i, c in enumerate("xyz"))))


def summary_rows(flat: DataFrame, keys: list[str], width: int = 10, names: list[str] = SUMMARY) -> DataFrame:
    """Flat (keys, pos, value) lists reshaped to rows of `width` named values; a short last row is left out."""
    row = F.expr(f"pos div {width}").alias("row")
    wide = flat.groupBy(*keys, row).agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("pos") % width == i, F.col("value"))).alias(n) for i, n in enumerate(names)))
    return wide.where(F.col("_n") == width).drop("_n")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "value"))
    return summary_rows(text.withColumn("value", F.col("value").cast("double")), ["file"])


def read_network_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("diameter double, length double").csv(path)


def write_network_summary(edges: DataFrame, path: str) -> None:
    edges.select("diameter", "length").write.mode("overwrite").csv(path)


def write_metrics(branches: DataFrame, metrics: list[str], path: str) -> None:
    branches.select(*metrics).write.mode("overwrite").option("header", True).csv(path)


def descriptor_pivot(descriptors: DataFrame, name: str) -> DataFrame:
    """One descriptor with samples as rows and masks, in name order, as columns mask_1, mask_2, ..."""
    masks = descriptors.select("mask_id").distinct()
    n = masks.count()
    if n > 10_000:
        raise ValueError("too many masks for columns")
    # so few masks can be ranked in one task and broadcast
    numbered = descriptors.join(F.broadcast(masks.withColumn("mask_pos", F.dense_rank().over(Window.orderBy("mask_id")))), "mask_id")
    wide = numbered.groupBy("sample_id").pivot("mask_pos", list(range(1, n + 1))).agg(F.first(name))
    return wide.select("sample_id", *(F.col(str(i)).alias(f"mask_{i}") for i in range(1, n + 1)))


def write_descriptors(descriptors: DataFrame, path: str) -> None:
    """One CSV folder for each descriptor, and one with the mask names."""
    for name in [c for c in descriptors.columns if c not in ("sample_id", "mask_id")]:
        descriptor_pivot(descriptors, name).orderBy("sample_id").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    descriptors.select("mask_id").distinct().orderBy("mask_id").write.mode("overwrite").csv(f"{path}/dataReadIn")


def barcode_rows(barcodes: DataFrame, digits: int | None = None) -> DataFrame:
    """(sample_id, dim, start, end) as exported: bars without end have end -1; rounded only if digits are given."""
    end = F.coalesce(F.col("death").cast("double"), F.lit(-1.0))
    put = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return barcodes.select("sample_id", "dim", put(F.col("birth").cast("double")).alias("start"), put(end).alias("end"))


def write_barcodes(barcodes: DataFrame, path: str, digits: int | None = None) -> None:
    barcode_rows(barcodes, digits).write.mode("overwrite").partitionBy("dim").option("sep", " ").csv(path)


def write_diagram(barcodes: DataFrame, path: str) -> None:
    """Text rows `p dim birth death` over the field of two elements, a folder for each sample."""
    line = F.concat_ws(" ", F.lit("2"), "dim", "birth", F.coalesce(F.col("death").cast("string"), F.lit("inf")))
    barcodes.select("sample_id", line.alias("value")).write.mode("overwrite").partitionBy("sample_id").text(path)


def read_diagram(spark: SparkSession, path: str) -> DataFrame:
    """barcodes from text rows `p dim birth death`; inf is a death of null. A sample is the name of its file, or of a folder sample_id=name."""
    f = F.split(F.trim("value"), r"\s+").alias("f")
    file = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"/sample_id=([^/]+)/", 1), F.lit("")), F.col("_metadata.file_path"))
    rows = spark.read.text(path, recursiveFileLookup=True).select(file.alias("file"), f).where("size(f) >= 4")
    death = F.when(~F.lower(F.col("f")[3]).isin("inf", "-1"), F.col("f")[3].cast("double"))
    return rows.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("sample_id"), F.col("f")[1].cast("int").alias("dim"), F.col("f")[2].cast("double").alias("birth"), death.alias("death"))


def off_lines(points: DataFrame) -> DataFrame:
    """(sample_id, part, line): an OFF header and `x y z` lines; order by part, line."""
    head = points.groupBy("sample_id").agg(F.count("*").alias("n"))
    head = head.select("sample_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("OFF").alias("line")), F.struct(F.lit(1).alias("part"), F.format_string("%d 0 0", F.col("n")).alias("line")))).alias("h")).select("sample_id", "h.*")
    return head.unionByName(points.select("sample_id", F.lit(2).alias("part"), F.format_string("%f %f %f", *(F.col(c).cast("double") for c in "xyz")).alias("line")))


def write_off(points: DataFrame, path: str) -> None:
    off_lines(points).repartition("sample_id").sortWithinPartitions("sample_id", "part", "line").select("sample_id", "line").write.mode("overwrite").partitionBy("sample_id").text(path)


def obj_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, part, k, line): `v x y z` by node number, then `l i j`, numbered from 1 in node order."""
    numbered = nodes.withColumn("k", F.row_number().over(Window.partitionBy("sample_id").orderBy("node_id")))
    e = edges
    for side in "uv":
        e = e.join(numbered.select("sample_id", F.col("node_id").alias(side), F.col("k").alias(f"k{side}")), ["sample_id", side])
    vertices = numbered.select("sample_id", F.lit(0).alias("part"), F.col("k").cast("long").alias("k"), F.concat_ws(" ", F.lit("v"), *"xyz").alias("line"))
    return vertices.unionByName(e.select("sample_id", F.lit(1).alias("part"), F.col("edge_id").alias("k"), F.concat_ws(" ", F.lit("l"), "ku", "kv").alias("line")))


def write_obj(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    obj_lines(nodes, edges).repartition("sample_id").sortWithinPartitions("sample_id", "part", "k").select("sample_id", "line").write.mode("overwrite").partitionBy("sample_id").text(path)


def write_swc(nodes: DataFrame, path: str, key: str = "file") -> None:
    """Lines `id type x y z radius parent`, a folder for each file."""
    line = F.concat_ws(" ", "id", "type", *"xyz", "radius", "parent")
    nodes.repartition(key).sortWithinPartitions(key, "id").select(key, line.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, type, x, y, z, radius, parent): file is the name of the file, or of its folder if that is named column=value."""
    f = F.split(F.trim("value"), r"\s+").alias("f")
    name = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"/[^/=]*=([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))
    rows = spark.read.text(path, recursiveFileLookup=True).where("NOT value LIKE '#%' AND trim(value) <> ''").select(name.alias("file"), f)
    return rows.select("file", F.col("f")[0].cast("long").alias("id"), F.col("f")[1].cast("int").alias("type"), *(F.col("f")[i].cast("double").alias(c) for i, c in ((2, "x"), (3, "y"), (4, "z"), (5, "radius"))), F.col("f")[6].cast("long").alias("parent"))


def expand_series(voxels: DataFrame, path: str) -> None:
    voxels.write.mode("overwrite").partitionBy("t").parquet(path)


def collapse_series(files: DataFrame, name: str = "file") -> DataFrame:
    """Rows of many volumes as one series: t is the rank of the file name."""
    t = ranked(files.select(name).distinct(), [name], "t").withColumn("t", F.col("t").cast("int"))
    return files.drop("t").join(t, name).drop(name)


def frame_count(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("image_id").agg(F.countDistinct("t").alias("n_frames"))


def load_cases(images: DataFrame, masks: DataFrame, cases: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """The cases(image_id) with their mask beside the image value; voxels without a mask have 0."""
    i = images.join(cases.select("image_id"), "image_id", "left_semi")
    if channels is not None:
        i = i.where(F.col("channel").isin(channels))
    m = masks.select("image_id", *"xyz", F.col("value").alias("mask"))
    return i.join(m, ["image_id", *"xyz"], "left").na.fill(0, ["mask"])


def best_weights(files: DataFrame, column: str = "file", most_recent: bool = False) -> DataFrame:
    """The file of least loss, or of the highest epoch, among names weights.EE-LOSS.hdf5."""
    f = files.select(F.col(column).alias("file"), F.regexp_extract(column, WEIGHTS, 1).alias("e"), F.regexp_extract(column, WEIGHTS, 2).alias("l")).where("e <> ''")
    epoch, loss = F.col("e").cast("int"), F.col("l").cast("double")
    pick = F.max_by("file", F.struct(epoch, "file")) if most_recent else F.min_by("file", F.struct(loss, epoch))
    return f.agg(pick.alias("file"))


def best_from_loss(losses: DataFrame, column: str = "loss") -> DataFrame:
    """(epoch, loss): the first position of the least value of an array of losses."""
    return losses.select(F.posexplode(column).alias("epoch", "loss")).agg(F.min(F.struct("loss", "epoch")).alias("b")).select("b.epoch", "b.loss")


def put_tile(volume: DataFrame, tile: DataFrame, origin: tuple[int, int, int], mode: str = "replace") -> DataFrame:
    """The volume after a tile is put at a place: replacing what is there, or added to it."""
    moved = tile.select("image_id", *((F.col(c) + o).alias(c) for c, o in zip("xyz", origin)), "value")
    keys = ["image_id", *"xyz"]
    if mode == "replace":
        return volume.select(*keys, "value").join(moved, keys, "left_anti").unionByName(moved)
    if mode == "add":
        return volume.select(*keys, "value").unionByName(moved).groupBy(*keys).agg(F.sum("value").alias("value"))
    raise ValueError("mode must be replace or add")


def append_slice(volume: DataFrame, tile: DataFrame) -> DataFrame:
    """Puts a slice behind the last one of its image."""
    last = volume.groupBy("image_id").agg(F.max("z").alias("_z"))
    moved = tile.join(last, "image_id", "left").withColumn("z", F.coalesce(F.col("_z") + 1, F.lit(0))).drop("_z")
    return volume.unionByName(moved.select(*volume.columns))


def export_branches(points: DataFrame, branches: DataFrame, path: str, first_branch: int = 1, adjacency: bool = False, summary: bool = True) -> None:
    """Polylines, scalars, summaries and adjacency of branches(sample_id, component, branch, u, v, metrics) and their points(sample_id, component, branch, pos, x, y, z).

    points/sample_id=.../Component{i}Branch{j}.txt has `x y z` lines, {diameter,length,soam,clr} the scalars by branch, summary ten values a
    branch (both ends and the metrics), adjacency the node pairs of each component. Branches are numbered from first_branch. In stores that are not mounted as folders, where Spark
    alone can write, a branch is a folder file=Component{i}Branch{j}.txt of one file.
    """
    j = F.col("branch") - 1 + first_branch
    value = F.concat_ws(" ", *"xyz").alias("value")
    if _mounted(path):
        write_branch_files(points.select("sample_id", "component", j.alias("branch"), "pos", value), f"{path}/points")
    else:
        file = F.concat(F.lit("Component"), "component", F.lit("Branch"), j, F.lit(".txt")).alias("file")
        lines = points.select("sample_id", file, "pos", value)
        lines.repartition("sample_id", "file").sortWithinPartitions("sample_id", "file", "pos").select("sample_id", "file", "value").write.mode("overwrite").partitionBy("sample_id", "file").text(f"{path}/points")
    named = written(branches.withColumn("branch", j), "exported")
    for c in ("diameter", "length", "soam", "clr"):
        named.select("sample_id", "component", "branch", c).write.mode("overwrite").option("header", True).csv(f"{path}/{c}")
    if summary:
        ends = points.groupBy("sample_id", "component", j.alias("branch")).agg(*(f(c, "pos").alias(n) for f, ns in ((F.min_by, SUMMARY[:3]), (F.max_by, SUMMARY[3:6])) for c, n in zip("xyz", ns)))
        named.join(ends, ["sample_id", "component", "branch"]).select("sample_id", "component", "branch", *SUMMARY).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    if adjacency:
        named.select("sample_id", "component", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct().write.mode("overwrite").option("header", True).csv(f"{path}/adjacency")


def read_branch_scalars(spark: SparkSession, path: str, metrics=("diameter", "length", "soam", "clr")) -> DataFrame:
    """(sample_id, component, branch, metric, value) of the scalar files that export_branches() wrote."""
    one = lambda c: spark.read.option("header", True).schema(f"sample_id string, component int, branch int, {c} double").csv(f"{path}/{c}")
    return reduce(DataFrame.unionByName, (one(c).select("sample_id", "component", "branch", F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics))


def write_points(points: DataFrame, path: str) -> None:
    """Points by sample, in place of all that the folder holds, samples that are not written now included."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("sample_id").parquet(path)


def make_volume(spark: SparkSession, image_id: str, dims: tuple[int, int, int], pix=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), description: str = "") -> DataFrame:
    """The dimension row of a new volume: voxel size 1 and origin 0 unless given."""
    return spark.createDataFrame([(image_id, *dims, list(map(float, pix)), list(map(float, origin)), description)], "image_id string, nx int, ny int, nz int, pix_dim array<double>, origin array<double>, description string")
