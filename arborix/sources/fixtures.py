"""Domain tables derived by SQL from the given tables; the same text runs in Spark and in DuckDB.

Samples and images are blocks of the base tables' keys, so their number grows with the input and their density stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "fx_edges": """SELECT concat(o_orderpriority, '-', CAST(floor(o_orderkey / 5e3) AS BIGINT)) AS sample_id, 'm0' AS mask_id, o_orderkey AS edge_id, o_custkey % 1500 AS u,
       (o_custkey * 3 + o_orderkey) % 1500 AS v,
       o_totalprice / 1e3 AS length, 1e0 + (o_orderkey % 40) / 4e0 AS diameter,
       (o_orderkey % 13) / 4e0 AS soam, 1e0 / (1e0 + (o_orderkey % 7) / 10e0) AS clr
FROM orders""",
    "fx_points": """SELECT concat(event_type, '-', CAST(floor(user_id / 15e1) AS BIGINT)) AS sample_id, user_id AS edge_id, CAST(pos AS INT) AS pos,
       CAST(floor(value) AS INT) % 64 AS x, CAST(event_id % 64 AS INT) AS y, CAST(pos % 16 AS INT) AS z,
       CASE WHEN pos = 0 THEN NULL ELSE 2e0 + (event_id % 9) / 2e0 END AS diameter
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS pos FROM events) t""",
    "fx_voxels": """SELECT concat(l_returnflag, CAST(floor(l_orderkey / 15e3) AS BIGINT)) AS image_id, CAST(l_partkey % 64 AS INT) AS x, CAST(l_orderkey % 64 AS INT) AS y,
       CAST(l_linenumber AS INT) AS z, max(least(255, CAST(floor(l_quantity * 5) AS INT))) AS value
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "fx_pair": """SELECT image_id, x, y, z, CASE WHEN value >= 127 THEN 1e0 ELSE 0e0 END AS truth,
       least(1e0, greatest(0e0, value / 255e0 + ((x * 7 + y * 3 + z) % 11 - 5) / 20e0)) AS pred
FROM fx_voxels""",
    "fx_barcodes": """SELECT concat(o_orderpriority, '-', CAST(floor(o_orderkey / 5e3) AS BIGINT)) AS sample_id, CAST(o_orderkey % 3 AS INT) AS dim, o_totalprice / 1e5 AS birth,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice / 1e5 + (o_orderkey % 17) / 10e0 END AS death
FROM orders""",
    "fx_scores": """SELECT CAST(l_linenumber AS INT) AS method, l_orderkey AS case_id, avg(l_extendedprice * (1 - l_discount)) AS score
FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2""",
    "fx_summary10": """SELECT l_suppkey AS component, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos,
       l_quantity AS value
FROM lineitem""",
}
BASE = {
    "fx_edges": ("orders",),
    "fx_points": ("events",),
    "fx_voxels": ("lineitem",),
    "fx_pair": ("lineitem", "fx_voxels"),
    "fx_barcodes": ("orders",),
    "fx_scores": ("lineitem",),
    "fx_summary10": ("lineitem",),
}
#: Dimensions and voxel size of every derived volume.
DIMS, PIX = (64, 64, 8), (20.0, 20.0, 20.0)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in BASE[name]:
        df = fixture(spark, sf_dir, t) if t in SQL else spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df.createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def ctes(*names: str) -> str:
    """The fixtures as the first common table expressions of a DuckDB statement."""
    out = []
    for n in names:
        for t in (*(b for b in BASE[n] if b in SQL), n):
            part = f"{t} AS ({SQL[t]})"
            if part not in out:
                out.append(part)
    return "WITH RECURSIVE " + ",\n".join(out)
