import glob
import os
import sys

import duckdb
import pandas
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def rows(frame):
    """Comparable rows: columns by name, numbers to nine digits."""
    cols = sorted(frame.columns)

    def text(v):
        if v is None or v is pandas.NA or v is pandas.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    return cols, sorted(tuple(map(text, r)) for r in frame[cols].itertuples(index=False))
