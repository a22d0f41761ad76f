"""A small session, and the comparison of a query with its DuckDB twin."""

from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "3g").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"file://{folder}/shared")
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def normal(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.6f}"
        if x is None or x is pd.NaT or x is pd.NA:
            return "null"
        if hasattr(x, "tolist"):
            x = x.tolist()
        return f"{float(x):.6f}" if isinstance(x, int) and not isinstance(x, bool) else repr(x)

    columns = sorted(frame.columns)
    return sorted(tuple(value(x) for x in row) for row in frame[columns].itertuples(index=False, name=None))


def duck(sql: str, folder: str | None = None, **tables: pd.DataFrame) -> pd.DataFrame:
    """DuckDB's result over the test tables of a folder, or over some frames."""
    import duckdb

    c = duckdb.connect()
    if folder:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name, frame in tables.items():
        c.register(name, frame)
    return c.execute(sql).df()
