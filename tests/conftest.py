import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import ROOT, SMALL, TABLES

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Rows of SQL over tables of sf0.001, or over given files: (columns, rows)."""

    def run(sql, **files):
        con = duckdb.connect()
        for t in TABLES:
            path = files.get(t, f"{SMALL}/{t}.parquet")
            if os.path.exists(path) or "*" in path:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
        found = con.execute(sql)
        return [c[0] for c in found.description], found.fetchall()

    return run


def canonical(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame has the rows, as often, and the columns of a query in DuckDB."""

    def check(df, sql, **files):
        columns, rows = duck(sql, **files)
        assert sorted(df.columns) == sorted(columns)
        order = sorted(columns)
        ours = sorted(str([canonical(r[c]) for c in order]) for r in df.collect())
        theirs = sorted(str([canonical(r[columns.index(c)]) for c in order]) for r in rows)
        assert ours == theirs

    return check
