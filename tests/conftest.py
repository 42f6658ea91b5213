from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def same_rows(df, con, sql):
    """Rows of a DataFrame and of a DuckDB query, columns by name, in any order."""
    rel = con.sql(sql)
    cols = list(rel.columns)
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    assert sorted(df.columns) == sorted(cols)
    assert got == want
