from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Asserts that a query and SQL agree in columns and rows over the smallest tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")

    def check(query, sql):
        df = query(spark, SMALL)
        got = sorted([_plain(r.asDict(True)[c]) for c in sorted(df.columns)] for r in df.collect())
        told = con.execute(sql)
        names = [x[0] for x in told.description]
        wanted = sorted([_plain(r[names.index(c)]) for c in sorted(names)] for r in told.fetchall())
        assert sorted(df.columns) == sorted(names) and got == wanted

    return check
