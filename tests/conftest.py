from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="siltstone-test-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", shared).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def oracle():
    """Compare a registered query with its SQL at sf0.001."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")

    def cell(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return repr(round(x, 6))
        return str(x)

    def same(frame, sql):
        theirs = con.execute(sql).df()
        ours = frame.toPandas()
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = lambda pdf: sorted(tuple(cell(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
        assert rows(ours) == rows(theirs)

    same.sf = sf
    return same
