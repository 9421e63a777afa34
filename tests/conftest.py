import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and a DuckDB statement give equal rows under equal column names."""

    def check(df, con, sql):
        got = con.execute(sql)
        names, rows = [d[0] for d in got.description], got.fetchall()
        cols = sorted(df.columns)
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=key)
        theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=key)
        assert len(ours) == len(theirs)
        assert ours == theirs

    return check
