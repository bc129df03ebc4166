import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
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
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same():
    """Compares a Spark result with a DuckDB one, whatever their order."""

    import numbers

    import pandas as pd

    def plain(v):
        if not isinstance(v, (list, tuple, dict)) and pd.isna(v):
            return None
        return float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    def rows(frame):
        columns = sorted(frame.columns)
        return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)

    def check(df, con, sql):
        a, b = rows(df.toPandas()), rows(con.sql(sql).df())
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        assert a[1] == b[1]

    return check
