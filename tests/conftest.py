import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    return int(value) if isinstance(value, float) and value == int(value) else value


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows of an SQL query, in any order."""

    def check(df, sql):
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        left = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        right = sorted(repr([plain(x) for x in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
        assert left == right

    return check
