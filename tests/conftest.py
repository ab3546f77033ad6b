import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablestakes.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=2)
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def partitions(request):
    """test_sizes has the session's own number of shuffle partitions, whatever a test before it has set."""
    if request.module.__name__ != "test_sizes":
        yield
        return
    spark, name = request.getfixturevalue("spark"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.sparkContext.getConf().get(name))
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
