import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cellweave.plans.session import session

    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def data():
    return DATA


@pytest.fixture
def make(spark):
    """A DataFrame of rows, in several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples, nulls first."""

    def key(t):
        return tuple((v is not None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in t)

    return lambda df: sorted((tuple(r) for r in df.collect()), key=key)
