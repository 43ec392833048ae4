import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "adloom-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__sql__ui__retainedExecutions="100000",  # tests count executions; the whole suite has over the usual 1,000
        spark__driver__memory="6g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="adloom-tests-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_ads(spark):
    """Ads from dicts of the fields that matter; positions count from 2."""
    from adloom.schema import ADS_COLUMNS

    def make(rows, start=2):
        data = [(start + i, *[r.get(c, "") for c in ADS_COLUMNS]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "pos bigint, " + ", ".join(f"{c} string" for c in ADS_COLUMNS))

    return make
