import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidymill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidymill-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """A one-column table ``v`` of the given values."""

    def make(values, kind="string", name="v"):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, `{name}` {kind}")

    return make


def column(df, name="v"):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.fixture
def values():
    return column
