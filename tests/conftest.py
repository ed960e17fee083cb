import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulon.session import clear_intermediates, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    clear_intermediates(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """A DataFrame from column lists; None is null."""

    def make(schema, **columns):
        return spark.createDataFrame(list(zip(*columns.values())), schema)

    return make
