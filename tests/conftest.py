import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pluvio.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, name="pluvio-tests")


@pytest.fixture(scope="session")
def duck():
    from checks.compare import connect

    return connect(SF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def tables(spark):
    from pluvio.sources.tables import Tables

    return Tables(spark, SF)
