import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("ROADPULSE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from roadpulse.session import get_session
    s = get_session("roadpulse-tests", master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def history(spark, sf_dir):
    from roadpulse.plans import catalog
    from roadpulse.session import materialize
    return materialize(catalog.processed(spark, sf_dir), "test_history")
