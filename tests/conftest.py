import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from cadenza.session import get_session
    s = get_session("local[4]", app="cadenza-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="cadenza-test-", dir="/tmp")


SF_SMALL = "/root/testdata/sf0.001"
