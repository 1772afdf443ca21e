import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from listing_etl.session import build_session
    s = build_session("local[4]", app="listing_etl-tests", shuffle_partitions=8)
    yield s
    s.stop()
