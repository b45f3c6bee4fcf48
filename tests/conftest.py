import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from corpus_engine.session import build_session, ship_package

    s = build_session(master="local[4]", shuffle_partitions=4)
    ship_package(s)
    yield s
    s.stop()
