import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from reelstat.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, driver_memory="8g",
                      app="reelstat-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def roles(spark):
    from tests.fixtures import hand_roles
    return hand_roles(spark)
