import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paysift.session import local_session

    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return SF
