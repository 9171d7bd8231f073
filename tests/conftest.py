import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from terrella.session import local_session

    return local_session(4, shuffle=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return SF
