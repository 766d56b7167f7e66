import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from patronage.session import local_session
    s = local_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
