import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netloom.schema import PACKET_SCHEMA  # noqa: E402
from netloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "netloom-tests")


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)


def packet(i, t, src="10.0.0.1", dst="10.0.0.2", protocol=6, size=100, sport=1234, dport=80, flags=16, window=1024, header=20, payload=0):
    """One packet row; `t` in seconds."""
    return (i, round(t * 1_000_000), None, src, dst, protocol, size, sport, dport, flags, window, header, header, payload)


@pytest.fixture
def make(spark):
    def build(rows):
        return spark.createDataFrame(rows, PACKET_SCHEMA)

    return build
