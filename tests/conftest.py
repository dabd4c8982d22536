import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leakfree.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(cpus=8, shuffle_partitions=8, app="leakfree-tests")
    yield s


SMALL = "/root/testdata/sf0.001"
