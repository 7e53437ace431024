import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import local_session

    s = local_session("*", shuffle_partitions=8, app_name="palimpsest-tests")
    yield s
    s.stop()
