import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from studybank.session import local_session
    s = local_session("*", shuffle_partitions=8, app="studybank-tests")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
