import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from vellumspark.session import local_session

    session = local_session(memory="6g", shuffle_partitions=2)
    yield session
    session.stop()
