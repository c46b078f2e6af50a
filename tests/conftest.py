import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlight.operators.ordered import BLOCK_ROWS_CONF  # noqa: E402
from barlight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set(BLOCK_ROWS_CONF, "64")  # many blocks even on small tables
    yield session
    session.stop()
