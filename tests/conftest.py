import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidelake.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return tune(local_session(app="tests", memory="6g"))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
