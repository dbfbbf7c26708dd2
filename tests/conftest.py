import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gapcast.plans.scratch import drop_stored  # noqa: E402
from gapcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="tests")
    yield session
    drop_stored(session)
    session.stop()
