import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rubrica.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    tune(session)
    yield session
    session.stop()
