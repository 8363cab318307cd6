import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quarrymill.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, spark__sql__execution__arrow__maxRecordsPerBatch="50")
    yield s
    s.stop()
