import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """Small shuffles are not merged, so that groups really span several partitions."""
    session = local_session("4", "runledger-tests", **{"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    yield session
    session.stop()
