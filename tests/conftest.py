import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberlog.schema import LOG_SCHEMA, TEXT_COLUMNS  # noqa: E402
from emberlog.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log frame from dicts; absent texts are ''."""

    def make(records):
        rows = [(r.get("event_time"), *[r.get(c, "") for c in TEXT_COLUMNS]) for r in records]
        return spark.createDataFrame(rows, LOG_SCHEMA)

    return make
