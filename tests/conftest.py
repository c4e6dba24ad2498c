import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chainspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Small runs are kept apart, so that every test crosses several of them.
    s = local_session("local[4]", 4, **{"spark.sql.adaptive.coalescePartitions.enabled": "false",
                                        "spark.sql.execution.arrow.maxRecordsPerBatch": "50"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
