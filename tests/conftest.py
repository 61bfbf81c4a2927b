import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TRACEWELL_DRIVER_MEMORY", "2g")


@pytest.fixture(scope="session")
def spark():
    from tracewell.session import local_session

    session = local_session(2, 2)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return session
