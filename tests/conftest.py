import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from driftwood.session import drop_written_tables, get_session

    session = get_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_written_tables(session)
    session.stop()
