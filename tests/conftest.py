import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from checks.compare_engines import local_session

    session = local_session()
    session.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield session
    session.stop()
