import pytest

from tidemark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("*", 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s
    s.stop()
