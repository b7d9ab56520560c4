import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lendbook.session import build_session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    session = build_session("local[8]", 8, "tests", driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """The portfolio at the smallest scale."""
    from lendbook.sources.star import load_portfolio

    return load_portfolio(spark, "/root/testdata/sf0.001")
