import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from tabwright.storage import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    folder = "/root/testdata/sf0.001"
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
