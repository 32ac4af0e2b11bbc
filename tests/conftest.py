import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from slotlake.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("slotlake-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as a list of dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
