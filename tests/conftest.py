import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def series(spark):
    """Long observations from ``{name: {iso date: value}}``."""
    import datetime as dt

    def make(data):
        rows = [(n, dt.date.fromisoformat(d), None if v is None else float(v), i)
                for n, points in data.items() for i, (d, v) in enumerate(points.items())]
        return spark.createDataFrame(rows, "series string, d date, v double, src_pos int")
    return make
