from __future__ import annotations

import datetime as dt
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from voltpanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("voltpanel-tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path


@pytest.fixture
def make_panel(spark):
    """Panel rows from ``{zone: [value or None, ...]}``; None means the day is absent."""

    def build(series: dict[str, list], start: str = "2020-01-01"):
        first = dt.date.fromisoformat(start)
        rows = [
            (zone, first + dt.timedelta(days=i), v)
            for zone, values in series.items()
            for i, v in enumerate(values)
            if v is not None
        ]
        return spark.createDataFrame(rows, "zone string, period date, value bigint")

    return build
