import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meterlake.session import drop_scratch, local_session  # noqa: E402

TESTDATA = os.environ.get("METERLAKE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="6g", app="meterlake-tests")
    yield session
    drop_scratch(session)


@pytest.fixture(scope="session")
def folder():
    return TESTDATA


@pytest.fixture
def hourly(spark):
    """A frame of consecutive hourly readings of one meter."""

    def make(values, building=0, meter=0, site=0, start="2016-01-01"):
        rows = pd.DataFrame(
            {
                "building_id": building,
                "meter": meter,
                "site_id": site,
                "timestamp": pd.date_range(start, periods=len(values), freq="h"),
                "meter_reading": [None if v is None else float(v) for v in values],
            }
        )
        if len(rows):
            schema = None
        else:
            schema = "building_id long, meter long, site_id long, timestamp timestamp, meter_reading double"
        return spark.createDataFrame(rows, schema=schema) if schema is None else spark.createDataFrame([], schema)

    return make
