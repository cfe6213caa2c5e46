"""Windows from blocks against the table of windows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import forecast, windows
from meterlake.operators.series import Series

S = Series()
FIELDS = "target double, total double, first_value double, last_value double"


def of_blocks(df, lookback, block_rows, series=S, **how):
    def numbers(views, y):  # inside, so that workers get it with the task
        x = np.nan_to_num(views)
        return {"target": y, "total": x.sum(axis=(1, 2)), "first_value": x[:, 0, 0], "last_value": x[:, -1, 0]}

    blocks = windows.write_blocks(df, series, ["meter_reading", "site_id"], "meter_reading", lookback, block_rows)
    out = windows.over_windows(blocks, numbers, FIELDS, **how)
    return sorted((r.building_id, r.timestamp, *(None if v is None or np.isnan(v) else v for v in r[3:])) for r in out.collect())


def of_rows(df, lookback, **how):
    out = forecast.lookback_windows(df, S, ["meter_reading", "site_id"], "meter_reading", lookback, **how)
    rows = []
    for r in out.collect():
        v = [x.meter_reading or 0.0 for x in r.window]
        rows.append((r.building_id, r.timestamp, r.target, sum(v) + sum(x.site_id for x in r.window), v[0], v[-1]))
    return sorted(rows, key=lambda r: r[:2])


@pytest.fixture
def readings(hourly):
    rows = hourly([None if k % 11 == 5 else k * 1.5 for k in range(61)])
    return rows.unionByName(hourly(range(30), building=1, site=3)).unionByName(hourly(range(4), building=2))


@pytest.mark.parametrize("lookback,block_rows", [(4, 10), (5, 5), (1, 1), (7, 4096), (10, 20)])
@pytest.mark.parametrize("stride", [1, 3])
def test_same_windows_as_the_table_of_windows(readings, lookback, block_rows, stride):
    assert of_blocks(readings, lookback, block_rows, stride=stride) == of_rows(readings, lookback, stride=stride)


@pytest.mark.parametrize("how", [{"until": "2016-01-02 05:00:00"}, {"after": "2016-01-01 15:00:00", "stride": 4}, {"after": "2016-01-01 02:00:00", "until": "2016-01-01 23:00:00", "stride": 2}])
def test_cutoffs(readings, how):
    how = {k: F.lit(v).cast("timestamp") if k != "stride" else v for k, v in how.items()}
    assert of_blocks(readings, 6, 8, **how) == of_rows(readings, 6, **how)


def test_long_series_in_chunks(readings):
    assert of_blocks(readings, 4, 10, Series(long_rows=20, chunk_rows=7)) == of_rows(readings, 4)


def test_empty_short_and_bad(spark, readings):
    assert of_blocks(readings.limit(0), 4, 10) == [] and of_blocks(readings.where("building_id = 2"), 4, 10) == []
    for lookback, block_rows in ((0, 10), (11, 10)):
        with pytest.raises(ValueError):
            windows.write_blocks(readings, S, ["meter_reading"], lookback=lookback, block_rows=block_rows)


def bytes_of(df):
    return sum(os.path.getsize(f.removeprefix("file:").replace("file://", "")) for f in df.inputFiles())


def test_blocks_take_little_more_room_than_the_rows(spark, hourly):
    from meterlake.session import durable

    rng = np.random.default_rng(0)
    rows = hourly(rng.normal(50, 10, 20_000)).coalesce(1)
    written = durable(rows.select("building_id", "meter", "timestamp", "meter_reading"))
    blocks = windows.write_blocks(rows, S, ["meter_reading"])
    # a block has the reading as a feature and as a target
    assert bytes_of(blocks.table) < 2 * bytes_of(written)
