"""Ordinary series are dealt out to as many tasks as their rows ask for, and the rows stay the same."""

import pytest
from pyspark.sql import functions as F

from meterlake.operators import clean, series
from meterlake.operators.series import Series
from meterlake.plans.prepare import clean_history


def readings(spark, n=3_000, buildings=200):
    value = "CASE WHEN id % 11 < 4 THEN 0.0 WHEN id % 17 = 0 THEN NULL ELSE id % 101 END AS meter_reading"
    return spark.range(n).selectExpr(f"nullif(id % {buildings}, 5) AS building_id", "CAST(id % 3 AS INT) AS meter", "timestamp_seconds(3600 * id) AS timestamp", value, "id")


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("step", [clean.drop_zero_streaks, clean.fill_streaks_forward, clean.fill_streaks_with_mean, clean.with_zero_runs])
def test_tasks_grow_with_the_rows(spark, monkeypatch, step):
    df, kind = readings(spark), Series(ties=("id",))
    whole = ordered(step(df, kind))
    for rows, tasks in ((100, 30), (50, 60)):
        monkeypatch.setattr(series, "TASK_ROWS", rows, raising=False)
        out = step(df, kind)
        assert out.rdd.getNumPartitions() == tasks
        assert ordered(out) == whole


def test_treatments_and_history_are_dealt_out_once(spark, monkeypatch):
    df, kind = readings(spark), Series(ties=("id",))
    sites = df.select("building_id").distinct().where("building_id is not null").withColumn("site_id", F.lit(1))
    run = [
        lambda s: clean.all_treatments(df, s, min_hours=2, quantile=0.9),
        lambda s: clean_history(df, s, sites, min_hours=2, quantile=0.9, lags=(1,), windows=(3,)),
    ]
    before = [ordered(one(kind)) for one in run]
    chunked = ordered(run[0](Series(ties=("id",), long_rows=5, chunk_rows=7)))
    assert chunked == before[0]
    monkeypatch.setattr(series, "TASK_ROWS", 50, raising=False)
    assert [ordered(one(kind)) for one in run] == before
    assert run[1](kind).rdd.getNumPartitions() == 60
