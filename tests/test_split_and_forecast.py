import numpy as np
import pandas as pd
import pytest
from helpers import values
from pyspark.sql import functions as F

from meterlake.operators import forecast, split
from meterlake.operators.series import Series

S = Series()


@pytest.fixture(scope="module")
def year(spark):
    """A reading every 31 hours of 2018 for five buildings, each starting an hour later."""
    stamps = [pd.date_range(f"2018-01-01 0{b}:00", "2018-12-31", freq="31h") for b in range(5)]
    frames = [pd.DataFrame({"building_id": 40 + b, "meter": b % 2, "timestamp": s, "meter_reading": 0.5 * b}) for b, s in enumerate(stamps)]
    return spark.createDataFrame(pd.concat(frames))


@pytest.mark.parametrize(("first", "second"), [([1], [2, 3]), ([2, 3, 4, 5], [7]), (range(1, 12), [12])])
def test_months_make_folds_that_do_not_overlap(year, first, second):
    train, val = split.time_split(year, first, second)
    rows = {r.fold: r for r in split.split_summary(train, val).collect()}
    assert rows["train"].last < rows["val"].first and rows["val"].buildings == 5
    months = year.toPandas().timestamp.dt.month
    assert (rows["train"].rows, rows["val"].rows) == (months.isin(first).sum(), months.isin(second).sum())


@pytest.mark.parametrize(("first", "second", "error"), [([6, 7], [7, 8], ValueError), ([5], [], ValueError), ([], [5], ValueError), ([11], [4, 12], AssertionError)])
def test_folds_that_overlap_or_are_empty_raise(year, first, second, error):
    with pytest.raises(error):
        split.time_split(year, first, second)


def test_two_years_by_month_leak(year):
    earlier = year.withColumn("timestamp", F.col("timestamp") - F.expr("interval 730 days"))
    with pytest.raises(AssertionError):
        split.time_split(year.unionByName(earlier), [3, 4], [6])


def test_folds_expand(hourly):
    folds = split.expanding_folds(hourly(range(100)), 3)
    assert [(a.count(), b.count()) for a, b in folds] == [(25, 25), (50, 25), (75, 25)]
    for train, test in folds:
        assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0]
    blocks = split.with_fold_block(hourly(range(100)), 3).groupBy("block").count().orderBy("block").collect()
    assert [tuple(r) for r in blocks] == [(0, 25), (1, 25), (2, 25), (3, 25)]


def test_prefix_is_exact(hourly):
    df = hourly(range(1500))
    assert split.chrono_prefix(df, 0.9).agg(F.count("*"), F.max("meter_reading")).first() == (1350, 1349.0)
    assert split.chrono_prefix(df, 0.1).count() == 150
    assert split.chrono_prefix(df, 0.1, at_least=400).count() == 400
    assert split.chrono_prefix(df, 1.0).count() == 1500


def test_grid_and_time_interpolation(hourly):
    gappy = hourly([1, 2, None, 4, 5, 6, 7, 8]).where("hour(timestamp) not in (4, 5, 6)")
    out = forecast.regularize_hourly(gappy, S)
    assert values(out, "meter_reading") == [1, 2, 3, 4, 5, 6, 7, 8]
    assert values(forecast.regularize_hourly(hourly([None, 3, None]), S), "meter_reading") == [3, 3, 3]
    assert values(forecast.regularize_hourly(hourly([None, None]), S), "meter_reading") == [0, 0]


def test_lookback_windows(hourly):
    out = forecast.lookback_windows(hourly([0, 1, None, 3, 4, 5]), S, ["meter_reading"], lookback=2).orderBy("timestamp").collect()
    assert [r.target for r in out] == [None, 3, 4, 5]
    assert [[x.meter_reading for x in r.window] for r in out] == [[0, 1], [1, None], [None, 3], [3, 4]]
    strided = forecast.lookback_windows(hourly(range(10)), S, ["meter_reading"], lookback=2, stride=3)
    assert values(strided, "target") == [2, 5, 8]
    early = forecast.lookback_windows(hourly(range(10)), S, ["meter_reading"], lookback=2, until="2016-01-01 04:00:00")
    assert values(early, "target") == [2, 3, 4]
    late = forecast.lookback_windows(hourly(range(10)), S, ["meter_reading"], lookback=2, after="2016-01-01 04:00:00", stride=2)
    assert values(late, "target") == [5, 7, 9]
    assert forecast.lookback_windows(hourly([1, 2]), S, ["meter_reading"], lookback=2).count() == 0


def folds(df, cut):
    return df.where(F.col("timestamp") < cut), df.where(F.col("timestamp") >= cut)


def test_naive_repeats_the_last_rows(hourly):
    train, val = folds(hourly(range(60)), "2016-01-03 00:00:00")
    assert values(forecast.seasonal_naive(train, val, S), "y_pred") == list(range(24, 36))
    short = forecast.seasonal_naive(train.where("meter_reading < 10"), val, S).toPandas().y_pred
    np.testing.assert_allclose(short, np.expm1(np.log1p(np.arange(10)).mean()))
    unknown = forecast.seasonal_naive(train.withColumn("building_id", F.lit(9).cast("long")), val, S)
    assert set(values(unknown, "y_pred")) == {None}


def ar2(phi1, phi2, level, x0, x1, steps):
    now, before, out = x0 - level, x1 - level, []
    for _ in range(steps):
        now, before = phi1 * now + phi2 * before, now
        out.append(level + now)
    return out


@pytest.mark.parametrize("phi", [(0.5, 0.3), (1.2, -0.6), (-0.5, 0.2), (0.6, 0.0)])
def test_ar_forecast_follows_its_recurrence(hourly, phi):
    rng = np.random.default_rng(7)
    z = [2.0, 2.0]
    for _ in range(398):
        z.append(3 + phi[0] * (z[-1] - 3) + phi[1] * (z[-2] - 3) + rng.normal(0, 0.2))
    df = hourly(np.expm1(z))
    train, val = folds(df, "2016-01-16 00:00:00")
    fit = forecast.fit_ar(train, S).first()
    assert fit.phi1 == pytest.approx(phi[0], abs=0.15) and fit.phi2 == pytest.approx(phi[1], abs=0.15)
    got = forecast.forecast_ar(train, val, S).orderBy("timestamp").toPandas().y_pred
    want = np.expm1(ar2(fit.phi1, fit.phi2, fit.level, fit.x0, fit.x1, len(got)))
    np.testing.assert_allclose(got, want, rtol=1e-8)


def test_least_squares_match_numpy(hourly):
    rng = np.random.default_rng(8)
    z = np.cumsum(rng.normal(0, 0.1, 300)) * 0.3 + rng.normal(5, 0.2, 300)
    fit = forecast.fit_ar(hourly(np.expm1(z)), S).first()
    if fit.order == 2:
        x = np.c_[np.ones(298), z[1:-1], z[:-2]]
        want = np.linalg.lstsq(x, z[2:], rcond=None)[0]
        assert (fit.phi1, fit.phi2) == pytest.approx(tuple(want[1:]), rel=1e-8)


def test_constant_and_short_series_fall_back(hourly):
    train, val = folds(hourly([7.0] * 100), "2016-01-04 00:00:00")
    assert forecast.fit_ar(train, S).count() == 0
    assert set(values(forecast.forecast_ar(train, val, S), "y_pred")) == {7.0}
