from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions import holidays
from meterlake.operators import features
from meterlake.operators.encoding import TargetEncoder
from meterlake.operators.series import Series

S = Series()


@pytest.fixture(scope="module")
def toy(spark):
    """Three series of different lengths with gaps in time, in random order of rows."""
    rng = np.random.default_rng(77)
    parts = []
    for b, m, n in ((11, 0, 400), (11, 3, 190), (12, 1, 260)):
        stamps = pd.date_range("2017-11-20", periods=2 * n, freq="h")[np.sort(rng.choice(2 * n, n, replace=False))]
        parts.append(pd.DataFrame({"building_id": b, "meter": m, "site_id": b - 9, "primary_use": f"use{b}", "timestamp": stamps, "meter_reading": rng.gamma(2, 9, n)}))
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))


def by_series(df):
    out = df.toPandas().sort_values(["building_id", "meter", "timestamp"])
    return [g for _, g in out.groupby(["building_id", "meter"])]


def test_waves_lie_on_the_circle_and_parts_follow_the_calendar(toy):
    out = features.add_time_features(toy).toPandas()
    for c, period in (("hour", 24), ("dayofweek", 7), ("month", 12)):
        np.testing.assert_allclose(out[f"{c}_sin"] ** 2 + out[f"{c}_cos"] ** 2, 1, rtol=1e-12)
        angle = np.mod(np.arctan2(out[f"{c}_sin"], out[f"{c}_cos"]) * period / (2 * np.pi), period)
        np.testing.assert_allclose(np.minimum(abs(angle - out[c] % period), period - abs(angle - out[c] % period)), 0, atol=1e-9)
    stamps = pd.DatetimeIndex(out.timestamp)
    for c in ("hour", "dayofweek", "month"):
        assert (out[c].to_numpy() == getattr(stamps, c)).all()
    assert (out.is_weekend.to_numpy() == (stamps.dayofweek >= 5)).all() and set(out.is_holiday) <= {0, 1}


@pytest.mark.parametrize("lags", [(1, 2), (5, 60), (24, 168)])
def test_lags_equal_shift(toy, lags):
    for g in by_series(features.add_lag_features(toy, S, lags=lags)):
        for k in lags:
            np.testing.assert_allclose(g[f"lag_{k}h"], g.meter_reading.shift(k), rtol=1e-12)
    if lags == (24, 168):
        for g in by_series(features.add_lag_features(toy, S)):
            np.testing.assert_allclose(g.lag_diff_24h, g.lag_24h - g.lag_168h, rtol=1e-9)


def test_lag_difference_needs_both_lags(toy):
    assert "lag_diff_24h" not in features.add_lag_features(toy, S, lags=(24,)).columns


@pytest.mark.parametrize("window", [1, 6, 33, 150])
def test_rolling_equals_pandas_and_skips_the_current_row(toy, window):
    gaps = toy.withColumn("meter_reading", F.when(F.pmod(F.hash("timestamp", "meter"), F.lit(4)) != 0, F.col("meter_reading")))
    for source in (toy, gaps):
        for g in by_series(features.add_rolling_features(source, S, windows=(window,))):
            rolling = g.meter_reading.astype(float).shift(1).rolling(window, min_periods=max(1, window // 4))
            np.testing.assert_allclose(g[f"rolling_mean_{window}h"].astype(float), rolling.mean(), rtol=1e-9)
            np.testing.assert_allclose(g[f"rolling_std_{window}h"].astype(float), rolling.std(), rtol=1e-7, atol=1e-7)


def test_short_series_has_no_lag(hourly):
    out = features.add_history_features(hourly([1.0] * 10), S).toPandas()
    assert out.lag_24h.isna().all() and out.lag_168h.isna().all()
    assert out.rolling_mean_24h.notna().sum() == 4  # from six earlier rows on
    assert (out.rolling_std_24h.dropna() == 0).all()


def test_feature_sets(toy):
    assert len(features.FEATURE_COLUMNS) == 27
    assert sum(map(len, features.feature_groups().values())) == 27
    assert features.feature_set(toy, "raw") == ["meter"]
    with pytest.raises(ValueError):
        features.feature_set(toy, "other")
    assert features.drop_prefixed(toy.withColumn("te_x", F.lit(1))).columns == toy.columns


def test_codes_are_alphabetical_and_null_is_minus_one(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c")], "i int, primary_use string")
    out = df.withColumn("code", features.category_codes(df, "primary_use")).orderBy("i").collect()
    assert [r.code for r in out] == [1, -1, 0, 2]


def test_age_takes_site_median_then_overall_median(spark):
    rows = [(1, 10.0), (1, 10.0), (1, 40.0), (1, None), (2, None), (None, None)]
    out = features.fill_age(spark.createDataFrame(rows, "site_id int, building_age double")).collect()
    filled = sorted((r.site_id is None, r.site_id or 0, r.building_age) for r in out)
    assert filled == [(False, 1, 10.0), (False, 1, 10.0), (False, 1, 10.0), (False, 1, 40.0), (False, 2, 10.0), (True, 0, 10.0)]


def test_interactions_follow_the_columns_present(spark):
    df = spark.createDataFrame([(5, 1, 2.0, None), (6, 0, 2.0, 3.0)], "hour int, is_weekend int, log_square_feet double, air_temperature double")
    out = features.add_interaction_features(df).orderBy("hour").collect()
    assert [r.hour_x_weekend for r in out] == [5, 0] and [r.sqft_x_temp for r in out] == [0.0, 6.0]
    assert features.add_interaction_features(df.select("hour")).columns == ["hour"]


def test_encoding_is_the_smoothed_mean_of_training_rows(toy):
    timed = features.add_time_features(toy)
    train, val = timed.where("month = 11"), timed.where("month = 12")
    encoder = TargetEncoder(["primary_use", "hour"], smoothing=4).fit(train)
    out, rows = encoder.transform(val).toPandas(), train.toPandas()
    logs = np.log1p(rows.meter_reading)
    cells = logs.groupby([rows.primary_use, rows.hour]).agg(["sum", "count"])
    want = ((cells["sum"] + 4 * logs.mean()) / (cells["count"] + 4)).to_dict()
    got = out[encoder.column]
    np.testing.assert_allclose(got, [want.get((u, h), logs.mean()) for u, h in zip(out.primary_use, out.hour)], rtol=1e-9)
    assert len(out) == val.count()


def test_saved_encoder_gives_the_same_and_unknown_keys_the_overall_mean(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(u, int(h), float(v)) for u, h, v in zip(rng.choice(["Office", "Lab", "Dorm"], 300), rng.integers(0, 6, 300), rng.gamma(2, 5, 300))]
    train = spark.createDataFrame(rows, "primary_use string, hour int, meter_reading double")
    val = spark.createDataFrame([("Garage", 2, 1.0), (None, 2, 1.0), ("Lab", 17, 1.0), ("Lab", 2, 1.0)], train.schema)
    encoder = TargetEncoder(["primary_use", "hour"], smoothing=3).fit(train)
    encoder.save(str(tmp_path / "encoder"))
    again = TargetEncoder(["primary_use", "hour"], smoothing=3).load(spark, str(tmp_path / "encoder"))
    got, same = ([r[encoder.column] for r in e.transform(val).collect()] for e in (encoder, again))
    overall = np.mean([np.log1p(v) for _, _, v in rows])
    assert sorted(got) == pytest.approx(sorted(same)) and sum(abs(x - overall) < 1e-9 for x in got) == 3


def test_encoder_errors(spark):
    df = spark.createDataFrame([("a", 1)], "primary_use string, hour int")
    with pytest.raises(ValueError):
        TargetEncoder(["primary_use"]).fit(df)
    with pytest.raises(RuntimeError):
        TargetEncoder(["primary_use"]).transform(df)


def test_holidays_of_2016():
    us = holidays.country_holidays("US", 2016)
    assert {date(2016, 1, 1), date(2016, 1, 18), date(2016, 2, 15), date(2016, 5, 30), date(2016, 7, 4), date(2016, 9, 5),
            date(2016, 10, 10), date(2016, 11, 11), date(2016, 11, 24), date(2016, 12, 25), date(2016, 12, 26)} == us
    assert holidays.easter(2016) == date(2016, 3, 27) and holidays.easter(2024) == date(2024, 3, 31)
    assert {date(2016, 3, 25), date(2016, 5, 2), date(2016, 5, 30), date(2016, 12, 27)} <= holidays.country_holidays("UK", 2016)
    assert date(2016, 7, 1) in holidays.country_holidays("CA", 2016)
    assert {date(2016, 3, 17), date(2016, 3, 28), date(2016, 10, 31)} <= holidays.country_holidays("IE", 2016)


def test_holiday_follows_the_country_of_the_site(spark):
    rows = [(0, "2016-07-04 10:00:00"), (1, "2016-07-04 10:00:00"), (7, "2016-07-01 00:00:00"), (99, "2016-07-04 23:00:00")]
    df = spark.createDataFrame(rows, "site_id int, t string").withColumn("timestamp", F.col("t").cast("timestamp"))
    flags = {r.site_id: r.is_holiday for r in features.with_holiday_flag(df).collect()}
    assert flags == {0: 1, 1: 0, 7: 1, 99: 1}
    assert sum(r.is_holiday for r in features.with_holiday_flag(df.drop("site_id")).collect()) == 3
