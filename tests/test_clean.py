import numpy as np
import pandas as pd
import pytest
from helpers import assert_same, values
from pyspark.sql import functions as F

from meterlake.operators import clean
from meterlake.operators.series import Series

S = Series()


def test_rows_below_zero_are_dropped_in_any_order(hourly):
    rng = np.random.default_rng(21)
    given = [None if x > 2 else round(float(x), 3) for x in rng.normal(0, 2, 90)]
    kept = values(clean.drop_negative(hourly(given).orderBy(F.rand(3))), "meter_reading")
    assert kept == [x for x in given if x is None or x >= 0]


def test_unit_rules_apply_to_their_site_and_meter_alone(spark):
    rows = [(site, meter, float(site * 10 + meter)) for site in range(3) for meter in range(4)] + [(None, 0, 5.0), (0, None, 6.0), (0, 0, None)]
    df = spark.createDataFrame(rows, "site_id int, meter int, meter_reading double")
    rules = [(2, 1, 3.0), (0, 0, 0.5), (2, 1, 100.0)]
    got = sorted(map(tuple, clean.convert_units(df, rules=rules).collect()), key=repr)
    factor = {(2, 1): 3.0, (0, 0): 0.5}
    assert got == sorted(((s, m, None if v is None else v * factor.get((s, m), 1.0)) for s, m, v in rows), key=repr)
    only_kbtu = clean.convert_units(df.where("site_id = 0 and meter = 0"), value="meter_reading").where("meter_reading is not null").collect()
    assert [r.meter_reading for r in only_kbtu] == [0.0]
    assert "site_id" not in clean.convert_units(df.drop("site_id")).columns


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_runs_from_the_limit_on_are_dropped(hourly, limit):
    rng = np.random.default_rng(limit)
    given = [float(x) for x in rng.choice([0, 0, 0, 2, 9], 200)]
    runs, start = [0] * len(given), 0
    for i in range(len(given) + 1):
        if i == len(given) or given[i] != 0:
            runs[start:i] = [i - start] * (i - start)
            start = i + 1
    kept = values(clean.drop_zero_streaks(hourly(given), S, min_hours=limit), "meter_reading")
    assert kept == [x for x, n in zip(given, runs) if n < limit]


def test_runs_at_both_ends_count(hourly):
    out = clean.with_zero_runs(hourly([0, 0, 1, 0, 0, 0]), S)
    assert values(out, "zero_run") == [2, 2, 0, 3, 3, 3]


def test_null_inside_a_run_breaks_it(hourly):
    out = clean.with_zero_runs(hourly([0, 0, None, 0]), S)
    assert values(out, "zero_run") == [2, 2, 0, 1]


def test_runs_do_not_cross_series(hourly):
    df = hourly([0] * 30).unionByName(hourly([0] * 30, building=1))
    assert clean.drop_zero_streaks(df, S).count() == 60


def test_run_starts(hourly):
    out = clean.zero_run_starts(hourly([0, 0, 1, 0, 1, 0]), S)
    assert sorted(r["zero_run"] for r in out.collect()) == [1, 1, 2]


@pytest.mark.parametrize("split", [False, True])
def test_caps_are_quantiles_of_their_series_and_null_keys_are_left(spark, split):
    rng = np.random.default_rng(17)
    rows = [(b, i, float(v)) for b in (1, 2, None) for i, v in enumerate(rng.gamma(1.5, 4, 130))]
    df = spark.createDataFrame(rows, "building_id int, timestamp int, meter_reading double")
    given = pd.DataFrame(rows, columns=["b", "i", "v"])
    caps = given.groupby("b").v.quantile(0.9)
    out = clean.cap_outliers(df, Series(("building_id",), split=split), quantile=0.9).toPandas()
    assert len(out) == len(rows)
    for b, cap in caps.items():
        want = np.minimum(given[given.b == b].v, cap)
        np.testing.assert_allclose(np.sort(out[out.building_id == b].meter_reading), np.sort(want), rtol=1e-12)
    np.testing.assert_allclose(np.sort(out[out.building_id.isna()].meter_reading), np.sort(given[given.b.isna()].v))


def test_caps_from_other_rows(hourly):
    train = hourly([1, 2, 3])
    caps = clean.series_caps(train, S.keys, quantile=1.0)
    assert values(clean.cap_at(hourly([1, 5, 2]), caps, S.keys), "meter_reading") == [1, 3, 2]


def test_interpolation_equals_pandas(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame(
        {
            "site_id": np.repeat([1, 2, 3, 4], 30),
            "timestamp": np.tile(pd.date_range("2016-01-01", periods=30, freq="h"), 4),
            "air_temperature": rng.normal(10, 5, 120),
        }
    )
    rows.loc[rng.random(120) < 0.5, "air_temperature"] = np.nan
    rows.loc[rows.site_id == 3, "air_temperature"] = np.nan  # nothing known
    rows.loc[(rows.site_id == 4) & (rows.index % 30 != 7), "air_temperature"] = np.nan  # one value known
    want = rows.groupby("site_id").air_temperature.transform(lambda s: s.interpolate(method="linear", limit_direction="both"))
    given = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "site_id long, timestamp timestamp, air_temperature double")
    out = clean.interpolate(given, Series(("site_id",)), ["air_temperature"]).toPandas().sort_values(["site_id", "timestamp"])
    np.testing.assert_allclose(out.air_temperature.to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)


def test_cloud_median_and_dry_hours(spark):
    rows = [(1, "2016-01-01", 2.0, None), (1, "2016-01-02", None, 1.5), (2, "2016-01-01", 6.0, None)]
    df = spark.createDataFrame(rows, "site_id int, timestamp string, cloud_coverage double, precip_depth_1_hr double")
    out = clean.impute_weather(df.withColumn("timestamp", df.timestamp.cast("timestamp"))).orderBy("site_id", "timestamp").collect()
    assert [r.cloud_coverage for r in out] == [2.0, 4.0, 6.0]
    assert [r.precip_depth_1_hr for r in out] == [0.0, 1.5, 0.0]


def test_streak_treatments(hourly):
    df = hourly([0, 0, 4, 0, 0, 8, 0])
    assert values(clean.fill_streaks_forward(df, S, min_hours=2), "meter_reading") == [4, 4, 4, 4, 4, 8, 0]
    assert values(clean.fill_streaks_with_mean(df, S, min_hours=2), "meter_reading") == [4, 4, 4, 4, 4, 8, 0]
    all_zero = hourly([0, 0, 0])
    assert values(clean.fill_streaks_with_mean(all_zero, S, min_hours=2), "meter_reading") == [0, 0, 0]
    assert values(clean.fill_streaks_forward(all_zero, S, min_hours=2), "meter_reading") == [None, None, None]


def test_strategies_differ_only_in_streaks(hourly):
    df = hourly([5, -1, 0, 0, 0, 7], site=1)
    counts = {s: clean.apply_streak_strategy(df, S, s, min_hours=3, quantile=1.0).count() for s in clean.STRATEGIES}
    assert counts == {"drop": 2, "ffill": 5, "meter_mean": 5, "keep_zeros": 5}
    with pytest.raises(ValueError):
        clean.apply_streak_strategy(df, S, "other").count()


def test_basic_clean_on_an_empty_frame(hourly):
    assert clean.basic_clean(hourly([])).count() == 0


ZEROS = [3, 0, 0, 0, None, 0, 0, 7, 0, 5, -2, 0, 0, 0, 0, 9000, 4, 0, 0, 0]


@pytest.mark.parametrize("series", [Series(), Series(long_rows=5, chunk_rows=4)])
@pytest.mark.parametrize("strategy", clean.STRATEGIES)
def test_all_treatments_at_once_equal_each_alone(hourly, series, strategy):
    df = hourly(ZEROS).unionByName(hourly([0] * 6, building=1, meter=1)).unionByName(hourly([None, 2], building=2, meter=1))
    lost = hourly([1, 5, 900], start="2016-03-01").withColumn("building_id", F.lit(None).cast("long"))
    df = df.unionByName(lost)  # belongs to no series
    treated = clean.all_treatments(df, series, min_hours=3, quantile=0.9)
    got = clean.treatment(treated, strategy)
    want = clean.apply_streak_strategy(df, series, strategy, min_hours=3, quantile=0.9)
    assert got.columns == df.columns
    assert_same(got, want, ["timestamp", "building_id"])


def test_all_treatments_of_nothing_and_of_an_unknown_kind(hourly):
    treated = clean.all_treatments(hourly([1]).limit(0))
    assert treated.count() == 0
    with pytest.raises(ValueError):
        clean.treatment(treated, "other")
