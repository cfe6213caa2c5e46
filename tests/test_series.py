"""Chunked series must give the rows of whole series."""

from dataclasses import replace

import pytest
from helpers import assert_same, with_gaps
from pyspark.sql import functions as F

from meterlake.operators import clean, features, forecast, quantiles
from meterlake.operators.series import Series, long_series, with_position
from meterlake.sources import frames

KEYS = ["building_id", "ts", "l_orderkey", "l_linenumber", "l_partkey"]
WHOLE = replace(frames.ZEROS, split=False)
# about half of the suppliers hold more rows than this
CHUNKED = replace(frames.ZEROS, long_rows=300, chunk_rows=64)


@pytest.fixture(scope="module")
def rows(spark, folder):
    # one supplier holds a third of the rows, some hold few
    lines = frames.zeros(spark, folder)
    pick = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(30))
    skewed = lines.withColumn("building_id", F.when(pick < 10, 0).when(pick < 20, F.col("building_id")).otherwise(pick * 10 + F.col("building_id")))
    return skewed.withColumn("y", F.when(F.col("y") < 0.04, 0.0).otherwise(F.col("y"))).cache()


def test_some_series_are_long_and_some_are_not(rows):
    longs = long_series(rows, CHUNKED)
    assert 0 < longs.count() < rows.select("building_id").distinct().count()
    assert long_series(rows, frames.ZEROS) is None


def test_positions(rows):
    assert_same(with_position(rows, WHOLE), with_position(rows, CHUNKED), KEYS)


def test_zero_runs(rows):
    assert_same(clean.with_zero_runs(rows, WHOLE, "y"), clean.with_zero_runs(rows, CHUNKED, "y"), KEYS)


def test_one_run_over_several_chunks(rows):
    blank = rows.withColumn("y", F.when(F.col("building_id") == 0, 0.0).otherwise(F.col("y")))
    assert_same(clean.with_zero_runs(blank, WHOLE, "y"), clean.with_zero_runs(blank, CHUNKED, "y"), KEYS)


def test_history(rows):
    args = ("y", (1, 24, 168), (24, 168))
    assert_same(features.add_history_features(rows, WHOLE, *args), features.add_history_features(rows, CHUNKED, *args), KEYS)


def test_interpolation_and_fills(rows):
    gaps = with_gaps(rows, "y", KEYS).withColumn("y", F.when(F.col("building_id") != 203, F.col("y")))
    assert_same(clean.interpolate(gaps, WHOLE, ["y"]), clean.interpolate(gaps, CHUNKED, ["y"]), KEYS)
    for fill in (clean.fill_streaks_forward, clean.fill_streaks_with_mean):
        assert_same(fill(gaps, WHOLE, "y", 2), fill(gaps, CHUNKED, "y", 2), KEYS)


@pytest.mark.parametrize("strategy", clean.STRATEGIES)
def test_whole_cleaning_chain(rows, strategy):
    a = clean.apply_streak_strategy(rows, WHOLE, strategy, "y", 2, 0.9)
    assert_same(a, clean.apply_streak_strategy(rows, CHUNKED, strategy, "y", 2, 0.9), KEYS)


def test_lookback_windows(rows):
    args = (["y", "l_linenumber"], "y", 5, 3)
    a, b = (forecast.lookback_windows(rows, s, *args).withColumn("window", F.to_json("window")) for s in (WHOLE, CHUNKED))
    assert_same(a, b, KEYS)
    cut = "1998-01-01"
    a, b = (forecast.lookback_windows(rows, s, *args, after=cut).withColumn("window", F.to_json("window")) for s in (WHOLE, CHUNKED))
    assert_same(a, b, KEYS)
    assert a.agg(F.min("ts")).first()[0].year == 1998


def test_forecasts(rows):
    train, val = rows.where("ts < '2000-01-01'"), rows.where("ts >= '2000-01-01'")
    for step in (forecast.seasonal_naive, forecast.forecast_ar):
        assert_same(step(train, val, WHOLE, "y"), step(train, val, CHUNKED, "y"), KEYS, rtol=1e-7)


@pytest.mark.parametrize("keys", [["building_id"], []])
def test_quantiles_by_counting(rows, keys):
    gaps = with_gaps(rows, "y", KEYS).withColumn("y", F.col("y") * F.col("l_orderkey"))
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    a = quantiles.group_quantiles(gaps, keys, "y", probs).withColumns({f"q{i}": F.col("q")[i] for i in range(5)}).drop("q")
    b = quantiles.group_quantiles(gaps, keys, "y", probs, 20).withColumns({f"q{i}": F.col("q")[i] for i in range(5)}).drop("q")
    assert_same(a, b, keys or ["q0"])


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, y double")
    assert quantiles.global_quantiles(empty, "y", [0.5]).first()["q"] is None
    assert quantiles.group_quantiles(empty, ["k"], "y", [0.5]).count() == 0


def test_heavy_tail_quantile(spark):
    rows = spark.range(20_000).select(F.expr("exp(id / 1000.0)").alias("y"))
    want = quantiles.global_quantiles(rows, "y", [0.25, 0.999]).first()["q"]
    got = quantiles.global_quantiles(rows, "y", [0.25, 0.999], 100).first()["q"]
    assert got == pytest.approx(want, rel=1e-12)


def test_a_sketch_that_misses_costs_a_pass_and_no_error(spark, monkeypatch):
    """Brackets that lie beside their ranks: the whole range is read in the end."""
    monkeypatch.setattr(quantiles, "_brackets", off_by(quantiles._brackets))
    rows = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("y"))
    probs = [0.0, 0.123, 0.5, 1.0]
    want = quantiles.global_quantiles(rows, "y", probs).first()["q"]
    monkeypatch.setattr(quantiles._by_sketch, "__defaults__", (64,))
    assert quantiles.global_quantiles(rows, "y", probs, 100).first()["q"] == pytest.approx(want, rel=1e-12)


def off_by(brackets):
    """Brackets beside the wanted rank, but for the whole range."""
    return lambda bounds, by, probs, margin: brackets(bounds, by, probs if margin is None else [min(1.0, p + 0.2) for p in probs], margin and margin / 100)


def test_single_row_series(hourly):
    s = Series(long_rows=0, chunk_rows=2)
    out = features.add_history_features(hourly([5.0]), s).collect()
    assert len(out) == 1 and out[0].lag_24h is None
