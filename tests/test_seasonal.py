"""Seasonal models against row-wise least squares and a step-by-step path."""

import numpy as np
import pandas as pd
import pytest
from helpers import values
from pyspark.sql import functions as F

from meterlake.operators import forecast, seasonal
from meterlake.operators.seasonal import Layout, Order
from meterlake.operators.series import Series

S = Series()


def moments(z, lags):
    reach = max(lags)
    x = np.column_stack([z[reach - lag : len(z) - lag] for lag in lags])
    off = x - x.mean(axis=0)
    return np.array([float(len(x))]), x.mean(axis=0)[None], (off.T @ off)[None], x


def by_rows(z, layout, order):
    """The same model fitted on a table of rows: first the long autoregression, then the order with its shocks."""
    reach = layout.reach
    t = np.arange(reach, len(z))
    long = [lag for lag in layout.long if lag]
    far = np.linalg.lstsq(np.column_stack([np.ones(len(t)), *(z[t - lag] for lag in long)]), z[t], rcond=None)[0]
    shock = lambda s: z[s] - far[0] - sum(c * z[s - lag] for c, lag in zip(far[1:], long))
    w = lambda s: sum(c * z[s - d] for d, c in order.difference(layout.period).items())
    columns = [w(t - lag) for lag in order.ar] + [shock(t - j) for j in order.ma]
    x = np.column_stack([*([np.ones(len(t))] if order.level else []), *columns]) if columns or order.level else np.zeros((len(t), 0))
    fit = np.linalg.lstsq(x, w(t), rcond=None)[0]
    return fit, np.mean((w(t) - x @ fit) ** 2)


def daily(n, noise=0.1, seed=0):
    rng = np.random.default_rng(seed)
    t, e = np.arange(n), rng.normal(0, noise, n)
    drift = np.zeros(n)
    for k in range(1, n):
        drift[k] = 0.6 * drift[k - 1] + e[k]
    return 3 + np.sin(2 * np.pi * t / 24) + 0.5 * np.cos(2 * np.pi * t / 12) + drift


@pytest.mark.parametrize(
    "order",
    [
        Order(), Order((1,)), Order((1, 2, 3, 24, 25, 26)), Order((1,), (1,)), Order((1, 24), (1, 2, 24)), Order((1,), (), once=True),
        Order((1, 2), (1,), seasonal=True), Order((1,), (1, 24), True, True), Order((), (24,), seasonal=True),
    ],
)
def test_an_order_from_moments_is_least_squares_over_rows(monkeypatch, order):
    monkeypatch.setattr(seasonal, "steady", lambda ar, phi: True)
    z = daily(600)
    layout = Layout([order, Order((1, 2, 24))], 24)
    layout.orders = [order]
    n, mean, spread, _ = moments(z, layout.lags)
    got = seasonal.fit_orders(n, mean, spread, layout)[0]
    want, error = by_rows(z, layout, order)
    found = [got["level"]] * order.level + got["phi"] + got["theta"]
    np.testing.assert_allclose(found, want, rtol=1e-6, atol=1e-8)
    assert got["error"] == pytest.approx(error, rel=1e-7)


def test_search_takes_the_smallest_aic_of_all():
    z = daily(700, seed=4)
    orders = seasonal.search(24, 2, 1, 3)
    layout = Layout(orders, 24)
    n, mean, spread, _ = moments(z, layout.lags)
    best = seasonal.fit_orders(n, mean, spread, layout)[0]
    aic = {}
    for order in orders:
        fit, error = by_rows(z, layout, order)
        if seasonal.steady(order.ar, fit[order.level : order.level + len(order.ar)]):
            aic[order] = n[0] * np.log(error) + 2 * (len(fit) + 1)
    chosen = min(aic, key=aic.get)
    assert best["aic"] == pytest.approx(aic[chosen], rel=1e-9)
    assert (tuple(best["ar"]), tuple(best["ma"]), best["once"], best["seasonal"]) == (chosen.ar, chosen.ma, chosen.once, chosen.seasonal)


def test_stretches_merge_into_the_moments_of_all():
    x = np.random.default_rng(1).normal(5, 1, (90, 3))
    parts = []
    for a, b in ((0, 1), (1, 40), (40, 90)):
        mean = x[a:b].mean(axis=0)
        parts.append({"n": b - a, "mean": mean, "spread": ((x[a:b] - mean).T @ (x[a:b] - mean)).ravel()})
    n, mean, spread = seasonal.merged(parts)
    assert n == 90
    np.testing.assert_allclose(mean, x.mean(axis=0))
    np.testing.assert_allclose(spread, (x - mean).T @ (x - mean), atol=1e-9)


def test_steadiness():
    assert seasonal.steady((), np.array([])) and seasonal.steady((1, 24), np.array([0.5, 0.4]))
    assert not seasonal.steady((1,), np.array([1.0])) and not seasonal.steady((1, 24), np.array([0.6, 0.5]))


def walked(fit, z, steps):
    """The path by plain recursion; shocks of the past are those of the long autoregression."""
    layout = Layout(seasonal.search(24), 24)
    long = [lag for lag in layout.long if lag]
    line = list(z)
    shocks = {t: z[t] - fit.far_level - sum(c * z[t - lag] for c, lag in zip(fit.far, long)) for t in range(len(z) - 24, len(z))}
    for t in range(len(z), len(z) + steps):
        y = fit.level + sum(c * line[t - lag] for lag, c in zip(fit.lags, fit.weights))
        line.append(y + sum(c * shocks.get(t - j, 0.0) for j, c in zip(fit.ma, fit.theta)))
    return line[len(z) :]


def test_forecast_follows_its_recursion_and_beats_the_plain_autoregression(hourly):
    z = daily(24 * 50, seed=9)
    frame = hourly(np.expm1(z))
    cut = "2016-02-14 00:00:00"
    train, val = frame.where(F.col("timestamp") < cut), frame.where(F.col("timestamp") >= cut)
    fit = seasonal.fit_seasonal(train, S).first()
    got = forecast_of(seasonal.forecast_seasonal(train, val, S))
    np.testing.assert_allclose(got, np.expm1(np.clip(walked(fit, z[: 24 * 44], 144), 0, 14)), rtol=1e-7)
    plain = forecast_of(forecast.forecast_ar(train, val, S))
    error = lambda pred: np.sqrt(np.mean((pred - np.expm1(z[24 * 44 :])) ** 2))
    assert error(got) < 0.6 * error(plain)


def forecast_of(df):
    return df.orderBy("timestamp").toPandas().y_pred.to_numpy()


def test_a_pure_cycle_is_repeated(hourly):
    frame = hourly([float(10 + k % 24) for k in range(24 * 12)])
    cut = "2016-01-11 00:00:00"
    train, val = frame.where(F.col("timestamp") < cut), frame.where(F.col("timestamp") >= cut)
    np.testing.assert_allclose(forecast_of(seasonal.forecast_seasonal(train, val, S)), [10 + k % 24 for k in range(48)], rtol=1e-6)


def test_long_series_in_chunks_give_the_same_fit(spark, hourly):
    frame = hourly(np.expm1(daily(500, seed=3))).unionByName(hourly(np.expm1(daily(300, seed=5)), building=1))
    chunked = Series(long_rows=400, chunk_rows=100)
    keys = ["building_id", "meter"]
    a, b = (seasonal.fit_seasonal(frame, s).orderBy(*keys).collect() for s in (S, chunked))
    assert len(a) == len(b) == 2
    for x, y in zip(a, b):
        assert (x.ar, x.ma, x.once, x.seasonal, x.rows) == (y.ar, y.ma, y.once, y.seasonal, y.rows)
        np.testing.assert_allclose(x.phi + x.theta + [x.level, x.aic], y.phi + y.theta + [y.level, y.aic], rtol=1e-6)


def test_short_constant_unknown_and_null_series_fall_back(spark, hourly):
    cut = "2016-01-06 00:00:00"
    split = lambda f: (f.where(F.col("timestamp") < cut), f.where(F.col("timestamp") >= cut))
    train, val = split(hourly([7.0] * 200))
    assert seasonal.fit_seasonal(train, S).count() == 0
    np.testing.assert_allclose(forecast_of(seasonal.forecast_seasonal(train, val, S)), 7.0)
    train, val = split(hourly(range(150)))  # fewer rows with all lags than asked for
    assert seasonal.fit_seasonal(train, S, min_rows=100).count() == 0
    assert list(forecast_of(seasonal.forecast_seasonal(train, val, S, min_rows=100))) == list(range(96, 120)) + list(range(96, 102))
    stranger = val.withColumn("building_id", F.lit(5).cast("long"))
    assert set(values(seasonal.forecast_seasonal(train, stranger, S), "y_pred")) == {None}
    train, val = split(hourly([None if k % 50 == 3 else 5 + k % 24 for k in range(240)]))
    got = forecast_of(seasonal.forecast_seasonal(train, val, S))
    assert not pd.isna(got).any()
    assert seasonal.forecast_seasonal(train.limit(0), val, S).where("y_pred is not null").count() == 0
    assert seasonal.forecast_seasonal(train, val.limit(0), S).count() == 0
