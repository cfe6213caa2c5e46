"""Seasonal forecasts: one model per series, chosen by AIC, all solved from one matrix of moments.

A model is an autoregression on some lags of the (differenced) log reading, with lags of the shocks. Differences, shifts
and shocks of a long autoregression are all linear in the lagged readings. So one pass over the rows, for the means
and the joint moments of the lagged readings, is enough to solve every order of every series: an order is a linear map of
that matrix. The error of a differenced model is its one-step error of the reading itself, on the same rows, so that AIC
compares all orders.

Series may have any length: rows of long ones come in chunks, whose moments are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meterlake.functions.scalars import from_log, to_log
from meterlake.operators.explore import last_rows
from meterlake.operators.forecast import naive_forecast, naive_table, regularize_hourly
from meterlake.operators.series import Series, by_length, reaching_back, with_position
from meterlake.session import durable

SMALLEST = 1e-12  # errors below count as this
STEPS = 1_000  # of a path worked out at a time


@dataclass(frozen=True)
class Order:
    """Lags `ar` of the series, differenced once and over a season if so wanted, and lags `ma` of its shocks."""

    ar: tuple[int, ...] = ()
    ma: tuple[int, ...] = ()
    once: bool = False
    seasonal: bool = False

    @property
    def level(self) -> bool:
        """Differenced series have no level of their own."""
        return not (self.once or self.seasonal)

    def difference(self, period: int) -> dict[int, float]:
        """The coefficient of each lag in the difference."""
        out = {0: 1.0}
        for step in [1] * self.once + [period] * self.seasonal:
            for lag, c in list(out.items()):
                out[lag + step] = out.get(lag + step, 0.0) - c
        return out


def search(period: int = 24, max_p: int = 3, max_q: int = 2, max_order: int = 5) -> list[Order]:
    """All orders up to `max_p` lags and `max_q` shocks, each with or without a season, of at most `max_order` parts."""
    out = []
    for p, sp, q, sq, once, seasonal in product(range(max_p + 1), (0, 1), range(max_q + 1), (0, 1), (False, True), (False, True)):
        if p + sp + q + sq <= max_order:
            ar = tuple(range(1, p + 1)) + tuple(period + k for k in range(min(p, max_p - 1) + 1)) * sp
            out.append(Order(ar, tuple(range(1, q + 1)) + (period,) * sq, once, seasonal))
    return out


class Layout:
    """The lags that a list of orders needs, and their place in the matrix of moments."""

    def __init__(self, orders: Sequence[Order], period: int):
        self.orders, self.period = list(orders), period
        self.long = sorted({lag + d for o in orders for lag in (0, *o.ar) for d in o.difference(period)})
        shocks = {j for o in orders for j in o.ma}
        self.lags = sorted({lag + j for lag in self.long for j in (0, *shocks)})
        self.at = {lag: k for k, lag in enumerate(self.lags)}
        self.reach = max(self.lags)

    def rows(self, order: Order) -> np.ndarray:
        """The differenced value and its lags, as combinations of the lagged readings."""
        out = np.zeros((1 + len(order.ar), len(self.lags)))
        for row, lag in enumerate((0, *order.ar)):
            for d, c in order.difference(self.period).items():
                out[row, self.at[lag + d]] += c
        return out

    def recursion(self, order: Order, phi: np.ndarray) -> dict[int, float]:
        """The coefficient of each past reading in the next one."""
        out: dict[int, float] = {}
        for lag, weight in zip((0, *order.ar), (1.0, *-phi)):
            for d, c in order.difference(self.period).items():
                out[lag + d] = out.get(lag + d, 0.0) - weight * c
        return {lag: c for lag, c in out.items() if lag}


def solve(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares of many series at once; directions without spread get nothing."""
    if not gram.shape[-1]:
        return np.zeros(cross.shape)
    return (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ cross[..., None])[..., 0]


def steady(ar: tuple[int, ...], phi: np.ndarray) -> bool:
    """Whether the autoregression dies out."""
    if not ar:
        return True
    polynomial = np.zeros(max(ar) + 1)
    polynomial[0] = 1.0
    np.subtract.at(polynomial, list(ar), phi)
    return bool((np.abs(np.roots(polynomial)) < 1 - 1e-6).all())


def fit_orders(n: np.ndarray, mean: np.ndarray, spread: np.ndarray, layout: Layout) -> list[dict]:
    """The best order of each series from its moments: rows n, means and sums of squared deviations of the lagged readings."""
    cov = spread / n[:, None, None]
    long = [layout.at[lag] for lag in layout.long if lag]
    now = layout.at[0]
    far = solve(cov[:, long][:, :, long], cov[:, long, now])
    far_level = mean[:, now] - (far * mean[:, long]).sum(axis=1)

    def shocks(lags: tuple[int, ...]) -> np.ndarray:
        out = np.zeros((len(n), len(lags), len(layout.lags)))
        for row, j in enumerate(lags):
            out[:, row, layout.at[j]] = 1.0
            for k, lag in enumerate([lag for lag in layout.long if lag]):
                out[:, row, layout.at[lag + j]] -= far[:, k]
        return out

    tried = []
    for order in layout.orders:
        plain = np.broadcast_to(layout.rows(order), (len(n), 1 + len(order.ar), len(layout.lags)))
        rows = np.concatenate([plain, shocks(order.ma)], axis=1)
        moments = rows @ cov @ rows.transpose(0, 2, 1)
        means = (rows @ mean[..., None])[..., 0]
        means[:, 1 + len(order.ar) :] -= far_level[:, None]
        if not order.level:
            moments = moments + means[:, :, None] * means[:, None, :]
        weights = solve(moments[:, 1:, 1:], moments[:, 1:, 0])
        signed = np.concatenate([np.ones((len(n), 1)), -weights], axis=1)
        error = np.maximum(np.einsum("si,sij,sj->s", signed, moments, signed), SMALLEST)
        level = (signed * means).sum(axis=1) if order.level else np.zeros(len(n))
        aic = n * np.log(error) + 2 * (weights.shape[1] + order.level + 1)
        tried.append((aic, weights, level, error))
    scores = np.stack([t[0] for t in tried])
    out = []
    for s in range(len(n)):
        for k in np.argsort(scores[:, s], kind="stable"):
            order, (aic, weights, level, error) = layout.orders[k], tried[k]
            phi, theta = weights[s, : len(order.ar)], weights[s, len(order.ar) :]
            if steady(order.ar, phi):
                recursion = layout.recursion(order, phi)
                out.append(
                    {
                        "once": order.once, "seasonal": order.seasonal, "ar": list(order.ar), "phi": phi.tolist(),
                        "ma": list(order.ma), "theta": theta.tolist(), "level": float(level[s]), "error": float(error[s]),
                        "aic": float(aic[s]), "lags": list(recursion), "weights": list(recursion.values()),
                        "far": far[s].tolist(), "far_level": float(far_level[s]), "usual": float(mean[s, now]),
                    }
                )
                break
        else:
            out.append({})
    return out


FITTED = (
    "once boolean, seasonal boolean, ar array<int>, phi array<double>, ma array<int>, theta array<double>, level double, error double, "
    "aic double, lags array<int>, weights array<double>, far array<double>, far_level double, usual double"
)


@by_length
def _lagged(z: DataFrame, series: Series, lags: Sequence[int]) -> DataFrame:
    rows, w, finish = reaching_back(z, series, max(max(lags), 1))
    return finish(rows.withColumns({f"_z{lag}": F.lag("_z", lag).over(w) for lag in lags}))


def _keys_of(df: DataFrame, series: Series) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in series.keys)


def merged(parts: list[dict]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squared deviations of several stretches together."""
    n, mean, spread = 0, 0.0, 0.0
    for part in parts:
        k, m = part["n"], np.array(part["mean"])
        s = np.array(part["spread"]).reshape(len(m), len(m))
        gap = m - mean
        spread = spread + s + np.outer(gap, gap) * (n * k / (n + k))
        mean = mean + gap * (k / (n + k))
        n += k
    return n, np.asarray(mean), np.asarray(spread)


def _stretches(width: int, n_keys: int):
    """Moments of every run of rows of one series in a batch; rows with an unknown lag do not count."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys + 1 :]]) if batch.num_rows else np.zeros((0, width))
            known = ~np.isnan(x).any(axis=1)
            at, x = np.flatnonzero(known), x[known]
            if not len(at):
                continue
            mark = batch.column(n_keys).to_numpy()[at]
            starts = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            rows: dict[str, list] = {"n": [], "mean": [], "spread": []}
            for a, b in zip(starts, [*starts[1:], len(at)]):
                mean = x[a:b].mean(axis=0)
                off = x[a:b] - mean
                for name, v in zip(rows, (b - a, mean.tolist(), (off.T @ off).ravel().tolist())):
                    rows[name].append(v)
            first = pa.array(at[starts])
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(first) for c in batch.columns[:n_keys]),
                    pa.array(rows["n"], pa.int64()),
                    pa.array(rows["mean"], pa.list_(pa.float64())),
                    pa.array(rows["spread"], pa.list_(pa.float64())),
                ],
                names=[*batch.schema.names[:n_keys], "n", "mean", "spread"],
            )

    return stretches


def _solved(layout: Layout, names: list[str], min_rows: int) -> Callable:
    kinds, n_keys = to_arrow_schema(StructType.fromDDL(FITTED + ", rows long")), len(names)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merged(parts) for parts in batch.column(n_keys).to_pylist()]
            at = [k for k, (n, _, spread) in enumerate(found) if n >= min_rows and spread[layout.at[0], layout.at[0]] > n * SMALLEST]
            if not at:
                continue
            n, mean, spread = (np.stack([found[k][i] for k in at]) for i in range(3))
            fits = fit_orders(n.astype(float), mean, spread, layout)
            done = [(k, f, int(rows)) for k, f, rows in zip(at, fits, n) if f]
            keys = [c.take(pa.array([k for k, _, _ in done], pa.int64())) for c in batch.columns[:n_keys]]
            told = pa.RecordBatch.from_pylist([f | {"rows": rows} for _, f, rows in done], kinds)
            yield pa.RecordBatch.from_arrays([*keys, *told.columns], names=[*names, *kinds.names])

    return solved


def fit_seasonal(
    train: DataFrame, series: Series, value: str = "meter_reading", period: int = 24, orders: Sequence[Order] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """One row per series: its best order with coefficients, level, one-step error, AIC, and rows it is fitted on.

    `orders` are those to choose from, by default `search(period)`; only such that die out are taken. Series that are
    constant, or have fewer than `min_rows` rows (two periods) with all lags known, get no row.
    """
    layout = Layout(search(period) if orders is None else orders, period)
    z = train.select(*series.keys, *series.order, to_log(value).alias("_z"))
    rows = _lagged(z, series, layout.lags)
    columns = [F.col(f"_z{lag}") for lag in layout.lags]
    marked = rows.select(*series.keys, F.xxhash64(*series.keys).alias("_mark"), *columns)
    keys, n_keys = _keys_of(train, series), len(series.keys)
    parts = marked.mapInArrow(_stretches(len(columns), n_keys), f"{keys}, n long, mean array<double>, spread array<double>")
    # one entry per Arrow batch that a series reaches into
    gathered = parts.groupBy(*series.keys).agg(F.collect_list(F.struct("n", "mean", "spread")).alias("_parts"))
    least = 2 * period if min_rows is None else min_rows
    return gathered.mapInArrow(_solved(layout, list(series.keys), least), f"{keys}, {FITTED}, rows long")


def _paths(layout: Layout, names: list[str]):
    """The path of every fitted series, step by step, all series of a batch together."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                yield from walked(whole.slice(start, 1_000))

    def walked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = batch.to_pylist()
        reach, long = layout.reach + 1, [lag for lag in layout.long if lag]
        weights, pushes = np.zeros((len(rows), reach + 1)), np.zeros((len(rows), reach + 1))
        past = np.array([[r["usual"]] * (reach - len(r["tail"])) + [r["usual"] if z is None else z for z in r["tail"]] for r in rows])
        far, far_level = np.array([r["far"] for r in rows]).reshape(len(rows), len(long)), np.array([r["far_level"] for r in rows])
        level, horizon = np.array([r["level"] for r in rows]), np.array([r["horizon"] for r in rows])
        for s, r in enumerate(rows):
            weights[s, r["lags"]], pushes[s, r["ma"]] = r["weights"], r["theta"]
        shocks = np.zeros_like(past)  # of the long autoregression, as far back as some order looks
        for back in range(1, 1 + max((j for o in layout.orders for j in o.ma), default=0)):
            at = reach - back
            shocks[:, at] = past[:, at] - far_level - sum(far[:, k] * past[:, at - lag] for k, lag in enumerate(long) if lag <= at)
        backwards, pushed = weights[:, :0:-1], pushes[:, :0:-1]
        for first in range(1, int(horizon.max()) + 1, STEPS):
            steps = min(STEPS, int(horizon.max()) - first + 1)
            line = np.concatenate([past, np.zeros((len(rows), steps))], axis=1)
            blows = np.concatenate([shocks, np.zeros((len(rows), steps))], axis=1)
            for h in range(steps):
                line[:, reach + h] = level + (line[:, h : h + reach] * backwards).sum(axis=1) + (blows[:, h : h + reach] * pushed).sum(axis=1)
            past, shocks = line[:, -reach:], blows[:, -reach:]
            series, step = np.nonzero(np.arange(first, first + steps)[None, :] <= horizon[:, None])
            keys = [batch.column(k).take(pa.array(series)) for k in names]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(step + first), pa.array(line[:, reach:][series, step])], names=[*names, "step", "path"])

    return paths


def forecast_seasonal(
    train: DataFrame, val: DataFrame, series: Series, value: str = "meter_reading", period: int = 24,
    orders: Sequence[Order] | None = None, grid: bool = True, min_rows: int | None = None,
) -> DataFrame:
    """Validation rows with `y_pred` from the seasonal model of their series, else as in `seasonal_naive`.

    With `grid` the training rows are first put on the hourly grid, so that neighbours are an hour apart.
    """
    orders = search(period) if orders is None else list(orders)
    layout, keys = Layout(orders, period), list(series.keys)
    if grid:
        train = durable(regularize_hourly(train, series, value))  # read by every step below
    steps = with_position(val, series, "step")
    newest = last_rows(train, keys, series.order, layout.reach + 1).select(*keys, (-F.col("_back")).alias("at"), to_log(value).alias("z"))
    tails = newest.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "z"))), lambda x: x["z"]).alias("tail"))
    fitted = durable(fit_seasonal(train, series, value, period, orders, min_rows))
    horizon = steps.groupBy(*keys).agg(F.max("step").alias("horizon"))
    ready = fitted.join(tails, keys).join(horizon, keys)
    paths = durable(ready.mapInArrow(_paths(layout, keys), f"{_keys_of(train, series)}, step long, path double"))
    return naive_forecast(steps, series, naive_table(train, series, value, period), period, paths, from_log("path")).select(*val.columns, "y_pred")
