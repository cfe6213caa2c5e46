"""Regular grids, lookback windows and one forecast per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import clip, from_log, seconds, to_log
from meterlake.operators.explore import last_rows
from meterlake.operators.series import POS, Series, by_length, nearest_marks, reaching_back, with_position
from meterlake.session import durable


def hourly_grid(df: DataFrame, series: Series, step: str = "1 hour") -> DataFrame:
    """Every step between the first and last row of each series; values between rows are null."""
    ends = df.groupBy(*series.keys).agg(F.min(series.time).alias("_a"), F.max(series.time).alias("_b"))
    stamps = F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(series.time)
    grid = ends.select(*series.keys, stamps)
    return grid.join(df, [*series.keys, series.time], "left")


@by_length
def _time_weighted(df: DataFrame, series: Series, value: str) -> DataFrame:
    now = seconds(series.time)
    mark = F.when(F.col(value).isNotNull(), F.struct(now.alias("t"), F.col(value).alias("v")))
    rows = nearest_marks(df, series, {"seen": mark})
    a, b = F.col("seen_before"), F.col("seen_after")
    on_line = a["v"] + (b["v"] - a["v"]) * (now - a["t"]) / (b["t"] - a["t"])
    filled = F.coalesce(F.col(value), F.when(a.isNotNull() & b.isNotNull(), on_line), a["v"], b["v"], F.lit(0.0))
    return rows.withColumn(value, filled).select(*df.columns)


def regularize_hourly(df: DataFrame, series: Series, value: str = "meter_reading") -> DataFrame:
    """One row per hour and series, gaps filled on the line between the neighbours in time."""
    grid = hourly_grid(df.select(*series.keys, series.time, value), series)
    return _time_weighted(grid, series, value)


@by_length
def lookback_windows(
    df: DataFrame,
    series: Series,
    features: Sequence[str],
    target: str = "meter_reading",
    lookback: int = 168,
    stride: int = 1,
    until=None,
    after=None,
) -> DataFrame:
    """For each row with `lookback` rows before it: these rows' features as an array, and the target.

    `until` keeps targets up to a time; `after` keeps targets later than a time, which may look back across it.
    Every `stride`-th target is kept, counted from the first possible one of the series.
    """
    rows, w, finish = reaching_back(df, series, lookback)
    # a struct keeps rows with null features in the list
    window = F.collect_list(F.struct(*features)).over(w.rowsBetween(-lookback, -1))
    made = rows.withColumn("window", window).where(F.col(POS) > lookback)
    first = F.lit(lookback)
    if after is not None:
        made = made.where(F.col(series.time) > after)
        passed = df.where(F.col(series.time) <= after).groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_passed"))
        made = made.join(passed, list(series.keys), "left")
        first = F.coalesce(F.col("_passed"), F.lit(0))
    if until is not None:
        made = made.where(F.col(series.time) <= until)
    if stride > 1:
        made = made.where((F.col(POS) - 1 - first) % stride == 0)
    return finish(made).select(*series.keys, *series.order, F.col(target).alias("target"), "window")


def naive_table(train: DataFrame, series: Series, value: str, period: int) -> DataFrame:
    """One row per series: its number of rows, its mean log reading and the array of its last `period` readings."""
    keys = list(series.keys)
    seen = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"), F.avg(to_log(value)).alias("_level"))
    newest = last_rows(train, keys, series.order, period).select(*keys, (-F.col("_back")).alias("at"), clip(value, 0.0).alias("y"))
    # at most `period` entries each
    tails = newest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "y"))).alias("_tail"))
    return seen.join(tails, keys)


def _naive() -> Column:
    period = F.size("_tail")
    tiled = F.element_at("_tail", ((F.col("step") - 1) % period + 1).cast("int"))["y"]
    return F.when(F.col("_seen") >= F.col("_period"), tiled).otherwise(F.expm1("_level"))


def _forecast(val: DataFrame, series: Series, table: DataFrame, period: int, pred: Column) -> DataFrame:
    """Validation rows with their forecast from the row of their series; rows of unknown series get none."""
    steps = with_position(val, series, "step")
    joined = steps.join(durable(table), list(series.keys), "left").withColumn("_period", F.lit(period))
    return joined.withColumn("y_pred", pred).select(*val.columns, "y_pred")


def naive_forecast(
    steps: DataFrame, series: Series, table: DataFrame, period: int, paths: DataFrame, pred: Column
) -> DataFrame:
    """Rows with their `step` and `y_pred`: `pred` of the row of `paths` for their series and step, else the naive forecast."""
    keys = list(series.keys)
    joined = steps.join(paths, [*keys, "step"], "left").join(durable(table), keys, "left").withColumn("_period", F.lit(period))
    return joined.withColumn("y_pred", F.coalesce(pred, _naive()))


def seasonal_naive(
    train: DataFrame, val: DataFrame, series: Series, value: str = "meter_reading", period: int = 24
) -> DataFrame:
    """Repeat the last `period` training rows of each series over its validation rows.

    Series with fewer rows get exp(mean log) - 1 of what they have; series without training rows no prediction.
    """
    return _forecast(val, series, naive_table(train, series, value, period), period, _naive())


@by_length
def _two_back(df: DataFrame, series: Series) -> DataFrame:
    rows, w, finish = reaching_back(df, series, 2)
    return finish(rows.withColumns({"_z1": F.lag("_z0", 1).over(w), "_z2": F.lag("_z0", 2).over(w)}))


def fit_ar(train: DataFrame, series: Series, value: str = "meter_reading", min_rows: int = 48) -> DataFrame:
    """Autoregression of order 0, 1 or 2 on the log reading per series, by least squares, order by AIC.

    All sums are grouped aggregates. Only stationary fits compete. Series that are short or constant get no row.
    """
    z = train.select(*series.keys, *series.order, to_log(value).alias("_z0"))
    rows = _two_back(z, series)
    known = F.col("_z2").isNotNull() & F.col("_z1").isNotNull() & F.col("_z0").isNotNull()
    z0, z1, z2 = (F.when(known, F.col(c)) for c in ("_z0", "_z1", "_z2"))
    newest = F.max(F.struct(*series.order, "_z0", "_z1"))
    sums = rows.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(z0).alias("n"),
        F.avg(z0).alias("m0"), F.avg(z1).alias("m1"), F.avg(z2).alias("m2"),
        F.var_pop(z0).alias("v0"), F.var_pop(z1).alias("v1"), F.var_pop(z2).alias("v2"),
        F.covar_pop(z0, z1).alias("c01"), F.covar_pop(z0, z2).alias("c02"), F.covar_pop(z1, z2).alias("c12"),
        newest["_z0"].alias("x0"), newest["_z1"].alias("x1"),
    )
    c = {name: F.col(name) for name in sums.columns}
    sums = sums.where((c["rows"] >= min_rows) & (c["v0"] > 1e-12) & (c["v1"] > 1e-12) & (c["v2"] > 1e-12))
    det = F.nullif(c["v1"] * c["v2"] - c["c12"] * c["c12"], F.lit(0.0))
    sums = sums.withColumns(
        {
            "p1": c["c01"] / c["v1"],
            "a1": (c["c01"] * c["v2"] - c["c02"] * c["c12"]) / det,
            "a2": (c["c02"] * c["v1"] - c["c01"] * c["c12"]) / det,
        }
    )
    p1, a1, a2 = F.col("p1"), F.col("a1"), F.col("a2")
    rss = [c["v0"], c["v0"] - p1 * c["c01"], c["v0"] - a1 * c["c01"] - a2 * c["c02"]]
    steady = [F.lit(True), F.abs(p1) < 1, (F.abs(a2) < 1) & (a1 + a2 < 1) & (a2 - a1 < 1)]
    aic = [
        F.when(ok & (r > 1e-12), c["n"] * F.log(r) + 2.0 * (order + 1)) for order, (r, ok) in enumerate(zip(rss, steady))
    ]
    best = F.least(*aic)
    order = F.when(aic[0] == best, 0).when(aic[1] == best, 1).otherwise(2)
    fitted = sums.withColumn("order", order)
    first = F.when(F.col("order") == 1, p1).when(F.col("order") == 2, a1).otherwise(F.lit(0.0))
    second = F.when(F.col("order") == 2, a2).otherwise(F.lit(0.0))
    fitted = fitted.withColumns({"phi1": first, "phi2": second})
    gap = c["m0"] - F.col("phi1") * c["m1"] - F.col("phi2") * c["m2"]
    return fitted.select(
        *series.keys, "rows", "order", "phi1", "phi2",
        (gap / (1 - F.col("phi1") - F.col("phi2"))).alias("level"), "x0", "x1",
    )


def _ar_at(step: Column) -> Column:
    """Log forecast `step` rows ahead of a fitted row, in closed form, so every row is computed on its own."""
    phi1, phi2, level = F.col("phi1"), F.col("phi2"), F.col("level")
    now, before = F.col("x0") - level, F.col("x1") - level
    n = step + 1  # steps from the row before the last one
    disc = phi1 * phi1 + 4 * phi2
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    r1, r2 = (phi1 + root) / 2, (phi1 - root) / 2
    share = (now - r2 * before) / F.nullif(r1 - r2, F.lit(0.0))
    real = share * F.pow(r1, n) + (before - share) * F.pow(r2, n)
    radius = F.sqrt(F.greatest(-phi2, F.lit(0.0)))
    angle = F.acos(clip(phi1 / (2 * F.nullif(radius, F.lit(0.0))), -1.0, 1.0))
    side = (now - radius * before * F.cos(angle)) / F.nullif(radius * F.sin(angle), F.lit(0.0))
    turning = F.pow(radius, n) * (before * F.cos(n * angle) + side * F.sin(n * angle))
    double = F.pow(phi1 / 2, n) * (before + (now / F.nullif(phi1 / 2, F.lit(0.0)) - before) * n)
    second = F.when(disc > 0, real).when(disc < 0, turning).otherwise(double)
    return level + F.when(F.col("order") == 0, 0.0).when(F.col("order") == 1, F.pow(phi1, step) * now).otherwise(second)


def forecast_ar(
    train: DataFrame, val: DataFrame, series: Series, value: str = "meter_reading", period: int = 24, grid: bool = False
) -> DataFrame:
    """Validation rows with `y_pred` from the autoregression of their series, else as in `seasonal_naive`.

    With `grid` the training rows are first put on the hourly grid, so that neighbours are an hour apart.
    """
    if grid:
        train = durable(regularize_hourly(train, series, value))  # read by every step below
    fitted = fit_ar(train, series, value, 2 * period).drop("rows")
    table = naive_table(train, series, value, period).join(fitted, list(series.keys), "left")
    pred = F.when(F.col("order").isNotNull(), from_log(_ar_at(F.col("step").cast("double")))).otherwise(_naive())
    return _forecast(val, series, table, period, pred)
