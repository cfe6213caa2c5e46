"""Cleaning of readings and weather."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalars import no_nan
from meterlake.operators.quantiles import global_quantiles, group_quantiles
from meterlake.operators.series import POS, SIZE, Series, by_length, nearest_marks, same_keys
from meterlake.session import durable

# The unit rule (electricity of site 0 is metered in kBTU) and the weather columns to interpolate.
KBTU_TO_KWH = 0.293071
UNIT_RULES = [(0, 0, KBTU_TO_KWH)]
INTERPOLATED = ["air_temperature", "dew_temperature", "wind_speed", "sea_level_pressure", "wind_direction"]


def drop_negative(df: DataFrame, value: str = "meter_reading") -> DataFrame:
    """Drop rows below zero; a missing value stays."""
    return df.where(F.col(value).isNull() | (F.col(value) >= 0))


def convert_units(df: DataFrame, value: str = "meter_reading", rules: Sequence[tuple] = UNIT_RULES) -> DataFrame:
    """Multiply by the factor of the first (site, meter) rule that applies; no site column, no change."""
    if "site_id" not in df.columns:
        return df
    factor = F.coalesce(
        *[F.when((F.col("site_id") == site) & (F.col("meter") == meter), F.lit(k)) for site, meter, k in rules],
        F.lit(1.0),
    )
    return df.withColumn(value, F.col(value) * factor)


def is_zero(value: str) -> Column:
    """A missing value is not zero."""
    return F.coalesce(F.col(value) == 0, F.lit(False))


def _zero_runs(df: DataFrame, series: Series, value: str) -> DataFrame:
    # a run lies between the nearest rows that are not zero, or the ends of the series
    rows = nearest_marks(df, series, {"other": F.when(~is_zero(value), F.col(POS))})
    run = F.coalesce("other_after", F.col(SIZE) + 1) - F.coalesce("other_before", F.lit(0)) - 1
    return rows.withColumn("zero_run", F.when(is_zero(value), run).otherwise(F.lit(0)).cast("long"))


@by_length
def with_zero_runs(df: DataFrame, series: Series, value: str = "meter_reading") -> DataFrame:
    """Add `zero_run`, the length in rows of the run of zeros around a row (0 outside of runs)."""
    return _zero_runs(df, series, value).drop("other_before", "other_after", POS, SIZE)


@by_length
def drop_zero_streaks(df: DataFrame, series: Series, value: str = "meter_reading", min_hours: int = 48) -> DataFrame:
    """Drop the rows of zero runs of at least `min_hours` rows."""
    return with_zero_runs(df, series, value).where(F.col("zero_run") < min_hours).drop("zero_run")


@by_length
def zero_run_starts(df: DataFrame, series: Series, value: str = "meter_reading") -> DataFrame:
    """One row per run of zeros: the series keys, the time of its first row and its length."""
    rows = _zero_runs(df, series, value)
    first = F.col(POS) == F.coalesce("other_before", F.lit(0)) + 1
    return rows.where((F.col("zero_run") > 0) & first).select(*series.keys, series.time, "zero_run")


@by_length
def cap_outliers(df: DataFrame, series: Series, value: str = "meter_reading", quantile: float = 0.999) -> DataFrame:
    """Replace values above the quantile of their series by that quantile.

    An ordinary series takes it from the partition it is windowed in, a long one from an exact count. Rows with a null
    among their keys belong to no series and stay as they are.
    """
    if series.split:
        df = durable(df)  # read by each counting pass
        return cap_at(df, durable(series_caps(df, series.keys, value, quantile, series.long_rows)), series.keys, value)
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in series.keys])
    cap = F.when(known, F.percentile(value, F.lit(quantile)).over(Window.partitionBy(*series.keys)))
    return df.withColumn("_cap", cap).withColumn(value, _capped(value)).drop("_cap")


def _capped(value: str) -> Column:
    return F.when(F.col(value) > F.col("_cap"), F.col("_cap")).otherwise(F.col(value))


def cap_at(df: DataFrame, caps: DataFrame, keys: Sequence[str], value: str = "meter_reading") -> DataFrame:
    """Replace values above the cap of their series; `caps` (keys, cap) may come from other rows, such as training.

    `caps` should be a written table: Spark shuffles rows by a few hot keys where it cannot see that the caps are few.
    """
    caps = caps.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("cap").alias("_cap"))
    match = reduce(Column.__and__, [df[k] == caps[f"_c{i}"] for i, k in enumerate(keys)])
    return df.join(caps, match, "left").withColumn(value, _capped(value)).select(*df.columns)


def series_caps(
    df: DataFrame, keys: Sequence[str], value: str = "meter_reading", quantile: float = 0.999, large_rows: int = 5_000_000
) -> DataFrame:
    return group_quantiles(df, keys, value, [quantile], large_rows).select(*keys, F.col("q")[0].alias("cap"))


@by_length
def interpolate(df: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Fill gaps linearly by row position inside each series; at the ends the nearest value is taken."""
    marks = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(c).alias("v"))) for c in columns}
    rows = nearest_marks(df, series, marks)
    filled = {}
    for c in columns:
        a, b = F.col(f"{c}_before"), F.col(f"{c}_after")
        on_line = a["v"] + (b["v"] - a["v"]) * (F.col(POS) - a["p"]) / (b["p"] - a["p"])
        filled[c] = F.coalesce(F.col(c), F.when(a.isNotNull() & b.isNotNull(), on_line), a["v"], b["v"])
    return rows.withColumns(filled).select(*df.columns)


def fill_with_median(df: DataFrame, column: str) -> DataFrame:
    """Fill nulls with the median over all rows."""
    median = global_quantiles(df, column, [0.5]).select(F.col("q")[0])
    return df.withColumn(column, F.coalesce(F.col(column), median.scalar()))


def fill_with_common_median(df: DataFrame, column: str) -> DataFrame:
    """The same for a column of few distinct values, by counting each value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    median = counts.agg(F.percentile(column, F.lit(0.5), F.col("n")))
    return df.withColumn(column, F.coalesce(F.col(column), median.scalar()))


def fill_with(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def impute_weather(weather: DataFrame, series: Series = Series(keys=("site_id",))) -> DataFrame:
    """Interpolate the continuous columns by site, cloud cover gets the global median, precipitation 0."""
    out = interpolate(weather, series, [c for c in INTERPOLATED if c in weather.columns])
    if "cloud_coverage" in weather.columns:
        out = fill_with_common_median(out, "cloud_coverage")  # eighths of the sky
    if "precip_depth_1_hr" in weather.columns:
        out = fill_with(out, "precip_depth_1_hr", 0.0)
    return out


@by_length
def _fill_streaks_from_neighbours(df: DataFrame, series: Series, value: str) -> DataFrame:
    rows = nearest_marks(df, series, {"seen": F.col(value)})
    return rows.withColumn(value, F.coalesce(value, "seen_before", "seen_after")).select(*df.columns)


@by_length
def fill_streaks_forward(df: DataFrame, series: Series, value: str = "meter_reading", min_hours: int = 48) -> DataFrame:
    """Take long zero runs, and missing values, from the last value before; at the start from the first after."""
    marked = with_zero_runs(df, series, value)
    blanked = F.when(F.col("zero_run") < min_hours, F.col(value))
    return _fill_streaks_from_neighbours(marked.withColumn(value, blanked).drop("zero_run"), series, value)


@by_length
def fill_streaks_with_mean(df: DataFrame, series: Series, value: str = "meter_reading", min_hours: int = 48) -> DataFrame:
    """Replace long zero runs by the mean of the other rows of the series, or by 0 where there are none."""
    marked = with_zero_runs(df, series, value)
    good = F.col("zero_run") < min_hours
    mean = F.avg(F.when(good, F.col(value)))
    if series.split:
        marked = durable(marked)  # read for the means and for the rows
        means = durable(marked.groupBy(*series.keys).agg(mean.alias("_mean")))
        out = marked.join(means, same_keys(marked, means, series.keys), "left").select(*[marked[c] for c in marked.columns], "_mean")
    else:
        out = marked.withColumn("_mean", mean.over(Window.partitionBy(*series.keys)))
    return out.withColumn(value, F.when(good, F.col(value)).otherwise(F.coalesce("_mean", F.lit(0.0)))).select(*df.columns)


STRATEGIES = ("drop", "ffill", "meter_mean", "keep_zeros")


@by_length
def handle_streaks(
    df: DataFrame, series: Series, strategy: str, value: str = "meter_reading", min_hours: int = 48
) -> DataFrame:
    """Negatives out, units converted, and one of four treatments of long zero runs."""
    handlers = {
        "drop": drop_zero_streaks,
        "ffill": fill_streaks_forward,
        "meter_mean": fill_streaks_with_mean,
        "keep_zeros": lambda frame, *_: frame,
    }
    if strategy not in handlers:
        raise ValueError(f"strategy {strategy!r} is none of {sorted(handlers)}")
    return handlers[strategy](convert_units(drop_negative(df, value), value), series, value, min_hours)


@by_length
def apply_streak_strategy(
    df: DataFrame, series: Series, strategy: str, value: str = "meter_reading", min_hours: int = 48, quantile: float = 0.999
) -> DataFrame:
    """`handle_streaks`, then the outlier cap."""
    return cap_outliers(handle_streaks(df, series, strategy, value, min_hours), series, value, quantile)


@by_length
def _treated(df: DataFrame, series: Series, value: str, min_hours: int) -> DataFrame:
    marked = with_zero_runs(convert_units(drop_negative(df, value), value), series, value)
    kept = F.col("zero_run") < min_hours
    rows = nearest_marks(marked.withColumn("drop", F.when(kept, F.col(value))), series, {"seen": F.col("drop")}).drop(POS, SIZE)
    if series.split:
        rows = durable(rows)  # read for the means and for the rows
        means = durable(rows.groupBy(*series.keys).agg(F.avg("drop").alias("_mean")))
        rows = rows.join(means, same_keys(rows, means, series.keys), "left").select(*[rows[c] for c in rows.columns], "_mean")
    else:
        rows = rows.withColumn("_mean", F.avg("drop").over(Window.partitionBy(*series.keys)))
    return rows.select(
        *df.columns,
        kept.alias("kept"),
        "drop",
        F.coalesce("drop", "seen_before", "seen_after").alias("ffill"),
        F.when(kept, F.col(value)).otherwise(F.coalesce("_mean", F.lit(0.0))).alias("meter_mean"),
        F.col(value).alias("keep_zeros"),
    )


@by_length
def _capped_treatments(df: DataFrame, series: Series, value: str, min_hours: int, quantile: float) -> DataFrame:
    treated = _treated(df, series, value, min_hours)
    if series.split:
        treated = durable(treated)  # read for the caps and for the rows
        kinds = [F.struct(F.lit(s).alias("s"), F.col(s).cast("double").alias("v")) for s in STRATEGIES]
        each = treated.select(*series.keys, F.explode(F.array(*kinds)).alias("t")).select(*series.keys, "t.*")
        found = group_quantiles(each, [*series.keys, "s"], "v", [quantile])
        caps = found.groupBy(*series.keys).agg(*[F.max(F.when(F.col("s") == s, F.col("q")[0])).alias(f"_cap_{s}") for s in STRATEGIES])
        caps = durable(caps.na.drop(subset=list(series.keys)))  # rows with a null key belong to no series
        joined = treated.join(caps, same_keys(treated, caps, series.keys), "left").select(*[treated[c] for c in treated.columns], *[f"_cap_{s}" for s in STRATEGIES])
    else:
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in series.keys])
        whole = Window.partitionBy(*series.keys)
        joined = treated.withColumns({f"_cap_{s}": F.when(known, F.percentile(no_nan(s), F.lit(quantile)).over(whole)) for s in STRATEGIES})
    capped = {s: F.when(F.col(s).isNotNull(), F.least(F.col(s), F.coalesce(f"_cap_{s}", F.col(s)))) for s in STRATEGIES}
    return joined.withColumns(capped).drop(*[f"_cap_{s}" for s in STRATEGIES])


def all_treatments(
    df: DataFrame, series: Series = Series(), value: str = "meter_reading", min_hours: int = 48, quantile: float = 0.999
) -> DataFrame:
    """The reading after each of the four treatments of long zero runs, capped, as a column named like its strategy, next to
    the columns of `df`. `kept` tells the rows that "drop" leaves. Written.

    Runs and caps of ordinary series come from the partition they are windowed in; caps of long ones from another pass.
    """
    return durable(_capped_treatments(df, series, value, min_hours, quantile))


def treatment(treated: DataFrame, strategy: str, value: str = "meter_reading") -> DataFrame:
    """The readings of one strategy, from `all_treatments`."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {sorted(STRATEGIES)}")
    rows = treated.where("kept") if strategy == "drop" else treated
    return rows.withColumn(value, F.col(strategy)).drop("kept", *[s for s in STRATEGIES if s != value])


def basic_clean(
    df: DataFrame, series: Series = Series(), value: str = "meter_reading", quantile: float = 0.999, min_hours: int = 48
) -> DataFrame:
    """Negatives out, units converted, long zero runs out, outliers capped."""
    return apply_streak_strategy(df, series, "drop", value, min_hours, quantile)
