"""From the three input tables to training and validation features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import to_log
from meterlake.operators import clean, features
from meterlake.operators.encoding import TargetEncoder
from meterlake.operators.joins import join_context, join_meta
from meterlake.operators.series import Series, by_length
from meterlake.operators.split import split_summary
from meterlake.session import durable

Splitter = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Prepared:
    """Both folds with features, the raw target `meter_reading` and the `label` that models learn."""

    train: DataFrame
    val: DataFrame
    features: list[str]
    encoder: TargetEncoder
    series: Series
    log_target: bool = True  # whether `label` is the log of the reading

    def stored(self) -> Prepared:
        """Both folds written once, for jobs that read them many times."""
        return replace(self, train=durable(self.train), val=durable(self.val))

    def learned(self) -> Prepared:
        """Both folds with no more than models read: time, features, label."""
        names = list(dict.fromkeys([self.series.time, *self.features, "label"]))
        return replace(self, train=self.train.select(*names), val=self.val.select(*names))

    def summary(self) -> DataFrame:
        return split_summary(self.train, self.val, self.series.time)


def build_features(
    df: DataFrame,
    series: Series,
    categories: DataFrame | None = None,
    lags: Sequence[int] = (24, 168),
    windows: Sequence[int] = (24, 168),
) -> DataFrame:
    """All features of a joined frame but the target encoding, which has to wait for the split."""
    out = features.add_history_features(df, series, lags=lags, windows=windows)
    out = features.add_building_features(features.add_time_features(out, series.time), categories)
    return features.add_interaction_features(features.add_weather_features(out))


def clean_history(
    readings: DataFrame,
    series: Series,
    sites: DataFrame,
    strategy: str | None = "drop",
    quantile: float = 0.999,
    min_hours: int = 48,
    lags: Sequence[int] = (24, 168),
    windows: Sequence[int] = (24, 168),
    cap_rows: Column | None = None,
) -> DataFrame:
    """Cleaned readings with lags and rolling statistics; `sites` gives the site of each building. With no strategy the
    readings are taken as they come, as from `clean.treatment`.

    Cleaning and history need nothing but the reading and its site, so the wide context is joined later and one
    shuffle of narrow rows by series serves zero runs, caps, lags and rolling frames.
    """
    if strategy is None:
        return features.add_history_features(readings, series, lags=lags, windows=windows)
    series = series.measured(readings)
    # joined before the rows are dealt out by series, which no later step undoes
    narrow = readings.join(sites.select("building_id", "site_id"), "building_id", "left")
    return _tidy_history(narrow, series, readings.columns, strategy, quantile, min_hours, lags, windows, cap_rows)


@by_length
def _tidy_history(
    narrow: DataFrame, series: Series, columns: Sequence[str], strategy: str, quantile: float, min_hours: int, lags: Sequence[int],
    windows: Sequence[int], cap_rows: Column | None,
) -> DataFrame:
    tidy = clean.handle_streaks(narrow, series, strategy, min_hours=min_hours).select(*columns)
    if cap_rows is None:
        tidy = clean.cap_outliers(tidy, series, quantile=quantile)
    else:
        tidy = durable(tidy)  # read for the caps and for the rows
        caps = durable(clean.series_caps(tidy.where(cap_rows), series.keys, quantile=quantile))
        tidy = clean.cap_at(tidy, caps, series.keys)
    return features.add_history_features(tidy, series, lags=lags, windows=windows)


def prepare(
    readings: DataFrame,
    meta: DataFrame,
    weather: DataFrame,
    split: Splitter,
    series: Series = Series(),
    weather_series: Series = Series(keys=("site_id",)),
    feature_set: str = "engineered",
    smoothing: float = 30,
    log_target: bool = True,
    **cleaning,
) -> Prepared:
    """Clean, split by time, encode on the training fold, join the context, build and project the features, drop
    incomplete rows. `cleaning` goes to `clean_history`.

    Caps come from all rows, as in the published numbers; `cap_rows`, a condition such as the training period,
    limits them to rows the model may know. The cleaned history is written once, because the medians, the
    split guard, the encoder and both folds read it; all but the folds need only the building of a row.
    """
    history = durable(clean_history(readings, series, meta, **cleaning))
    filled = durable(features.add_weather_features(clean.impute_weather(weather, weather_series)))
    # what depends on the building alone is worked out on the building table
    per_building = history.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"))
    ages = per_building.join(meta.select("building_id", "site_id", "building_age"), "building_id")
    buildings = durable(features.add_building_features(meta, meta, ages))

    folds = split(history)
    uses = join_meta(folds[0], meta.select("building_id", "primary_use")).withColumn("hour", F.hour(series.time))
    encoder = TargetEncoder(["primary_use", "hour"], "meter_reading", smoothing)
    encoder.fit(uses.na.drop(subset=["meter_reading", "primary_use"]))

    names: list[str] = []
    done = []
    years = features.years_of(history, series.time)
    for fold in folds:
        wide = features.add_time_features(join_context(fold, buildings, filled), series.time, years)
        wide = encoder.transform(features.add_interaction_features(wide))
        names = features.feature_set(wide, feature_set)
        # calendar features are null only where the time is
        fillable = [c for c in names if c not in features.FEATURE_GROUPS["time"]]
        whole = wide.na.drop(subset=[*fillable, series.time, "meter_reading"])
        keep = dict.fromkeys([*series.keys, *series.order, "site_id", "primary_use", "hour", "meter_reading", *names])
        label = to_log("meter_reading") if log_target else F.col("meter_reading")
        done.append(whole.select(*[c for c in keep if c in whole.columns]).withColumn("label", label))
    return Prepared(done[0], done[1], names, encoder, series, log_target)
