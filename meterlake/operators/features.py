"""Features of a meter reading: calendar, history, building, weather and their products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from meterlake.functions.holidays import DEFAULT_COUNTRY, SITE_COUNTRY, calendar
from meterlake.functions.scalars import col, wave
from meterlake.operators.series import Series, by_length, reaching_back
from meterlake.session import durable

# The feature names by group, and the small raw set of the ablation.
FEATURE_GROUPS = {
    "time": [
        "hour_sin", "hour_cos", "dayofweek_sin", "dayofweek_cos",
        "month_sin", "month_cos", "is_weekend", "is_holiday",
    ],
    "lag": ["lag_24h", "lag_168h", "lag_diff_24h"],
    "rolling": ["rolling_mean_24h", "rolling_std_24h", "rolling_mean_168h", "rolling_std_168h"],
    "weather": [
        "air_temperature", "dew_temperature", "temp_squared",
        "wind_speed", "cloud_coverage", "precip_depth_1_hr",
    ],
    "building": ["log_square_feet", "building_age", "primary_use_code"],
    "interaction": ["hour_x_weekend", "sqft_x_temp"],
    "target_encoding": ["te_primary_use_x_hour"],
}
FEATURE_COLUMNS = [name for names in FEATURE_GROUPS.values() for name in names]
RAW_FEATURE_COLUMNS = ["hour", "air_temperature", "log_square_feet", "primary_use_code", "meter"]


def feature_groups() -> dict[str, list[str]]:
    return {group: list(names) for group, names in FEATURE_GROUPS.items()}


def feature_set(df: DataFrame, name: str) -> list[str]:
    """The columns of a named feature set that `df` has."""
    sets = {"engineered": FEATURE_COLUMNS, "raw": RAW_FEATURE_COLUMNS}
    if name not in sets:
        raise ValueError(f"unknown feature set {name!r}, expected one of {sorted(sets)}")
    return [c for c in sets[name] if c in df.columns]


def drop_prefixed(df: DataFrame, prefix: str = "te_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def lookup(key: str | Column, entries: dict, default=None) -> Column:
    """Value of a small literal dictionary, else `default`."""
    pairs = F.create_map(*[F.lit(x) for item in entries.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, col(key)), F.lit(default))


def years_of(df: DataFrame, time: str = "timestamp") -> tuple[int, int]:
    """The first and the last year of the rows."""
    ends = df.agg(F.min(F.year(time)), F.max(F.year(time))).first()
    return ends[0] or 1970, ends[1] or 1970


def with_holiday_flag(df: DataFrame, time: str = "timestamp", years: tuple[int, int] | None = None) -> DataFrame:
    """`is_holiday`: 1 on a public holiday of the site's country (US where no site is known).

    `years`, the first and the last year of the rows, are looked up in the rows where they are not given.
    """
    country = lookup(F.col("site_id").cast("int"), SITE_COUNTRY, DEFAULT_COUNTRY) if "site_id" in df.columns else F.lit(DEFAULT_COUNTRY)
    days = F.broadcast(calendar(df.sparkSession, *(years or years_of(df, time))))  # about fifty rows a year
    match = (country == days["holiday_country"]) & (F.to_date(df[time]) == days["holiday_day"])
    return df.join(days, match, "left").select(
        *[df[c] for c in df.columns], F.col("holiday_day").isNotNull().cast("int").alias("is_holiday")
    )


def add_time_features(df: DataFrame, time: str = "timestamp", years: tuple[int, int] | None = None) -> DataFrame:
    """Hour, weekday (Monday = 0), month, weekend and holiday flags, and the cyclical pairs."""
    out = df.withColumns({"hour": F.hour(time), "dayofweek": F.weekday(time), "month": F.month(time)})
    out = out.withColumn("is_weekend", (F.col("dayofweek") >= 5).cast("int"))
    out = with_holiday_flag(out, time, years)
    return out.withColumns(
        {
            f"{c}_{shape}": wave(c, period, shape)
            for c, period in (("hour", 24), ("dayofweek", 7), ("month", 12))
            for shape in ("sin", "cos")
        }
    )


def _merged(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two disjoint sets together."""
    (n_a, m_a, q_a), (n_b, m_b, q_b) = a, b
    n = n_a + n_b
    share = F.when(n > 0, n_b / n).otherwise(F.lit(0.0))
    gap = m_b - m_a
    return n, m_a + gap * share, q_a + q_b + gap * gap * n_a * share


def _moments(name: str) -> tuple[Column, Column, Column]:
    return F.col(f"_n{name}"), F.col(f"_m{name}"), F.col(f"_q{name}")


def _lagged(w: WindowSpec, block: int, back: int, name: str) -> dict[str, Column]:
    """The moments of the `block` rows that end `back` rows before, as columns named `name`; none are zero."""
    return {f"_{c}{name}": F.lead(f"_{c}{block}", back, 0.0).over(w) for c in "nmq"}


def _blocks(k: int) -> list[tuple[int, int]]:
    """The powers of two that make up k, largest first, each with the rows between it and the current row."""
    parts, back = [], 1
    for bit in reversed(range(k.bit_length())):
        if k >> bit & 1:
            parts.append((1 << bit, back))
            back += 1 << bit
    return parts


def rolling_moments(rows: DataFrame, w: WindowSpec, value: str, windows: Sequence[int]) -> DataFrame:
    """`_n<k>r`, `_m<k>r`, `_q<k>r`: count, mean and squared deviations of the k rows before each row.

    `w` runs from the newest row to the oldest. Spark evaluates a sliding frame row by row, k steps each. Here
    blocks of 1, 2, 4, ... rows are merged on the one sort order of the series, so a frame of k rows takes about
    log2(k) steps. Merging moments adds no cancellation.
    """
    known = F.col(value).isNotNull()
    out = rows.withColumns(
        {"_n1": known.cast("double"), "_m1": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_q1": F.lit(0.0)}
    )
    block = 1
    while 2 * block <= max(windows):
        out = out.withColumns(_lagged(w, block, block, "e"))
        merged = _merged(_moments("e"), _moments(str(block)))
        block *= 2
        out = out.withColumns(dict(zip((f"_n{block}", f"_m{block}", f"_q{block}"), merged)))
    ends, totals = {}, {}
    for k in windows:
        parts = [f"{k}p{back}" for _, back in _blocks(k)]
        for (size, back), part in zip(_blocks(k), parts):
            ends |= _lagged(w, size, back, part)
        total = _moments(parts[-1])
        for part in reversed(parts[:-1]):
            total = _merged(total, _moments(part))
        totals |= dict(zip((f"_n{k}r", f"_m{k}r", f"_q{k}r"), total))
    return out.withColumns(ends).withColumns(totals)


@by_length
def add_history_features(
    df: DataFrame,
    series: Series,
    value: str = "meter_reading",
    lags: Sequence[int] = (24, 168),
    windows: Sequence[int] = (24, 168),
) -> DataFrame:
    """Lags and rolling mean and sample deviation of earlier rows, all on one window specification.

    Both count rows, not hours. A rolling frame ends one row before the current one and is null until a
    quarter of it holds values.
    """
    rows, _, finish = reaching_back(df, series, max([*lags, *windows]))
    # newest first, the order in which the search for zero runs leaves a series, so a chain sorts once less
    w = series.backwards()
    out = rows.withColumns({f"lag_{k}h": F.lead(value, k).over(w) for k in lags}) if lags else rows
    if {24, 168} <= set(lags):
        out = out.withColumn("lag_diff_24h", F.col("lag_24h") - F.col("lag_168h"))
    if windows:
        out = rolling_moments(out, w, value, windows)
    for k in windows:
        n, mean, squares = _moments(f"{k}r")
        enough = n >= max(1, k // 4)
        out = out.withColumns(
            {
                f"rolling_mean_{k}h": F.when(enough, mean),
                f"rolling_std_{k}h": F.when(enough & (n > 1), F.sqrt(squares / (n - 1))),
            }
        )
    made = [f"lag_{k}h" for k in lags] + [c for c in out.columns if c == "lag_diff_24h"]
    made += [f"rolling_{s}_{k}h" for k in windows for s in ("mean", "std")]
    return finish(out).select(*df.columns, *made)


def add_lag_features(df: DataFrame, series: Series, value: str = "meter_reading", lags: Sequence[int] = (24, 168)) -> DataFrame:
    return add_history_features(df, series, value, lags, ())


def add_rolling_features(df: DataFrame, series: Series, value: str = "meter_reading", windows: Sequence[int] = (24, 168)) -> DataFrame:
    return add_history_features(df, series, value, (), windows)


def category_codes(dimension: DataFrame, column: str) -> Column:
    """Alphabetical 0-based code of a category, -1 for a missing one.

    The sorted category list is one scalar value: a code is a small integer, so categories are few.
    """
    names = dimension.agg(F.array_sort(F.collect_set(column)).alias("names"))
    place = F.array_position(names.scalar(), F.col(column)).cast("int")
    return F.coalesce(place, F.lit(0)) - 1


def age_counts(df: DataFrame, column: str = "building_age", site: str = "site_id") -> DataFrame:
    """Rows per site and known age."""
    by = [site] if site in df.columns else []
    return df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def fill_age(df: DataFrame, column: str = "building_age", site: str = "site_id", counts: DataFrame | None = None) -> DataFrame:
    """Missing age: the median over the rows of the site, else over all rows.

    Ages are whole years, so the medians come from `counts`, the rows per site and age, and not from the rows.
    With counts of the readings this can run on the building table, which spares a join of the readings by site.
    """
    counts = age_counts(df, column, site) if counts is None else counts
    median = F.percentile(column, F.lit(0.5), F.col("n"))
    if site not in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), counts.agg(median).scalar()))
    # one row per site and one for all of them
    medians = counts.groupingSets([[site], []], site).agg(F.grouping(site).alias("_all"), median.alias("_median"))
    medians = durable(medians)
    overall = medians.where(F.col("_all") == 1).select("_median").scalar()
    by_site = medians.where(F.col("_all") == 0).select(F.col(site).alias("_site"), "_median")
    joined = df.join(by_site, df[site] == by_site["_site"], "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("_median"), overall)).select(*df.columns)


def add_building_features(df: DataFrame, categories: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The category code (over `categories`, by default over `df`) and the filled building age."""
    out = df
    if "primary_use" in df.columns:
        out = out.withColumn("primary_use_code", category_codes(df if categories is None else categories, "primary_use"))
    return fill_age(out, counts=counts) if "building_age" in df.columns else out


def add_weather_features(df: DataFrame) -> DataFrame:
    if "air_temperature" not in df.columns:
        return df
    return df.withColumn("temp_squared", F.col("air_temperature") * F.col("air_temperature"))


def add_interaction_features(df: DataFrame) -> DataFrame:
    have, made = set(df.columns), {}
    if {"hour", "is_weekend"} <= have:
        made["hour_x_weekend"] = F.col("hour") * F.col("is_weekend")
    if {"log_square_feet", "air_temperature"} <= have:
        made["sqft_x_temp"] = F.col("log_square_feet") * F.coalesce(F.col("air_temperature"), F.lit(0.0))
    return df.withColumns(made) if made else df
