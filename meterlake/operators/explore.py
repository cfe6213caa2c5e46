"""Tables that describe the data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from meterlake.functions.scalars import to_log
from meterlake.operators.quantiles import group_quantiles
from meterlake.session import durable


def _rows() -> Column:
    return F.count(F.lit(1)).alias("rows")


def site_summary(df: DataFrame, value: str = "meter_reading") -> DataFrame:
    """Rows, buildings, meter types and mean reading per site."""
    return df.groupBy("site_id").agg(
        _rows(),
        F.count_distinct("building_id").alias("buildings"),
        F.count_distinct("meter").alias("meters"),
        F.avg(value).alias("mean_reading"),
    )


def category_breakdown(df: DataFrame, category: str, value: str = "meter_reading", distinct: str | None = None) -> DataFrame:
    """Rows and mean per category, optionally with the number of distinct values of another column."""
    more = [F.count_distinct(distinct).alias(f"distinct_{distinct}")] if distinct else []
    return df.groupBy(category).agg(_rows(), F.avg(value).alias("mean"), *more)


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, largest first."""
    columns = list(columns or df.columns)
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return shares.unpivot([], columns, "column", "missing").orderBy(F.desc("missing"), "column")


def missingness_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def calendar_means(df: DataFrame, time: str = "timestamp", value: str = "meter_reading") -> DataFrame:
    """Mean by weekday and by month, from one pass."""
    rows = df.select(F.weekday(time).alias("weekday"), F.month(time).alias("month"), F.col(value).alias("_y"))
    means = rows.groupingSets([["weekday"], ["month"]], "weekday", "month").agg(
        F.grouping("weekday").alias("_g"), F.avg("_y").alias("mean")
    )
    part = F.when(F.col("_g") == 0, F.lit("weekday")).otherwise(F.lit("month"))
    return means.select(part.alias("part"), F.coalesce("weekday", "month").alias("value"), "mean")


def holiday_weekend_means(df: DataFrame, value: str = "meter_reading") -> DataFrame:
    """Mean by weekend and holiday flag, with the label of the combination."""
    day = F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday")
    kind = F.when(F.col("is_holiday") == 1, "holiday").otherwise("non-holiday")
    means = df.groupBy("is_weekend", "is_holiday").agg(F.avg(value).alias("mean"))
    return means.withColumn("bucket", F.concat_ws(" ", day, kind))


def mean_pivot(df: DataFrame, row: str, column: str, names: Sequence, value: str = "meter_reading", fill: float | None = None) -> DataFrame:
    """Means with one row per value of `row` and one column per name of `column`."""
    out = df.groupBy(row).pivot(column, list(names)).agg(F.avg(value))
    return out if fill is None else out.na.fill(fill)


def hourly_profile(df: DataFrame, group: str, names: Sequence, time: str = "timestamp", value: str = "meter_reading") -> DataFrame:
    """Mean by hour of the day, one column per value of `group`."""
    return mean_pivot(df.withColumn("hour", F.hour(time)), "hour", group, names, value)


def top_categories(df: DataFrame, category: str, k: int) -> DataFrame:
    """The k most frequent values, ties by name."""
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(_rows())
    return counts.orderBy(F.desc("rows"), category).limit(k)


def weekly_profile(df: DataFrame, category: str, k: int = 4, time: str = "timestamp", value: str = "meter_reading") -> DataFrame:
    """Mean by hour of the week for the k most frequent categories."""
    top = df.join(F.broadcast(top_categories(df, category, k)), category, "left_semi")  # k rows
    bucket = (F.weekday(time) * 24 + F.hour(time)).alias("bucket")
    return top.groupBy(category, bucket).agg(F.avg(value).alias("mean"))


def top_hourly_profile(df: DataFrame, category: str, k: int = 5, time: str = "timestamp", value: str = "meter_reading") -> DataFrame:
    """Mean by hour of the day for the k most frequent categories."""
    top = df.join(F.broadcast(top_categories(df, category, k)), category, "left_semi")  # k rows
    return top.groupBy(category, F.hour(time).alias("hour")).agg(F.avg(value).alias("mean"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns in one pass, over the rows where both are known."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))

    def known(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double")))

    wide = df.agg(*[known(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    entries += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    entries += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in columns]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def histogram(
    df: DataFrame, value, bins: int = 80, low: float | None = None, high: float | None = None, outside: bool = False
) -> DataFrame:
    """Counts in equal bins between the bounds (by default the smallest and largest value); the last bin
    includes its upper bound. Values outside are left out, or with `outside` counted in bins -1 and `bins`.
    """
    rows = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if low is None or high is None:
        ends = rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
        low = ends["lo"] if low is None else low
        high = ends["hi"] if high is None else high
        if low is None:
            return rows.select(F.lit(0).alias("bin"), F.col("_x").alias("low"), F.lit(0).cast("long").alias("n")).limit(0)
    if high <= low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("_x") - low) / width), F.lit(bins - 1)).cast("int")
    if outside:
        place = F.when(F.col("_x") < low, -1).when(F.col("_x") > high, bins).otherwise(place)
    else:
        rows = rows.where(F.col("_x").between(low, high))
    counted = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), "n")


def target_histogram(df: DataFrame, value: str = "meter_reading", bins: int = 80) -> DataFrame:
    return histogram(df, value, bins)


def log_target_histogram(df: DataFrame, value: str = "meter_reading", bins: int = 80) -> DataFrame:
    return histogram(df.where(F.col(value) > 0), to_log(value), bins)


def log_spaced_histogram(df: DataFrame, value: str, decades: int = 4, bins: int = 49) -> DataFrame:
    """Counts in bins of equal width on the log10 scale from 1 to 10 ** decades; one bin on each side for the rest."""
    return histogram(df.where(F.col(value) > 0), F.log10(value), bins, 0.0, float(decades), outside=True)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles per group and the whiskers: the outermost values within 1.5 interquartile ranges."""
    quartiles = durable(
        group_quantiles(df, [group], value, [0.25, 0.5, 0.75]).select(
            F.col(group).alias("_g"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    joined = df.join(quartiles, df[group].eqNullSafe(quartiles["_g"]))
    return joined.groupBy(group, "q1", "median", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))


def density_by(df: DataFrame, group: str, value: str, cells: int = 256, points: int = 64) -> DataFrame:
    """Gaussian density estimate per group on an even grid over all values, bandwidth by Scott's rule.

    Values are first counted in `cells` fine cells per group, so the kernel sum meets cells, not rows.
    """
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    if ends["lo"] is None:
        empty = F.lit(None).cast("double")
        return df.where(F.lit(False)).select(group, F.lit(0).alias("point"), empty.alias("x"), empty.alias("density"))
    low, high = ends["lo"], ends["hi"]
    width = (high - low) / cells or 1.0
    cell = F.least(F.floor((F.col(value) - low) / width), F.lit(cells - 1))
    counted = df.where(F.col(value).isNotNull()).groupBy(group, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    # the variance of the rows themselves: differences of large sums would lose its digits
    totals = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.var_samp(value).alias("var"))
    spread = F.sqrt("var")
    widths = totals.where(F.col("n") > 1).select(F.col(group).alias("_g"), "n", (spread * F.pow("n", F.lit(-0.2))).alias("bw"))
    step = (high - low) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    at = F.lit(low) + F.col("point") * F.lit(step)
    centre = F.lit(low) + (F.col("cell") + 0.5) * F.lit(width)
    kernel = F.exp(-0.5 * F.pow((at - centre) / F.col("bw"), 2)) / (F.col("bw") * math.sqrt(2 * math.pi))
    sums = (
        counted.join(widths, counted[group].eqNullSafe(widths["_g"]))
        .where(F.col("bw") > 0)
        .select(group, "cell", "c", "n", "bw", grid)
        .groupBy(group, "point")
        .agg(F.sum(kernel * F.col("c") / F.col("n")).alias("density"))
    )
    return sums.select(group, "point", at.alias("x"), "density")


def temperature_response(df: DataFrame, value: str = "meter_reading", temperature: str = "air_temperature", group: str = "meter") -> DataFrame:
    """Mean log reading and rows per meter type and whole degree."""
    known = df.na.drop(subset=[temperature, value, group])
    return known.groupBy(group, F.floor(temperature).cast("int").alias("degree")).agg(
        F.avg(to_log(value)).alias("mean_log"), F.count(F.lit(1)).alias("n")
    )


def distinct_series(df: DataFrame, keys: Sequence[str] = ("building_id", "meter")) -> DataFrame:
    """Number of distinct values of each key and of their combinations."""
    combos = df.select(*keys).na.drop().distinct()
    return combos.agg(*[F.count_distinct(k).alias(f"n_{k}") for k in keys], F.count(F.lit(1)).alias("n_series"))


def top_outliers(df: DataFrame, meta: DataFrame, k: int = 15, value: str = "meter_reading") -> DataFrame:
    """The k buildings with the largest reading, with their use and size."""
    peaks = df.groupBy("building_id").agg(F.max(value).alias(value)).orderBy(F.desc(value), "building_id").limit(k)
    return meta.select("building_id", "primary_use", "square_feet").join(F.broadcast(peaks), "building_id")  # k rows


def top_series(df: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k series with the most rows."""
    return df.groupBy(*keys).agg(_rows()).orderBy(F.desc("rows"), *keys).limit(k)


def first_by_group(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Value of the row that comes first in each group."""
    return df.groupBy(group).agg(F.min_by(column, order).alias(column))


def first_known(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """First non-null value of each column per series."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The last k rows of each series. Spark keeps k rows per series and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= k)
