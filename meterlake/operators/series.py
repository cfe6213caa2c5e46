"""Ordered rows per series key, windowed whole or in chunks of bounded size.

A window over a whole series runs in one task. That is right for a meter with one reading an hour and
wrong for a series that holds a third of the table, so every operator here first counts rows per series:
ordinary series take the plain window, longer ones are cut into chunks. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterlake.session import durable

POS, CHUNK, SIZE = "_pos", "_chunk", "_size"
TASK_ROWS = 125_000  # rows of ordinary series that one task windows, about; a sorted row takes 1 to 2 KB there


@dataclass(frozen=True)
class Series:
    """What names a series and what orders its rows; `ties` make the order total.

    `split` says how to window: False whole, True in chunks, None by the length of each series. The lengths are
    counted by every operator anew unless `measured` has counted them once for a chain of operators.
    """

    keys: tuple[str, ...] = ("building_id", "meter")
    time: str = "timestamp"
    ties: tuple[str, ...] = ()
    long_rows: int = 2_000_000
    chunk_rows: int = 250_000
    split: bool | None = None
    counted: bool = False
    longs: DataFrame | None = field(default=None, compare=False, repr=False)
    parts: int = 0  # tasks to spread the long series over
    tasks: int = 0  # tasks to spread the ordinary series over

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    def measured(self, df: DataFrame) -> Series:
        """Count the series of `df` once. Holds for every frame made from `df` by dropping or filling rows."""
        if self.split is not None or self.counted:
            return self
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_rows"))
        total, longest = counts.agg(F.sum("_rows"), F.max("_rows")).first()  # two numbers
        tasks = -(-(total or 0) // TASK_ROWS)
        if (longest or 0) <= self.long_rows:
            return replace(self, counted=True, tasks=tasks)
        longs = long_series(df, self)
        rows = longs.agg(F.sum("_rows")).first()[0]  # one number
        return replace(self, counted=True, longs=longs.select(*self.keys), parts=-(-rows // self.chunk_rows), tasks=tasks)

    def window(self) -> WindowSpec:
        if self.split:
            return Window.partitionBy(*self.keys, CHUNK).orderBy(POS)
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def backwards(self) -> WindowSpec:
        if self.split:
            return Window.partitionBy(*self.keys, CHUNK).orderBy(F.desc(POS))
        return Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])


def same_keys(left: DataFrame, right: DataFrame, keys) -> Column:
    """Equality on all keys in which two nulls match."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def long_series(df: DataFrame, series: Series) -> DataFrame:
    """Keys and rows of the series above `long_rows`.

    At most (rows / long_rows) keys can be long. The list is written, so that Spark knows whether to broadcast it.
    """
    counts = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_rows"))
    return durable(counts.where(F.col("_rows") > series.long_rows))


def spread(df: DataFrame, series: Series) -> DataFrame:
    """Rows by series in as many tasks as their number asks for, so that the memory of a task does not grow with the table.
    All windows by series keep to this shuffle. Few rows are left to Spark."""
    if series.tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(series.tasks, *series.keys)


def by_length(step: Callable) -> Callable:
    """Run a series operator plainly on ordinary series and in chunks on long ones."""

    @wraps(step)
    def run(df: DataFrame, series: Series, *args, **kwargs) -> DataFrame:
        if series.split is not None:
            return step(df, series, *args, **kwargs)
        series = series.measured(df)
        plain, chunked = replace(series, split=False), replace(series, split=True)
        if series.longs is None:
            return step(spread(df, series), plain, *args, **kwargs)
        longs = series.longs
        match = same_keys(df, longs, series.keys)
        ordinary = step(spread(df.join(longs, match, "left_anti"), series), plain, *args, **kwargs)
        return ordinary.unionByName(step(df.join(longs, match, "left_semi"), chunked, *args, **kwargs))

    return run


def _numbered(df: DataFrame, series: Series, chunk_rows: int) -> DataFrame:
    """Add the 1-based position in the series, the series size and the chunk, without a whole-series window.

    A range partitioning on key and order spreads one series over many tasks; the written row ids hold the
    partition and the place in it, and one row per (series, partition) gives the offset to add.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), series.parts)
    by = [*series.keys, *series.order]
    rows = durable(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", 33))
    cells = rows.groupBy(*series.keys, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*series.keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(series.keys)],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(SIZE),
    )
    # Rows come range-partitioned, so there are at most (series + partitions) cells; written, so that Spark knows.
    cells = durable(cells)
    match = reduce(
        Column.__and__,
        [rows[k].eqNullSafe(cells[f"_k{i}"]) for i, k in enumerate(series.keys)],
        rows["_part"] == cells["_p"],
    )
    return (
        rows.join(cells, match)
        .withColumn(POS, F.col("_id") - F.col("_first") + F.col("_before") + 1)
        .withColumn(CHUNK, F.floor((F.col(POS) - 1) / chunk_rows))
        .select(*df.columns, POS, SIZE, CHUNK)
    )


def positioned(df: DataFrame, series: Series) -> DataFrame:
    """Rows with their 1-based position (`_pos`); a chunked series also gets `_size` and `_chunk`."""
    if series.split:
        return _numbered(df, series, series.chunk_rows)
    return df.withColumn(POS, F.row_number().over(series.window()).cast("long"))


@by_length
def with_position(df: DataFrame, series: Series, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its series."""
    return positioned(df, series).withColumnRenamed(POS, name).select(*df.columns, name)


def reaching_back(df: DataFrame, series: Series, reach: int) -> tuple[DataFrame, WindowSpec, Callable]:
    """Rows, a window and a finishing step for frames that look at most `reach` rows back.

    In chunks, the last `reach` rows of each chunk are repeated before the next one and dropped at the end,
    so no window partition holds more than chunk_rows + reach rows.
    """
    if not series.split:
        w = series.window()
        return df.withColumn(POS, F.row_number().over(w).cast("long")), w, lambda out: out.drop(POS)
    size = max(series.chunk_rows, reach)
    rows = _numbered(df, series, size).drop(SIZE)
    late = (F.col(POS) - 1) % size >= size - reach
    rows = rows.withColumn(
        "_shift", F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn(CHUNK, F.col(CHUNK) + F.col("_shift"))
    return rows, series.window(), lambda out: out.where(F.col("_shift") == 0).drop(POS, CHUNK, "_shift")


def nearest_marks(df: DataFrame, series: Series, marks: dict[str, Column]) -> DataFrame:
    """For every mark the nearest non-null value at or before (`<name>_before`) and at or after
    (`<name>_after`) each row. A mark may use `_pos`; `_pos` and `_size` stay in the result.
    """
    rows = positioned(df, series)
    rows = rows.withColumns({f"_m_{n}": m for n, m in marks.items()})
    ahead = series.window().rowsBetween(Window.unboundedPreceding, 0)
    behind = series.backwards().rowsBetween(Window.unboundedPreceding, 0)
    # counted from the end in the window that looks back from there
    found = {} if series.split else {SIZE: F.col(POS) + F.row_number().over(series.backwards()) - 1}
    for n in marks:
        found[f"{n}_before"] = F.last(f"_m_{n}", ignorenulls=True).over(ahead)
        found[f"{n}_after"] = F.last(f"_m_{n}", ignorenulls=True).over(behind)
    out = rows.withColumns(found)
    if series.split:
        out = _carry_between_chunks(rows, out, series, list(marks))
    return out.drop(*[f"_m_{n}" for n in marks], CHUNK)


def _carry_between_chunks(rows: DataFrame, out: DataFrame, series: Series, names: list[str]) -> DataFrame:
    """Fill what a chunk cannot see itself from one summary row per chunk."""
    by = [*series.keys, CHUNK]
    ends = []
    for n in names:
        at = F.when(F.col(f"_m_{n}").isNotNull(), F.col(POS))
        ends += [F.max_by(f"_m_{n}", at).alias(f"_l_{n}"), F.min_by(f"_m_{n}", at).alias(f"_f_{n}")]
    summary = rows.groupBy(*by).agg(*ends)
    earlier = Window.partitionBy(*series.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*series.keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *[F.col(c).alias(f"_j{i}") for i, c in enumerate(by)],
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_cb_{n}") for n in names],
        *[F.last(f"_f_{n}", ignorenulls=True).over(later).alias(f"_ca_{n}") for n in names],
    )
    match = reduce(Column.__and__, [out[c].eqNullSafe(carried[f"_j{i}"]) for i, c in enumerate(by)])
    joined = out.join(carried, match, "left")
    for n in names:
        joined = joined.withColumn(f"{n}_before", F.coalesce(f"{n}_before", f"_cb_{n}")).withColumn(
            f"{n}_after", F.coalesce(f"{n}_after", f"_ca_{n}")
        )
    return joined.select(*out.columns)
