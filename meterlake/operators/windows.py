"""Lookback windows from blocks: every row is written once, windows are cut when they are read.

A series is written in blocks of a bounded number of rows. A block also has the last `lookback` rows of the block before, so
that each window lies in one block, and costs lookback / block_rows more than the rows themselves, where a table of windows
holds each row `lookback` times. A window is known by its block and its place there; readers get all windows of a block as
views of one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meterlake.operators.series import Series, with_position
from meterlake.session import durable

Windows = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


@dataclass(frozen=True)
class Blocks:
    """`table` has one row per block: the keys, `block`, `lead` (rows repeated in front), `first` (position in the series, from
    1, of the first row that is not repeated), `at` (the order columns of its rows), `y` and, row by row, the features `x`."""

    table: DataFrame
    series: Series
    features: tuple[str, ...]
    lookback: int


def write_blocks(
    df: DataFrame, series: Series, features: Sequence[str], target: str = "meter_reading", lookback: int = 168, block_rows: int = 4_096
) -> Blocks:
    """The rows of `df` in blocks; null features and targets are NaN to the reader."""
    if not 1 <= lookback <= block_rows:
        raise ValueError("a block has at least as many rows as a window, and a window has one")
    columns = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)]
    rows = with_position(df, series, "_at").select(*series.keys, "_at", F.struct(*series.order).alias("_o"), F.col(target).cast("double").alias("_y"), *columns)
    place = (F.col("_at") - 1) % block_rows
    shifts = F.when(place >= block_rows - lookback, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_shift", F.explode(shifts)).withColumn("block", F.expr(f"(_at - 1) DIV {block_rows}") + F.col("_shift"))
    xs = [f"_x{k}" for k in range(len(features))]
    held = F.sort_array(F.collect_list(F.struct("_at", "_shift", "_o", "_y", *xs)))  # at most block_rows + lookback
    found = rows.groupBy(*series.keys, "block").agg(held.alias("_r")).where(F.exists("_r", lambda r: r["_shift"] == 0))
    made = found.select(
        *series.keys,
        "block",
        F.size(F.filter("_r", lambda r: r["_shift"] == 1)).alias("lead"),
        (F.col("block") * block_rows + 1).alias("first"),
        F.transform("_r", lambda r: r["_o"]).alias("at"),
        F.transform("_r", lambda r: r["_y"]).alias("y"),
        F.flatten(F.transform("_r", lambda r: F.array(*[r[x] for x in xs]))).alias("x"),
    )
    return Blocks(durable(made), series, tuple(features), lookback)


def _rows_until(blocks: Blocks, time, name: str) -> DataFrame:
    """How many rows of each series are not later than `time`."""
    own = F.slice("at", F.col("lead") + 1, F.size("at"))
    n = F.size(F.filter(own, lambda o: o[blocks.series.time] <= F.lit(time)))
    return blocks.table.groupBy(*blocks.series.keys).agg(F.sum(n).alias(name))


def over_windows(blocks: Blocks, fn: Windows, fields: str, stride: int = 1, until=None, after=None) -> DataFrame:
    """`fn` of all windows, block by block: it gets (windows, lookback, features) and the targets, as views, and returns the
    columns named in `fields`, one value per window. Rows come with the keys and order columns of their target.

    `until`, `after` and `stride` choose targets as in `lookback_windows`.
    """
    series, lookback, width = blocks.series, blocks.lookback, len(blocks.features)
    table = blocks.table
    for name, time in (("_passed", after), ("_upto", until)):
        if time is None:
            table = table.withColumn(name, F.lit(None).cast("long"))
        else:
            table = table.join(durable(_rows_until(blocks, time, name)), list(series.keys))
    made = to_arrow_schema(StructType.fromDDL(fields))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from one(batch.slice(k, 1))

    def one(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, y, x = (block.column(c)[0].values for c in ("at", "y", "x"))
        lead, first, passed, upto = (block.column(c)[0].as_py() for c in ("lead", "first", "_passed", "_upto"))
        start = first - lead  # position of row 0
        least = max(lookback + 1, 1 if passed is None else passed + 1, first)
        base = lookback if passed is None else passed
        least += -(least - 1 - base) % stride
        end = start + len(y) if upto is None else min(start + len(y), upto + 1)
        if least >= end:
            return
        places = np.arange(least - start, end - start, stride)
        rows = x.to_numpy(zero_copy_only=False).reshape(-1, width)
        views = np.lib.stride_tricks.sliding_window_view(rows, lookback, axis=0).transpose(0, 2, 1)
        told = fn(views[places[0] - lookback : places[-1] - lookback + 1 : stride], y.to_numpy(zero_copy_only=False)[places])
        chosen = at.take(pa.array(places))
        keys = [block.column(c).take(pa.array(np.zeros(len(places), np.int64))) for c in series.keys]
        order = [chosen.field(c) for c in series.order]
        columns = [pa.array(told[f.name], f.type) for f in made]
        yield pa.RecordBatch.from_arrays([*keys, *order, *columns], names=[*series.keys, *series.order, *made.names])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.table.schema["at"].dataType.elementType}
    kinds |= {f.name: f.dataType.simpleString() for f in blocks.table.schema if f.name in series.keys}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in (*series.keys, *series.order))
    return table.select(*series.keys, "lead", "first", "at", "y", "x", "_passed", "_upto").mapInArrow(cut, f"{named}, {fields}")
