"""Folds by time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import seconds
from meterlake.operators.quantiles import global_quantiles


def assert_no_leakage(train: DataFrame, val: DataFrame, time: str = "timestamp") -> None:
    """Raise where a fold is empty or training reaches into validation."""
    ends = train.agg(F.max(time).alias("t")).unionAll(val.agg(F.min(time).alias("t")))
    last_train, first_val = (row["t"] for row in ends.collect())  # two rows
    if last_train is None or first_val is None:
        raise ValueError("the time split left a fold empty; check the months or the cutoff")
    if last_train >= first_val:
        raise AssertionError(f"temporal leakage: training ends at {last_train}, validation starts at {first_val}")


def time_split(
    df: DataFrame, train_months: Iterable[int], val_months: Iterable[int], time: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by calendar month; training must end before validation starts."""
    train_set, val_set = {int(m) for m in train_months}, {int(m) for m in val_months}
    if train_set & val_set:
        raise ValueError(f"months {sorted(train_set & val_set)} are in both folds")
    month = F.month(time)
    train, val = df.where(month.isin(*train_set)), df.where(month.isin(*val_set))
    assert_no_leakage(train, val, time)
    return train, val


def split_at(df: DataFrame, cutoff: str, time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff and rows from it on; a plain range that reaches the file scan."""
    return df.where(F.col(time) < cutoff), df.where(F.col(time) >= cutoff)


def split_summary(train: DataFrame, val: DataFrame, time: str = "timestamp", building: str = "building_id") -> DataFrame:
    """Rows, first and last time and number of buildings of each fold."""
    columns = [time] + ([building] if building in train.columns else [])
    folds = (
        train.select(F.lit("train").alias("fold"), *columns).unionByName(val.select(F.lit("val").alias("fold"), *columns))
    )
    buildings = F.count_distinct(building) if len(columns) == 2 else F.lit(None).cast("long")
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first"),
        F.max(time).alias("last"),
        buildings.alias("buildings"),
    )


def _time_cuts(df: DataFrame, shares: Sequence[float], time: str) -> list[float]:
    stamped = df.select(seconds(time).alias("_s"))
    return global_quantiles(stamped, "_s", list(shares)).first()["q"]  # one number per share


def expanding_folds(df: DataFrame, n_splits: int = 3, time: str = "timestamp") -> list[tuple[DataFrame, DataFrame]]:
    """n_splits pairs: train on all blocks up to i, test on block i + 1; blocks hold equal shares of rows by time."""
    cuts = _time_cuts(df, [i / (n_splits + 1) for i in range(1, n_splits + 1)], time)
    at = seconds(time)
    ends = [*cuts[1:], None]
    return [
        (df.where(at < start), df.where(at >= start) if end is None else df.where((at >= start) & (at < end)))
        for start, end in zip(cuts, ends)
    ]


def with_fold_block(df: DataFrame, n_splits: int = 3, time: str = "timestamp") -> DataFrame:
    """`block`, 0 .. n_splits: fold i trains on blocks below i and tests on block i."""
    cuts = _time_cuts(df, [i / (n_splits + 1) for i in range(1, n_splits + 1)], time)
    block = sum(((seconds(time) >= cut).cast("int") for cut in cuts), F.lit(0))
    return df.withColumn("block", block)


def chrono_prefix(df: DataFrame, share: float, time: str = "timestamp", at_least: int = 1) -> DataFrame:
    """The earliest share of the rows, at least `at_least`; rows of the last time taken stay together."""
    rows = df.count()
    wanted = min(rows, max(at_least, int(rows * share)))
    if wanted == rows:
        return df
    # halfway between the last row taken and the next one
    cut = _time_cuts(df, [(wanted - 0.5) / (rows - 1)], time)[0]
    return df.where(seconds(time) <= cut)


def chrono_cuts(df: DataFrame, shares: Sequence[float], time: str = "timestamp", at_least: int = 1) -> list[tuple[float | None, int]]:
    """Of the `chrono_prefix` of every share its last second (None: it is the whole table) and its rows, from the same passes."""
    rows = df.count()
    wanted = [min(rows, max(at_least, int(rows * share))) for share in shares]
    partial = sorted({w for w in wanted if w < rows})
    if not partial:
        return [(None, rows) for _ in shares]
    cuts = _time_cuts(df, [(w - 0.5) / (rows - 1) for w in partial], time)
    sizes = df.agg(*[F.count_if(seconds(time) <= cut).alias(f"n{k}") for k, cut in enumerate(cuts)]).first()
    found = dict(zip(partial, zip(cuts, sizes)))
    return [found.get(w, (None, rows)) for w in wanted]
