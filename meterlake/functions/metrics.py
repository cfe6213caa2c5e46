"""Forecast errors as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions.scalars import clip, col


def bias(true="y_true", pred="y_pred") -> Column:
    return F.avg(col(pred) - col(true))


def rmse(true="y_true", pred="y_pred") -> Column:
    gap = col(true) - col(pred)
    return F.sqrt(F.avg(gap * gap))


def mae(true="y_true", pred="y_pred") -> Column:
    return F.avg(F.abs(col(true) - col(pred)))


def cv_rmse(true="y_true", pred="y_pred") -> Column:
    """RMSE over the mean of the actual values; null where that mean is 0."""
    return rmse(true, pred) / F.nullif(F.avg(col(true)), F.lit(0.0))


def cv_rmse_floored(true="y_true", pred="y_pred", floor: float = 1e-6) -> Column:
    return rmse(true, pred) / F.greatest(F.avg(col(true)), F.lit(floor))


def rmsle(true="y_true", pred="y_pred") -> Column:
    gap = F.log1p(clip(pred, 0.0)) - F.log1p(clip(true, 0.0))
    return F.sqrt(F.avg(gap * gap))


def score_columns(true="y_true", pred="y_pred") -> list[Column]:
    """The four errors of a score row."""
    return [
        rmse(true, pred).alias("rmse"),
        mae(true, pred).alias("mae"),
        cv_rmse(true, pred).alias("cv_rmse"),
        rmsle(true, pred).alias("rmsle"),
    ]


def score_sums(true="y_true", pred="y_pred") -> list[Column]:
    """What the four errors are made of, as sums that can be added up further: rows, rows with both values, ..."""
    gap = col(true) - col(pred)
    log_gap = F.log1p(clip(pred, 0.0)) - F.log1p(clip(true, 0.0))
    return [
        F.count(F.lit(1)).alias("_n"),
        F.count(gap).alias("_known"),
        F.sum(gap * gap).alias("_squares"),
        F.sum(F.abs(gap)).alias("_gaps"),
        F.count(col(true)).alias("_trues"),
        F.sum(col(true)).alias("_true"),
        F.sum(log_gap * log_gap).alias("_log_squares"),
    ]


def scores_of_sums() -> list[Column]:
    """`score_columns` from `score_sums` that are added up."""
    mean = lambda total, n: F.sum(total) / F.nullif(F.sum(n), F.lit(0))
    root = F.sqrt(mean("_squares", "_known"))
    return [
        root.alias("rmse"),
        mean("_gaps", "_known").alias("mae"),
        (root / F.nullif(mean("_true", "_trues"), F.lit(0.0))).alias("cv_rmse"),
        F.sqrt(mean("_log_squares", "_known")).alias("rmsle"),
    ]


def spread(true="y_true", pred="y_pred") -> Column:
    """The part of the RMSE that is not bias: sqrt(rmse^2 - bias^2), which is the deviation of the residuals."""
    return F.stddev_pop(col(pred) - col(true))
