"""Column helpers that keep nulls null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ceiling of predictions on the log scale.
LOG_CEILING = 14.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]; `least` and `greatest` alone would turn null into a bound."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def no_nan(c: str | Column) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def to_log(c: str | Column) -> Column:
    """log(1 + y) of the reading, negative readings taken as 0."""
    return F.log1p(clip(c, 0.0))


def from_log(c: str | Column) -> Column:
    """Back to the reading, the log value limited to [0, 14]."""
    return F.expm1(clip(c, 0.0, LOG_CEILING))


def clip_real(c: str | Column, ceiling: float | None = LOG_CEILING) -> Column:
    """Limit a raw value to the range that `from_log` can give; without a ceiling only from below."""
    return clip(c, 0.0, None if ceiling is None else math.expm1(ceiling))


def seconds(c: str | Column) -> Column:
    """Seconds since 1970 with their fraction, for timestamps with or without a zone."""
    return F.unix_micros(col(c).cast("timestamp")) / 1e6


def wave(c: str | Column, period: int, shape: str) -> Column:
    turn = F.lit(2 * math.pi) * col(c) / F.lit(period)
    return F.sin(turn) if shape == "sin" else F.cos(turn)
