import math

import pandas as pd
from pyspark.sql import functions as F


def frame(df, keys):
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def assert_same(a, b, keys, rtol=1e-9):
    left, right = frame(a, keys), frame(b, keys)
    assert sorted(left.columns) == sorted(right.columns)
    pd.testing.assert_frame_equal(left, right[left.columns], rtol=rtol, atol=1e-9, check_dtype=False)


def values(df, column, order="timestamp"):
    return [None if r[0] is None or (isinstance(r[0], float) and math.isnan(r[0])) else r[0] for r in df.orderBy(order).select(column).collect()]


def with_gaps(df, column, keys, share=3):
    """Null out about one value in `share`, chosen by key."""
    return df.withColumn(column, F.when(F.pmod(F.xxhash64(*keys), F.lit(share)) != 0, F.col(column)))
