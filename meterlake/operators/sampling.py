"""Seeded samples that depend on the rows, not on how they are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(keys: Sequence[str], seed: int) -> Column:
    """A pseudo-random number of the key."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows, the same ones for the same seed."""
    return df.orderBy(draw(keys, seed), *keys).limit(n)


def cap_per_stratum(df: DataFrame, stratum: Sequence[str], cap: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most `cap` random rows per stratum.

    A stratum may hold a third of the rows, so it is first cut to `cap` rows in each of many sub-groups.
    """
    rows = df.withColumn("_draw", draw(keys, seed)).withColumn("_sub", F.pmod(F.hash(*keys), F.lit(512)))
    order = ["_draw", *keys]
    part = Window.partitionBy(*stratum, "_sub").orderBy(*order)
    whole = Window.partitionBy(*stratum).orderBy(*order)
    cut = rows.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= cap)
    cut = cut.withColumn("_place", F.row_number().over(whole)).where(F.col("_place") <= cap)
    return cut.drop("_draw", "_sub", "_place")


def sample_stratified_keys(df: DataFrame, keys: Sequence[str], stratum: str, n: int, seed: int = 42) -> DataFrame:
    """About n distinct keys in proportion to the strata, at least one of each, never more than n in all."""
    distinct = df.select(*keys).distinct()
    counts = distinct.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    # half rounds to even, as Python's round does
    quotas = counts.select(
        F.col(stratum).alias("_s"), F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_n") / total)).alias("_quota")
    )
    order = [draw(keys, seed), *keys]
    ranked = cap_per_stratum(distinct, [stratum], n, keys, seed).withColumn(
        "_place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    )
    kept = ranked.join(quotas, ranked[stratum].eqNullSafe(quotas["_s"])).where(F.col("_place") <= F.col("_quota"))
    return kept.select(*keys).orderBy(*order).limit(n)
