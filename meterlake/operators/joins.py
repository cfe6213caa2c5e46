"""Joins of readings with context, predictions and labels.

No side is forced to be broadcast: metadata and weather grow with the number of buildings, so Spark decides
from their size, and AQE splits a hot building or site that a shuffled join meets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import durable


def join_meta(readings: DataFrame, meta: DataFrame) -> DataFrame:
    return readings.join(meta, "building_id", "left")


def join_context(readings: DataFrame, meta: DataFrame, weather: DataFrame) -> DataFrame:
    """Readings with the metadata of the building and the weather of its site and hour.

    Both dimensions should be files or written tables (`durable`), whose size Spark knows.
    """
    return join_meta(readings, meta).join(weather, ["site_id", "timestamp"], "left")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(durable(keys.select(*on).distinct()), list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def group_mean_lookup(train: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the training rows of the same keys, else of all training rows."""
    sums = train.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    cells = durable(sums)
    overall = cells.agg(F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0)))
    means = cells.withColumn(out, F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).drop("_s", "_n")
    return rows.join(means, list(keys), "left").withColumn(out, F.coalesce(F.col(out), overall.scalar()))


def join_labels(df: DataFrame, labels: DataFrame, fallback: DataFrame, on: Sequence[str], label: str = "cluster") -> DataFrame:
    """Label from `labels`, for keys it lacks from `fallback`."""
    second = fallback.withColumnRenamed(label, "_fallback")
    out = df.join(labels, list(on), "left").join(second, list(on), "left")
    return out.withColumn(label, F.coalesce(label, "_fallback")).drop("_fallback")


def first_label(labels: DataFrame, fallback: DataFrame, on: Sequence[str], label: str = "cluster") -> DataFrame:
    """Both label tables, the first one winning where a key is in both."""
    ranked = labels.withColumn("_rank", F.lit(0)).unionByName(fallback.withColumn("_rank", F.lit(1)))
    return ranked.groupBy(*on).agg(F.min_by(label, "_rank").alias(label))


def join_predictions(predictions: DataFrame, context: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions with the context columns of their rows; unmatched predictions are dropped."""
    return predictions.join(context, list(on), "inner")


def coverage(predictions: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """How many rows have a prediction, as count and percentage."""
    seen = predictions.select(*on).distinct().withColumn("_hit", F.lit(1))
    return rows.join(seen, list(on), "left").agg(
        F.count("_hit").alias("matched"),
        F.count(F.lit(1)).alias("total"),
        (100.0 * F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("coverage_pct"),
    )


def compare_runs(first: DataFrame, second: DataFrame, on: str = "model", metric: str = "rmse",
                 names: tuple[str, str] = ("engineered", "raw")) -> DataFrame:
    """A metric of two result tables side by side, for the models in both, with the gain of the first."""
    a, b = names
    both = first.select(on, F.col(metric).alias(a)).join(second.select(on, F.col(metric).alias(b)), on)
    both = both.na.drop(subset=[a, b]).withColumn("delta", F.col(b) - F.col(a))
    return both.withColumn("pct_improvement", 100.0 * F.col("delta") / F.nullif(F.col(b), F.lit(0.0)))


def common_values(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    return first.select(column).intersect(second.select(column))
