"""Smoothed target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalars import to_log
from meterlake.session import durable


class TargetEncoder:
    """Replaces a key combination by the mean of log(1 + target) over its training rows, drawn to the overall
    mean by `smoothing` pseudo-rows. Unseen combinations get the overall mean.
    """

    def __init__(self, keys: Sequence[str], target: str = "meter_reading", smoothing: float = 30):
        self.keys, self.target, self.smoothing = list(keys), target, float(smoothing)
        self.column = "te_" + "_x_".join(self.keys)
        self.encoding: DataFrame | None = None
        self.overall: float | None = None

    def fit(self, df: DataFrame) -> TargetEncoder:
        """Reads the training rows once and writes the fitted cells."""
        if self.target not in df.columns:
            raise ValueError(f"target column {self.target} is missing")
        cells = durable(
            df.select(*self.keys, to_log(self.target).alias("_t"))
            .groupBy(*self.keys)
            .agg(F.sum("_t").alias("_sum"), F.count("_t").alias("_n"))
        )
        self.overall = cells.agg(F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).first()[0]  # one number
        total = F.coalesce(F.col("_sum"), F.lit(0.0)) + F.lit(self.smoothing) * F.lit(self.overall)
        self.encoding = cells.na.drop(subset=self.keys).select(
            *self.keys, (total / (F.col("_n") + self.smoothing)).alias(self.column)
        )
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.encoding is None:
            raise RuntimeError("fit the encoder before transform")
        return (
            df.drop(self.column)
            .join(self.encoding, self.keys, "left")
            .withColumn(self.column, F.coalesce(F.col(self.column), F.lit(self.overall)))
        )

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def deviation(self) -> DataFrame:
        """Encoding minus the overall mean, for each key combination."""
        return self.encoding.withColumn("deviation", F.col(self.column) - F.lit(self.overall)).drop(self.column)

    def save(self, path: str) -> None:
        self.encoding.withColumn("_overall", F.lit(self.overall)).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> TargetEncoder:
        stored = spark.read.parquet(path)
        self.overall = stored.agg(F.max("_overall")).first()[0]
        self.encoding = stored.drop("_overall")
        return self
