"""Scans of readings, building metadata and weather; sinks and stores for results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meterlake.sources import schemas
from meterlake.sources.versions import Files, VersionedTable


def read_typed(spark: SparkSession, path: str, schema: StructType, format: str | None = None) -> DataFrame:
    """Scan CSV (by header name) or Parquet and cast to `schema`; a missing column is an error.

    Without `format` a path that ends in .csv or .csv.gz is CSV, and all others, folders too, are Parquet.
    """
    format = format or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if format == "csv":
        # only the names are read ahead; the values get their types in the scan
        names = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f.dataType for f in schema}
        given = StructType([StructField(n, kinds.get(n, StringType())) for n in names])
        raw = spark.read.option("header", True).schema(given).csv(path)
    else:
        raw = spark.read.format(format).load(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    held = dict(raw.dtypes)
    return raw.select(
        *[
            F.col(f.name) if held[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def read_readings(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    return read_typed(spark, path, schemas.READINGS, format)


def read_weather(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    return read_typed(spark, path, schemas.WEATHER, format)


def read_meta(spark: SparkSession, path: str, reference_year: int = 2017, format: str | None = None) -> DataFrame:
    return derive_meta(read_typed(spark, path, schemas.META, format), reference_year)


def derive_meta(meta: DataFrame, reference_year: int = 2017) -> DataFrame:
    """Age in the reference year and the log of the floor area."""
    return meta.withColumns(
        {"building_age": F.lit(reference_year) - F.col("year_built"), "log_square_feet": F.log1p("square_feet")}
    )


def keep_sites(readings: DataFrame, meta: DataFrame, sites: Iterable[int] | None) -> DataFrame:
    """Readings of the buildings on the chosen sites; all readings where `sites` is None."""
    if sites is None:
        return readings
    chosen = meta.where(F.col("site_id").isin(*sites)).select("building_id")
    return readings.join(chosen, "building_id", "left_semi")


def read_subset(
    spark: SparkSession,
    readings_path: str,
    meta_path: str,
    weather_path: str,
    sites: Iterable[int] | None = None,
    reference_year: int = 2017,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings (of the chosen sites), metadata and weather."""
    meta = read_meta(spark, meta_path, reference_year)
    return keep_sites(read_readings(spark, readings_path), meta, sites), meta, read_weather(spark, weather_path)


def write_by_month(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Parquet partitioned by calendar month. Rows of one month go to several tasks, as many as the month needs."""
    stamped = df.withColumn("month_start", F.to_date(F.date_trunc("month", time)))
    # AQE sizes the partitions of a rebalance and splits a month that holds too many rows
    stamped.hint("rebalance", "month_start").write.mode("overwrite").partitionBy("month_start").parquet(path)


def read_by_month(spark: SparkSession, path: str, start=None, end=None, time: str = "timestamp") -> DataFrame:
    """The rows from `start` on and before `end`, each a timestamp or None. Only folders of months that the range meets are
    opened."""
    rows = spark.read.parquet(path)
    kind = rows.schema[time].dataType if start is not None or end is not None else None
    if start is not None:
        first = F.lit(start).cast(kind)
        rows = rows.where((F.col("month_start") >= F.trunc(first, "month")) & (F.col(time) >= first))
    if end is not None:
        last = F.lit(end).cast(kind)
        rows = rows.where((F.col("month_start") <= last.cast("date")) & (F.col(time) < last))
    return rows.drop("month_start")


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_nested(df: DataFrame, path: str) -> None:
    """Nested results (structs and arrays) as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_nested(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


class PredictionStore:
    """Predictions by model, kept as Parquet and reused until a refit is asked for. A save publishes a new version, so that
    one that fails leaves the old predictions.

    `made_from` says what a prediction depends on, such as parameters, features and the ends of the folds. Predictions made
    from something else count as missing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, model: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/model={model}")

    def has(self, model: str, made_from: str = "") -> bool:
        told = self._table(model).manifest()
        return told is not None and told.get("made_from", "") == made_from

    def save(self, model: str, predictions: DataFrame, made_from: str = "") -> DataFrame:
        self._table(model).publish(predictions, made_from=made_from)
        return self.load(model)

    def load(self, model: str) -> DataFrame:
        return self._table(model).read().withColumn("model", F.lit(model))

    def load_all(self) -> DataFrame:
        """All models as one long table, the model read from the folder name."""
        models = [n.removeprefix("model=") for n in Files(self.spark).names(self.path) if n.startswith("model=")]
        folders = [self._table(m).folder() for m in models if self._table(m).manifest() is not None]
        return self.spark.read.option("basePath", self.path).parquet(*folders).drop("version")

    def drop_old(self) -> None:
        """Delete the versions that have been replaced; frames that read them end with it."""
        for name in Files(self.spark).names(self.path):
            if name.startswith("model="):
                VersionedTable(self.spark, f"{self.path}/{name}").drop_old()


def upsert_results(existing: DataFrame, new: DataFrame, key: str = "model", order: str = "rmse") -> DataFrame:
    """Replace the rows of the models in `new`, keep the others, best first."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new).orderBy(order, key)


def upsert_published(table: VersionedTable, new: DataFrame, key: str = "model", order: str = "rmse") -> DataFrame:
    """`upsert_results` into a published table, which readers see before or after, never half done."""
    table.publish(new.orderBy(order, key) if table.manifest() is None else upsert_results(table.read(), new, key, order))
    return table.read()
