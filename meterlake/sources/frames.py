"""Meter-shaped frames from the driver's tables.

The test tables hold no meter data, so each query runs on a frame with the same shape, derived by plain joins
and aggregates over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.features import add_lag_features
from meterlake.operators.series import Series

# Grouped to one row per hour, so a series has at most 8,784 rows a year: windows over it are bounded.
HOURLY = Series(("event_type",), "ts", split=False)
EVENTS = Series(("user_id",), "ts", ("event_id",))
ZEROS = Series(("building_id",), "ts", ("l_orderkey", "l_linenumber", "l_partkey"))
READINGS = Series(("building_id", "meter"), "timestamp", ("l_orderkey", "l_linenumber", "l_partkey"))
# One row per site and day.
WEATHER = Series(("site_id",), "timestamp", split=False)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and hour: `y` the sum of values, `n` the rows."""
    events = table(spark, folder, "events")
    hours = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("ts"))
    return hours.agg(F.round(F.sum("value"), 2).alias("y"), F.count(F.lit(1)).alias("n"))


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as buildings."""
    balance = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("building_id"),
        F.col("c_nationkey").alias("site_id"),
        F.col("c_mktsegment").alias("primary_use"),
        F.greatest(balance, F.lit(0.0)).alias("square_feet"),
        F.when(balance >= 0, (F.col("c_custkey") % 110 + 1900).cast("double")).alias("year_built"),
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Orders joined to their building."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("building_id"),
        F.col("o_orderpriority").alias("meter"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("y"),
        "o_orderkey",
    )
    return orders.join(meta(spark, folder), "building_id")


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Mean quantity per supplier nation and day as temperature, missing on the 5th to 7th of a month."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    days = lines.groupBy(F.col("s_nationkey").alias("site_id"), F.col("l_shipdate").alias("timestamp"))
    known = ~F.dayofmonth("timestamp").isin(5, 6, 7)
    rows = days.agg(F.avg("l_quantity").alias("_t"), F.min("l_linenumber").alias("_c"), F.max("l_linenumber").alias("_p"))
    return rows.select(
        "site_id",
        "timestamp",
        F.when(known, F.col("_t")).alias("air_temperature"),
        F.when(known, F.col("_t") / 2 - 3).alias("dew_temperature"),
        F.when(F.col("_c") != 2, F.col("_c").cast("double")).alias("cloud_coverage"),
        F.when(F.col("_p") != 3, F.col("_p").cast("double")).alias("precip_depth_1_hr"),
    )


def zeros(spark: SparkSession, folder: str) -> DataFrame:
    """Discounts by supplier: a series with zeros in it."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("building_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_discount").alias("y"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Line quantities as readings of a building (supplier) and meter (return flag), with zeros and negatives."""
    meter = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    value = (
        F.when((F.col("l_tax") == 0.08) & (F.col("l_linenumber") == 7), -F.col("l_quantity"))
        .when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_quantity"))
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("building_id"),
        meter.alias("meter"),
        F.col("l_shipdate").alias("timestamp"),
        value.alias("meter_reading"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def preds(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly values predicted by the value 24 rows back."""
    lagged = add_lag_features(hourly(spark, folder), HOURLY, "y", (24,))
    return lagged.where(F.col("lag_24h").isNotNull()).select("event_type", "ts", F.col("y").alias("y_true"), F.col("lag_24h").alias("y_pred"))


def model_preds(spark: SparkSession, folder: str) -> DataFrame:
    """Two models on the same rows: `lag` and `mean`, the latter predicting the mean of the event type."""
    lag = preds(spark, folder)
    means = hourly(spark, folder).groupBy("event_type").agg(F.avg("y").alias("y_pred"))
    mean = lag.drop("y_pred").join(means, "event_type")
    return lag.withColumn("model", F.lit("lag")).unionByName(mean.withColumn("model", F.lit("mean")))
