"""Types of the three input tables."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

READINGS = StructType(
    [
        StructField("building_id", IntegerType()),
        StructField("meter", IntegerType()),
        StructField("timestamp", TimestampType()),
        StructField("meter_reading", DoubleType()),
    ]
)

META = StructType(
    [
        StructField("site_id", IntegerType()),
        StructField("building_id", IntegerType()),
        StructField("primary_use", StringType()),
        StructField("square_feet", DoubleType()),
        StructField("year_built", DoubleType()),
        StructField("floor_count", DoubleType()),
    ]
)

WEATHER = StructType(
    [
        StructField("site_id", IntegerType()),
        StructField("timestamp", TimestampType()),
        StructField("air_temperature", DoubleType()),
        StructField("cloud_coverage", DoubleType()),
        StructField("dew_temperature", DoubleType()),
        StructField("precip_depth_1_hr", DoubleType()),
        StructField("sea_level_pressure", DoubleType()),
        StructField("wind_direction", DoubleType()),
        StructField("wind_speed", DoubleType()),
    ]
)

# One score row: a model on one group of one grouping.
SCORES = "model string, group_kind string, group string, n bigint, rmse double, mae double, cv_rmse double, rmsle double"
