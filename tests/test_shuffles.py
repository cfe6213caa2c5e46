from pyspark.sql import functions as F

from meterlake.operators.joins import join_meta
from meterlake.session import configure


def test_a_shuffled_join_has_parts_by_its_size_not_by_the_session(spark):
    settings = {
        "spark.sql.shuffle.partitions": "2", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64kb",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16kb",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            configure(spark).conf.set(key, value)
        meta = spark.range(20_000).select(F.col("id").alias("building_id"), (F.col("id") % 7).alias("site_id"))

        readings = spark.range(500_000).select((F.col("id") % 20_000).alias("building_id"), F.rand(1).alias("meter_reading"))
        parts = join_meta(readings, meta).groupBy(F.spark_partition_id()).agg(F.count("meter_reading").alias("n")).collect()
        assert sum(r["n"] for r in parts) == 500_000
        assert max(r["n"] for r in parts) < 50_000  # two parts of 250,000 by the session's own number
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
