"""Published tables: readers see the old version or the new one, whole."""

import pytest
from pyspark.sql import functions as F

from meterlake.sources import tables
from meterlake.sources.versions import VersionedTable


def rows(df):
    return sorted(r.x for r in df.collect())


def failing(spark):
    """Some partitions are written before another one fails."""
    bad = F.when(F.col("id") == 95, F.raise_error(F.lit("lost half-way"))).otherwise(F.col("id"))
    return spark.range(0, 100, 1, 8).select(bad.alias("x"))


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.manifest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.publish(spark.range(3).select(F.col("id").alias("x")), made_from="first")
    with pytest.raises(Exception, match="lost half-way"):
        table.publish(failing(spark), made_from="second")
    assert rows(table.read()) == [0, 1, 2] and table.manifest()["made_from"] == "first"


def test_a_version_may_be_made_from_the_one_it_replaces(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(2).select(F.col("id").alias("x")))
    old = table.read()
    table.publish(old.select((F.col("x") + 10).alias("x")))
    assert rows(table.read()) == [10, 11] and rows(old) == [0, 1]  # readers of the old version go on
    assert len(table.drop_old()) == 1 and rows(table.read()) == [10, 11] and table.drop_old() == []


def test_store_keeps_the_old_predictions_of_a_failed_save(spark, tmp_path):
    store = tables.PredictionStore(spark, str(tmp_path / "p"))
    store.save("a", spark.range(2).select(F.col("id").alias("x")), "depth 3")
    store.save("b", spark.range(4).select(F.col("id").alias("x")), "depth 3")
    with pytest.raises(Exception, match="lost half-way"):
        store.save("a", failing(spark), "depth 4")
    assert store.has("a", "depth 3") and not store.has("a", "depth 4")
    assert rows(store.load("a")) == [0, 1]
    assert {(r.model, r.n) for r in store.load_all().groupBy("model").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 4)}
    store.save("a", spark.range(5).select(F.col("id").alias("x")), "depth 4")
    store.drop_old()
    assert rows(store.load("a")) == [0, 1, 2, 3, 4] and store.load_all().columns == ["x", "model"]


def test_upsert_into_a_published_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "r"))
    frame = lambda *r: spark.createDataFrame(list(r), "model string, rmse double")
    tables.upsert_published(table, frame(("a", 3.0), ("b", 1.0)))
    got = tables.upsert_published(table, frame(("a", 0.5), ("c", 2.0)))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0.5), ("b", 1.0), ("c", 2.0)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_a_time_range_opens_only_its_months(spark, tmp_path, kind):
    df = spark.range(366).select(F.expr(f"CAST(TIMESTAMP'2016-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS {kind})").alias("timestamp"))
    path = str(tmp_path / "m")
    tables.write_by_month(df, path)
    got = tables.read_by_month(spark, path, "2016-03-15", "2016-05-01")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan and got.count() == 17 + 30
    opened = {f.split("month_start=")[1][:7] for f in got.inputFiles()}
    assert opened >= {"2016-03", "2016-04"}
    read = [n for n in plan.split("\n") if "PartitionFilters" in n][0]
    assert "2016-03-01" in read and "2016-05-01" in read
    assert tables.read_by_month(spark, path, start="2016-12-31").count() == 1
    assert tables.read_by_month(spark, path, end="2016-01-02").count() == 1
    assert tables.read_by_month(spark, path).count() == 366
