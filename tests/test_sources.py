import pytest

from meterlake.operators import joins
from meterlake.sources import tables

READINGS = "building_id,meter,timestamp,meter_reading\n0,0,2016-01-01 00:00:00,1.5\n0,1,2016-01-01 01:00:00,\n1,0,2016-01-01 00:00:00,0\n"
META = "site_id,building_id,primary_use,square_feet,year_built,floor_count\n4,0,Education,7432.0,2008.0,\n5,1,Office,100.0,,3.0\n"
WEATHER = (
    "site_id,timestamp,air_temperature,cloud_coverage,dew_temperature,precip_depth_1_hr,sea_level_pressure,wind_direction,wind_speed\n"
    "4,2016-01-01 00:00:00,25.0,6.0,20.0,,1019.7,0.0,0.0\n"
)


@pytest.fixture
def files(tmp_path):
    paths = {}
    for name, text in (("readings", READINGS), ("meta", META), ("weather", WEATHER)):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        paths[name] = str(path)
    return paths


def test_csv_scans_are_typed(spark, files):
    readings, meta, weather = tables.read_subset(spark, files["readings"], files["meta"], files["weather"])
    assert dict(readings.dtypes) == {"building_id": "int", "meter": "int", "timestamp": "timestamp", "meter_reading": "double"}
    assert [r.meter_reading for r in readings.orderBy("building_id", "meter").collect()] == [1.5, None, 0.0]
    ages = {r.building_id: (r.building_age, round(r.log_square_feet, 4)) for r in meta.collect()}
    assert ages == {0: (9.0, 8.9137), 1: (None, 4.6151)}
    joined = joins.join_context(readings, meta, weather)
    assert joined.count() == 3 and joined.where("air_temperature = 25").count() == 1


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text("meter_reading,extra,timestamp,meter,building_id\n2.5,x,2016-01-01 00:00:00,3,7\n")
    row = tables.read_readings(spark, str(path)).first()
    assert (row.building_id, row.meter, row.meter_reading) == (7, 3, 2.5)


def test_site_subset(spark, files):
    readings, _, _ = tables.read_subset(spark, files["readings"], files["meta"], files["weather"], sites=[5])
    assert [r.building_id for r in readings.collect()] == [1]


def test_missing_column_raises(spark, files):
    with pytest.raises(ValueError):
        tables.read_weather(spark, files["meta"])


def test_parquet_by_month(spark, files, tmp_path):
    readings = tables.read_readings(spark, files["readings"])
    tables.write_by_month(readings, str(tmp_path / "months"))
    back = tables.read_by_month(spark, str(tmp_path / "months"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, readings.collect()), key=repr)
    assert (tmp_path / "months" / "month_start=2016-01-01").exists()
    again = tables.read_readings(spark, str(tmp_path / "months"))
    assert again.count() == 3


def test_result_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "model string, rmse double")
    tables.write_table(df, str(tmp_path / "csv"))
    assert sorted(tables.read_table(spark, str(tmp_path / "csv"), df.schema).collect()) == sorted(df.collect())
    nested = spark.sql("select 'a' model, struct(1.5 as rmse) overall, array(struct('x' as name, 2L as n)) parts")
    tables.write_nested(nested, str(tmp_path / "json"))
    assert tables.read_nested(spark, str(tmp_path / "json"), nested.schema).collect() == nested.collect()


def test_upsert_replaces_rows_of_the_same_model(spark):
    old = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "model string, rmse double")
    new = spark.createDataFrame([("a", 0.5)], "model string, rmse double")
    assert [tuple(r) for r in tables.upsert_results(old, new).collect()] == [("a", 0.5), ("b", 1.0)]


def test_prediction_store(spark, tmp_path):
    store = tables.PredictionStore(spark, str(tmp_path / "p"))
    rows = spark.createDataFrame([(1, 2.0)], "building_id int, y_pred double")
    assert not store.has("m")
    store.save("m", rows)
    store.save("other", rows)
    assert store.has("m") and store.load("m").first().model == "m"
    assert {r.model for r in store.load_all().collect()} == {"m", "other"}
