"""Lines from moments satisfy the conditions of their minimum; stores and sources know what they hold."""

import numpy as np
import pandas as pd
import pytest

from meterlake.operators import models
from meterlake.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(0, 1, (240, 3))
    x[:, 2] = 0.8 * x[:, 0] + 0.2 * x[:, 2]
    y = 3 + x @ np.array([2.0, -0.4, 0.0]) + rng.normal(0, 0.5, 240)
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, block=np.arange(240) // 80)
    return frame, spark.createDataFrame(frame).repartition(5)


def test_moments_are_the_sums_of_products(rows):
    frame, df = rows
    got = models.moments(df, ["a", "b", "c", "y"], "block")
    for block, part in frame.groupby("block"):
        m = np.column_stack([np.ones(len(part)), part[["a", "b", "c", "y"]]])
        np.testing.assert_allclose(got[block], m.T @ m, rtol=1e-10, atol=1e-9)
    with pytest.raises(ValueError):
        models.moments(df.selectExpr("block", "if(a > 1, null, a) as a", "y"), ["a", "y"], "block")


@pytest.mark.parametrize(("alpha", "ratio"), [(0.05, 1.0), (0.6, 1.0), (0.3, 0.4), (50.0, 1.0), (0.0, 0.0)])
def test_lasso_and_elastic_net_are_at_their_minimum(rows, alpha, ratio):
    frame, df = rows
    m = sum(models.moments(df, ["a", "b", "c", "y"], "block").values())
    line = models.elastic_line(m, alpha, ratio, per_row=True)
    x, y = frame[["a", "b", "c"]].to_numpy(), frame.y.to_numpy()
    gap = y - line.intercept - x @ line.coefficients
    assert abs(gap.mean()) < 1e-9
    slope = x.T @ gap / len(y) - alpha * (1 - ratio) * line.coefficients
    for g, w in zip(slope, line.coefficients):
        assert abs(g - alpha * ratio * np.sign(w)) < 1e-8 if w else abs(g) <= alpha * ratio + 1e-9
    assert models.squared_error(m, line) == pytest.approx((gap**2).sum())


def test_ridge_is_the_closed_form(rows):
    frame, df = rows
    m = sum(models.moments(df, ["a", "b", "c", "y"], "block").values())
    x, y = frame[["a", "b", "c"]].to_numpy(), frame.y.to_numpy()
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + 7 * np.eye(3), centred.T @ (y - y.mean()))
    np.testing.assert_allclose(models.elastic_line(m, 7.0, 0.0, per_row=False).coefficients, want, rtol=1e-9)


def test_stored_predictions_are_those_of_the_same_making(spark, tmp_path):
    store = tables.PredictionStore(spark, str(tmp_path / "p"))
    store.save("m", spark.createDataFrame([(1, 2.0)], "building_id int, y_pred double"), "depth 3")
    assert store.has("m", "depth 3") and not store.has("m", "depth 4") and not store.has("other", "depth 3")
    assert store.load_all().count() == 1


def test_a_folder_of_csv_files_is_read_with_its_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "2016-01-01 05:00:00", 2.5), (2, 3, None, None)], "building_id int, meter int, timestamp string, meter_reading double")
    tables.write_table(df.repartition(2), str(tmp_path / "folder"))
    back = tables.read_readings(spark, str(tmp_path / "folder"), format="csv")
    assert sorted((r.building_id, r.meter_reading) for r in back.collect()) == [(1, 2.5), (2, None)]
    assert back.where("timestamp is not null").first().timestamp.hour == 5
