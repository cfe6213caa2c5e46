"""Boosting: staged losses, the best round, patience, and the cut model."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from meterlake.operators import models
from meterlake.operators.boosting import boost

TREE = {"maxDepth": 2, "minInstancesPerNode": 1, "seed": 5}
WHOLE = {"max_features": "all", "max_samples": 1.0}


def table(spark, n=400, noise=0.5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, (n, 2)).astype(float)
    rows = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x[:, 0] * 2 + (x[:, 1] > 3) * 3 + rng.normal(0, noise, n), "held": np.arange(n) % 4 == 0})
    df = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(spark.createDataFrame(rows))
    return rows, df


def predicted(model, df):
    return np.array([r.p for r in model.transform(df).select("p").collect()])


def test_losses_are_those_of_the_cut_models(spark):
    rows, df = table(spark)
    settings = {"rounds": 6, "step": 0.3, **WHOLE, **TREE}
    model, losses = boost(df, F.col("held"), "x", "y", "p", **settings)
    held = rows.held.to_numpy()
    y = rows.y.to_numpy()
    assert len(losses) == 7 and losses[0] == pytest.approx(np.mean((y[held] - y[~held].mean()) ** 2))
    assert losses == sorted(losses, reverse=True)  # signal is far from used up
    error = np.mean((predicted(model, df)[held] - y[held]) ** 2)
    assert error == pytest.approx(losses[-1], rel=1e-9) and model.getNumTrees == 7
    score = np.full(len(y), y[~held].mean())  # the trees, one by one
    for k, tree in enumerate(model.trees[1:]):
        score += 0.3 * np.array([tree.predict(v.x) for v in df.select("x").collect()])
        assert np.mean((score[held] - y[held]) ** 2) == pytest.approx(losses[k + 1], rel=1e-9)


def test_patience_stops_and_the_best_round_is_kept(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"a": rng.integers(0, 20, 120).astype(float), "y": rng.normal(0, 1, 120), "held": np.arange(120) % 2 == 0})
    df = VectorAssembler(inputCols=["a"], outputCol="x").transform(spark.createDataFrame(rows))
    model, losses = boost(df, F.col("held"), "x", "y", "p", rounds=200, patience=4, step=0.5, **WHOLE, **TREE)
    best = int(np.argmin(losses))
    assert len(losses) == best + 4 + 1 < 100  # noise: held-out rows get worse
    assert model.getNumTrees == best + 1
    held = rows.held.to_numpy()
    assert np.mean((predicted(model, df)[held] - rows.y[held]) ** 2) == pytest.approx(losses[best])


def test_rows_and_features_are_sampled(spark):
    _, df = table(spark)
    one, _ = boost(df, F.col("held"), "x", "y", "p", rounds=3, max_samples=0.5, max_features=0.5, **TREE)
    two, _ = boost(df, F.col("held"), "x", "y", "p", rounds=3, **WHOLE, **TREE)
    assert [t.toDebugString for t in one.trees[1:]] != [t.toDebugString for t in two.trees[1:]]


def test_nothing_held_out_no_rounds_and_bad_settings(spark):
    rows, df = table(spark, 60)
    model, losses = boost(df, F.lit(None).cast("boolean"), "x", "y", "p", rounds=3, step=0.5, **WHOLE, **TREE)
    assert losses == sorted(losses, reverse=True) and model.getNumTrees == 4
    model, losses = boost(df, F.col("held"), "x", "y", "p", rounds=0, **TREE)
    assert len(losses) == 1
    np.testing.assert_allclose(predicted(model, df), rows.y[~rows.held].mean())
    for bad in ({"rounds": -1}, {"patience": 0}):
        with pytest.raises(ValueError):
            boost(df, F.col("held"), "x", "y", "p", **bad, **TREE)


def test_the_registered_model_holds_out_the_last_tenth(spark):
    n = 300
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n), "timestamp": pd.date_range("2016-01-01", periods=n, freq="h")})
    rows["label"] = 2 * (rows.a > 0) + rng.normal(0, 0.2, n)
    df = spark.createDataFrame(rows)
    model = models.BoostedTrees(rounds=30, patience=3, step=0.4, min_rows=5, max_depth=2).fit(df, ["a", "b"])
    assert 1 <= model.best_round < 30 and model.losses[model.best_round] == min(model.losses)
    late = model.predict(df.orderBy("timestamp")).toPandas().sort_values("timestamp").tail(30)
    assert np.mean((late.label - late.prediction) ** 2) == pytest.approx(min(model.losses), rel=1e-6)
    assert model.feature_importance()["a"] > 0.8 and set(model.feature_importance()) == {"a", "b"}
    lone = models.BoostedTrees(rounds=2, patience=1, stopping_share=0, max_features="all").fit(df.withColumn("flat", F.lit(1.0)), ["a", "flat"])
    assert lone.feature_importance()["flat"] == 0  # a feature that no tree splits by


def test_copies_of_rows_join_the_same_cells(spark, monkeypatch):
    from meterlake.operators import boosting

    _, df = table(spark)
    many = df.crossJoin(spark.range(40).drop("id"))
    few, all_ = (boosting._cells(d, F.col("held"), "x", "y", keep=True) for d in (df, many))
    assert few.count() == all_.count() <= 64
    assert all_.agg(F.sum("_n")).first()[0] == 40 * few.agg(F.sum("_n")).first()[0] == 12_000
    one, two = (boost(d, F.col("held"), "x", "y", "p", rounds=4, step=0.5, **WHOLE, **TREE)[1] for d in (df, many))
    np.testing.assert_allclose(one, two, rtol=1e-9)
    monkeypatch.setattr(boosting, "CELL_ROWS", 50)  # large cells in several parts
    parts = boosting._cells(many, F.col("held"), "x", "y", keep=True)
    assert parts.count() > 64 and parts.agg(F.max(F.size("_labels"))).first()[0] < 100
    np.testing.assert_allclose(boost(many, F.col("held"), "x", "y", "p", rounds=4, step=0.5, max_samples=0.999999, max_features="all", **TREE)[1], one, rtol=1e-2)


def test_every_row_of_a_cell_is_drawn_on_its_own(spark):
    from meterlake.operators import boosting

    _, df = table(spark, 4_000)
    cells = boosting._cells(df, F.lit(False), "x", "y", keep=True)
    draws = [cells.select(boosting._draw(0.9, k)("_id", "_labels").alias("d"), "_n").agg(F.sum("d.n"), F.sum("d.s"), F.count_if(F.col("d.n") < F.col("_n"))).first() for k in range(12)]
    taken = [d[0] for d in draws]
    assert abs(np.mean(taken) - 3_600) < 25 and 4 < np.std(taken) < 60 and min(d[2] for d in draws) > 50
    assert len({d[1] for d in draws}) == 12
    whole = cells.select(boosting._draw(1.0, 3)("_id", "_labels").alias("d"), "_n", "_sum").agg(F.sum(F.abs(F.col("d.n") - F.col("_n"))), F.max(F.abs(F.col("d.s") - F.col("_sum")))).first()
    assert whole[0] == 0 and whole[1] < 1e-9
