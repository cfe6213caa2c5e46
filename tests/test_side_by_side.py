"""Fits that do not need each other run at the same time, and give what they give one after another."""

import threading

import pytest

from meterlake.operators.series import Series
from meterlake.plans import training
from meterlake.plans.prepare import Prepared
from meterlake.session import side_by_side

SCORES = {"n": 1, "rmse": 1.0, "mae": 1.0, "cv_rmse": 1.0, "rmsle": 1.0, "train_seconds": 0.0}


def small(spark):
    df = spark.range(60).selectExpr("cast(id % 7 as double) AS x", "ln(1 + id) AS label", "timestamp_seconds(3600 * id) AS timestamp", "id % 2 AS part")
    return Prepared(df, df, ["x"], None, Series(("part",)))


def test_results_keep_their_order_and_errors_are_raised(spark):
    assert side_by_side(spark, [lambda k=k: spark.range(k).count() for k in (5, 3, 9, 1, 7)], 2) == [5, 3, 9, 1, 7]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_independent_fits_meet(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)  # broken where one fit waits for the end of another

    def waiting(model, prep, train=None):
        both.wait()
        return {"model": model.name} | SCORES

    monkeypatch.setattr(training, "score_model", waiting)
    prep = small(spark)
    assert training.ablation(lambda name: prep, {"decision_tree": {}}).count() == 1
    found = training.sample_complexity(prep, {"decision_tree": {}}, (0.5, 1.0)).collect()
    assert sorted((r.fraction, r.n_train) for r in found) == [(0.5, 30), (1.0, 60)]
    assert training.imputation_experiment(lambda s: prep, ["a", "b"], "decision_tree").count() == 2


def test_scores_are_those_of_one_after_another(spark):
    models = {"decision_tree": {"min_rows": 2}, "ols": {}}
    one, four = (training.sample_complexity(small(spark), models, (0.5, 1.0), at_once=k).drop("train_seconds").collect() for k in (1, 4))
    assert sorted(one) == sorted(four) and len(one) == 4
    prep = small(spark)
    one, four = (training.segment_predictions(prep.train, prep.val, ["x"], "part", "decision_tree", 10, at_once=k, min_rows=2).groupBy("part", "model").agg({"y_pred": "sum"}).collect() for k in (1, 4))
    assert sorted(map(tuple, one)) == sorted(map(tuple, four)) and len(one) == 4


def test_fits_write_no_more_than_they_read(spark, monkeypatch):
    written = []
    real = training.durable
    monkeypatch.setattr(training, "durable", lambda df: written.append(set(df.columns)) or real(df))
    prep = small(spark)
    wide = prep.train.selectExpr("*", "'unread' AS comment")
    training.segment_predictions(wide, wide, ["x"], "part", "ols", 10).count()
    assert written == [{"part", "x", "label", "timestamp"}, {"part", "x", "label"}]
    stored = []
    keep = Prepared.stored
    monkeypatch.setattr(Prepared, "stored", lambda p: stored.append(set(p.train.columns) | set(p.val.columns)) or keep(p))
    training.imputation_experiment(lambda s: Prepared(wide, wide, ["x"], None, Series(("part",))), ["a"], "ols").count()
    assert stored == [{"x", "label", "timestamp"}]


def test_linear_models_are_fitted_beside_the_others_on_stored_folds(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)  # broken where the linear models are fitted before the others
    real, read = training.fit_prefixes, []

    def waiting(train, *args, **params):
        both.wait()
        read.append(train)
        return real(train, *args, **params)

    monkeypatch.setattr(training, "fit_prefixes", waiting)
    monkeypatch.setattr(training, "score_model", lambda model, prep, train=None: both.wait() and None or {"model": model.name} | SCORES)
    prep = small(spark)
    found = training.sample_complexity(prep, {"ols": {}, "decision_tree": {}}, (1.0,)).collect()
    assert sorted((r.model, r.n_train) for r in found) == [("decision_tree", 60), ("ols", 60)]
    assert set(read[0].columns) == {"timestamp", "x", "label"} and read[0].inputFiles()
