import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions import metrics
from meterlake.operators import joins, models, segments
from meterlake.plans import training
from meterlake.plans.queries.sequences import prepare_lines
from meterlake.sources import tables

SMALL_TREES = {"max_depth": 5, "max_bins": 32}
SMALL_BOOST = {"rounds": 8, "max_depth": 4, "step": 0.3, "max_bins": 32}


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(0, 1, (n, 3)) * [1, 5, 0.1]
    y = 2 + x @ [1.0, -0.4, 3.0] + rng.normal(0, 0.3, n)
    rows = pd.DataFrame(x, columns=["a", "b", "c"]).assign(constant=1.0, label=y, timestamp=pd.date_range("2016-01-01", periods=n, freq="h"))
    return rows, spark.createDataFrame(rows)


def scaled(rows):
    x = rows[["a", "b", "c"]].to_numpy()
    return (x - x.mean(0)) / x.std(0), rows.label.to_numpy()


NAMES = ["a", "b", "c", "constant"]


def test_ols_equals_numpy(linear):
    rows, df = linear
    model = models.OLS().fit(df, NAMES)
    x, y = scaled(rows)
    want = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    assert model.scaler.kept == ["a", "b", "c"]  # the constant column is dropped
    np.testing.assert_allclose(list(model.feature_importance().values()), want[1:], rtol=1e-6)
    out = model.predict(df)
    assert out.columns == df.columns + ["prediction"]
    np.testing.assert_allclose(out.toPandas()[["a", "b"]], rows[["a", "b"]])


def test_ridge_penalty_is_on_the_textbook_scale(linear):
    rows, df = linear
    model = models.Ridge(alphas=[50.0], cv=2).fit(df, NAMES)
    x, y = scaled(rows)
    want = np.linalg.solve(x.T @ x + 50.0 * np.eye(3), x.T @ (y - y.mean()))
    np.testing.assert_allclose(list(model.model.coefficients), want, rtol=1e-6)


def test_lasso_drives_weak_features_to_zero(linear):
    _, df = linear
    strong = models.Lasso(alphas=[0.5], cv=2).fit(df, NAMES)
    assert strong.feature_importance()["c"] == pytest.approx(0, abs=1e-6)
    free = models.Lasso(alphas=[0.001, 0.5], cv=2).fit(df, NAMES)
    assert free.chosen[0] == 0.001
    mixed = models.ElasticNet(alphas=[0.01], l1_ratios=[0.2, 0.8], cv=2).fit(df, NAMES)
    assert mixed.chosen[1] in (0.2, 0.8)


def test_models_must_be_fit_first(linear):
    with pytest.raises(RuntimeError):
        models.OLS().predict(linear[1])
    with pytest.raises(RuntimeError):
        models.Standardizer().transform(linear[1])
    with pytest.raises(NotImplementedError):
        models.Regressor().fit(linear[1], NAMES)


def test_registry_names():
    assert set(models.REGISTRY) == {"ols", "ridge", "lasso", "elasticnet", "decision_tree", "random_forest", "boosted_trees"}
    assert all(m.name == n and m.family in ("linear", "trees") for n, m in models.REGISTRY.items())


@pytest.mark.parametrize("name,params", [("decision_tree", SMALL_TREES), ("random_forest", {"n_trees": 4, **SMALL_TREES}), ("boosted_trees", SMALL_BOOST)])
def test_trees_beat_the_mean(linear, name, params):
    _, df = linear
    model = models.REGISTRY[name](min_rows=10, **params).fit(df, NAMES)
    errors = model.predict(df).agg(metrics.rmse("label", "prediction"), F.stddev_pop("label")).first()
    assert errors[0] < 0.5 * errors[1]
    assert sum(model.feature_importance().values()) == pytest.approx(1)


def test_importance_table(spark, linear):
    tree = models.DecisionTree(min_rows=10, **SMALL_TREES).fit(linear[1], NAMES)
    assert [r.feature for r in models.top_features(tree.importance_table(spark), 2).collect()] == ["b", "a"]


def test_depth_sweep(linear):
    out = models.depth_sweep(linear[1], linear[1], NAMES, [1, 4], min_rows=10).orderBy("max_depth").collect()
    assert out[0].rmse > out[1].rmse


def test_profiles_equal_pandas(spark):
    rng = np.random.default_rng(12)
    rows = pd.DataFrame({"building_id": rng.integers(0, 4, 500), "meter": 0, "timestamp": pd.Timestamp("2016-01-01") + pd.to_timedelta(rng.integers(0, 900, 500), "h"),
                         "meter_reading": rng.uniform(0, 9, 500)})
    rows.loc[rows.building_id == 3, "meter_reading"] = 0.0
    hour = rows.timestamp.dt.hour
    means = rows.groupby(["building_id", hour]).meter_reading.mean().unstack().reindex(columns=range(24)).fillna(0.0)
    want = means.div(means.sum(axis=1).replace(0, 1), axis=0)
    out = segments.consumption_profiles(spark.createDataFrame(rows)).toPandas().sort_values("building_id")
    np.testing.assert_allclose(out[segments.HOURS], want, rtol=1e-9)


def test_clusters_and_elbow(spark):
    rows = [(i, 0, *[(1.0 if (h < 12) == (i % 2 == 0) else 0.0) / 12 for h in range(24)]) for i in range(20)]
    profiles = spark.createDataFrame(rows, "building_id int, meter int, " + ", ".join(f"{h} double" for h in segments.HOURS))
    model = segments.fit_kmeans(profiles, 2)
    labels = {r.building_id: r.cluster for r in segments.assign_clusters(model, profiles).collect()}
    assert len({labels[i] for i in range(0, 20, 2)}) == 1 and labels[0] != labels[1]
    assert segments.centroids(spark, model).count() == 2
    assert [r.k for r in segments.elbow_curve(profiles, [3, 2]).orderBy("k").collect()] == [2, 3]

    curve = spark.createDataFrame([(2, 10.0, 1), (3, 4.0, 1), (4, 3.0, 1), (5, 2.5, 1)], "k int, inertia double, n_iter int")
    assert segments.pick_elbow(curve).first().k == 3
    assert segments.pick_elbow(curve.where("k > 3")).first().k == 4


def test_label_tables(spark):
    first = spark.createDataFrame([(1, 5)], "building_id int, cluster int")
    second = spark.createDataFrame([(1, 7), (2, 8)], "building_id int, cluster int")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "building_id int")
    joined = joins.join_labels(rows, first, second, ["building_id"]).orderBy("building_id").collect()
    assert [r.cluster for r in joined] == [5, 8, None]
    assert {tuple(r) for r in joins.first_label(first, second, ["building_id"]).collect()} == {(1, 5), (2, 8)}


def test_training_job_reuses_stored_predictions(spark, folder, tmp_path):
    prep = prepare_lines(spark, folder, lags=(2, 3), windows=(4,))
    store = tables.PredictionStore(spark, str(tmp_path / "predictions"))
    report, about = training.train_all(prep, {"ols": {}}, store)
    board = training.results_table(report, about).collect()
    assert [r.rmse for r in board] == sorted(r.rmse for r in board)
    assert {r.model for r in board} == {"ols", "baseline_group_mean"}
    assert about["ols"]["train_seconds"] > 0 and about["ols"]["importance"]
    again, about = training.train_all(prep, {"ols": {}}, store)
    assert about["ols"]["train_seconds"] is None
    assert again.where("model = 'ols' and group_kind = 'overall'").first() == report.where("model = 'ols' and group_kind = 'overall'").first()
    refit = training.train_all(prep, {"ols": {}}, store, refit=True, skip=["ols"])[1]
    assert "ols" not in refit


def test_prepared_folds(spark, folder):
    prep = prepare_lines(spark, folder, lags=(2, 3), windows=(4,))
    both = prep.train.unionByName(prep.val)
    assert both.where(" or ".join(f"{c} is null" for c in prep.features)).count() == 0
    assert prep.train.agg(F.max("timestamp")).first()[0] < prep.val.agg(F.min("timestamp")).first()[0]
    assert {r.fold for r in prep.summary().collect()} == {"train", "val"}
    known = prepare_lines(spark, folder, lags=(2, 3), windows=(4,), cap_rows=F.col("timestamp") < "2000-01-01")
    assert known.val.count() == prep.val.count()
    raw = prepare_lines(spark, folder, lags=(2, 3), windows=(4,), feature_set="raw")
    assert raw.features == ["hour", "air_temperature", "log_square_feet", "primary_use_code", "meter"]


def test_imputation_experiment(spark, folder):
    out = training.imputation_experiment(
        lambda strategy: prepare_lines(spark, folder, strategy=strategy, lags=(2, 3), windows=(4,)), ["drop", "keep_zeros"], "ols"
    ).collect()
    assert [r.strategy for r in out] == ["drop", "keep_zeros"]
    assert out[0].n_train + out[0].n < out[1].n_train + out[1].n


def test_registered_fits_take_whole_settings(monkeypatch, spark, folder):
    """The queries pass no smaller settings than the defaults, but for the step and the patience of boosted trees where several
    models are fitted, which README lists with the cost of the defaults; the fits themselves are replaced."""
    from meterlake.plans.queries import models as queries

    given = {}
    fake = lambda what: lambda *args, **params: given.update({what: (args, params)}) or spark.range(0).selectExpr("id", "id as train_seconds")
    monkeypatch.setattr(queries.models, "depth_sweep", fake("sweep"))
    for name in ("sample_complexity", "segment_vs_global", "ablation"):
        monkeypatch.setattr(queries.training, name, fake(name))
    monkeypatch.setattr(queries, "scored", fake("scored"))
    for run in (queries.fit_tree_sweep, queries.sample_complexity, queries.segment_vs_global, queries.feature_ablation):
        run(spark, folder)
    assert list(given["sweep"][0][3]) == [4, 8, 16, 24] and given["sweep"][1] == {}
    assert set(given["sample_complexity"][0][1]) == set(models.REGISTRY) and len(given["sample_complexity"][0]) == 2
    assert given["segment_vs_global"][0][4] == "boosted_trees" and set(given["segment_vs_global"][1]) == {"step", "patience"}
    assert set(given["ablation"][0][1]) == set(models.REGISTRY)
    assert all(set(p) == ({"step", "patience"} if m == "boosted_trees" else set()) for m, p in given["ablation"][0][1].items())
    for run in (queries.fit_forest, queries.fit_gbt):
        run(spark, folder)
        assert given["scored"][1] == {}


def test_cut_trees_equal_trees_fitted_to_the_depth(linear):
    _, df = linear
    depths = (0, 1, 2, 4, 9)
    deepest = models.DecisionTree(max_depth=9, min_rows=5).fit(df, NAMES)
    leaves = models.cut_at(deepest.model, depths)
    found = deepest.model.setLeafCol("leaf").transform(deepest._vectors(df)).orderBy("timestamp").select("leaf").collect()
    for k, depth in enumerate(depths):
        own = models.DecisionTree(max_depth=depth, min_rows=5).fit(df, NAMES).predict(df).orderBy("timestamp").toPandas().prediction
        np.testing.assert_allclose([leaves[int(r.leaf)][k] for r in found], own, rtol=1e-12)
    swept = models.depth_sweep(df, df, NAMES, depths, log_target=False, min_rows=5).collect()
    errors = [r.rmse for r in swept]
    assert [r.max_depth for r in swept] == list(depths) and errors == sorted(errors, reverse=True)
    assert [r.train_seconds is None for r in swept] == [True] * 4 + [False]


def test_a_tree_reads_copies_of_a_row_once_and_min_rows_counts_rows(spark, linear):
    df = linear[1]
    many = df.crossJoin(spark.range(30).drop("id"))
    few, all_ = models.DecisionTree(max_depth=4, min_rows=10), models.DecisionTree(max_depth=4, min_rows=300)
    few.fit(df, NAMES), all_.fit(many, NAMES)
    once, again = (m.predict(df).orderBy("timestamp").toPandas().prediction for m in (few, all_))
    np.testing.assert_allclose(once, again, rtol=1e-9)
    n = df.count()
    leaves = all_.predict(many).groupBy("prediction").count().collect()
    assert sum(r["count"] for r in leaves) == 30 * n and min(r["count"] for r in leaves) >= 300
    counts = all_.model._call_java("rootNode").impurityStats()
    assert counts.rawCount() <= n  # as many instances as different rows
    assert models.DecisionTree(max_depth=4, min_rows=n).fit(df, NAMES).model.numNodes == 1


def test_a_forest_stays_within_its_labels(linear):
    from meterlake.plans.prepare import Prepared
    from meterlake.plans.queries import fitted

    df = linear[1]
    found = fitted.within_labels(Prepared(df, df, NAMES, None, None), models.RandomForest(n_trees=5, max_depth=4, min_rows=2)).first()
    assert found["broken"] == 0 and found["n"] == df.count()
