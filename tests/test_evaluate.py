import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions.scalars import clip, clip_real, from_log, no_nan, to_log
from meterlake.operators import evaluate, explore, joins, sampling


def pairs(spark, true, pred):
    return spark.createDataFrame(list(zip(map(float, true), map(float, pred))), "y_true double, y_pred double")


def test_errors_equal_numpy(spark):
    rng = np.random.default_rng(41)
    true, pred = rng.gamma(2, 30, 250), rng.gamma(2, 30, 250) - 8
    got = evaluate.score_overall(pairs(spark, true, pred)).first()
    gap = true - pred
    log_gap = np.log1p(np.maximum(pred, 0)) - np.log1p(true)
    want = (250, np.sqrt((gap**2).mean()), abs(gap).mean(), np.sqrt((gap**2).mean()) / true.mean(), np.sqrt((log_gap**2).mean()))
    assert tuple(got[c] for c in ("n", "rmse", "mae", "cv_rmse", "rmsle")) == pytest.approx(want, rel=1e-12)
    same = evaluate.score_overall(pairs(spark, true, true)).first()
    assert same.rmse == same.mae == same.cv_rmse == same.rmsle == 0


def test_errors_scale_with_the_unit(spark):
    rng = np.random.default_rng(42)
    true, pred = rng.uniform(5, 6, 40), rng.uniform(4, 7, 40)
    a = evaluate.score_overall(pairs(spark, true, pred)).first()
    b = evaluate.score_overall(pairs(spark, 1000 * true, 1000 * pred)).first()
    assert (b.rmse, b.mae, b.cv_rmse) == pytest.approx((1000 * a.rmse, 1000 * a.mae, a.cv_rmse))
    balanced = evaluate.score_overall(pairs(spark, [-4, 4, 0], [1, 1, 1])).first()
    assert balanced.cv_rmse is None  # the mean of the actual values is 0


def test_scores_of_nothing_are_null(spark):
    empty = evaluate.score_overall(pairs(spark, [], [])).first()
    assert empty.n == 0 and empty.rmse is None


def test_negative_values_count_as_zero_in_rmsle(spark):
    assert evaluate.score_overall(pairs(spark, [-5], [0])).first().rmsle == 0


def test_clips_keep_null(spark):
    row = spark.range(1).select(
        clip(F.lit(None).cast("double"), 0, 1).alias("a"), clip(F.lit(5.0), 0, 1).alias("b"), from_log(F.lit(99.0)).alias("c"),
        clip_real(F.lit(1e12)).alias("d"), to_log(F.lit(-3.0)).alias("e"), no_nan(F.lit(float("nan"))).alias("f"),
    ).first()
    assert row.a is None and row.b == 1 and row.e == 0 and row.f is None
    assert row.c == pytest.approx(np.expm1(14)) and row.d == pytest.approx(np.expm1(14))


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame(
        {"model": rng.choice(["a", "b"], 400), "primary_use": rng.choice(["x", "y", "z"], 400), "meter": rng.integers(0, 4, 400),
         "site_id": rng.integers(0, 3, 400), "y_true": rng.uniform(1, 9, 400)}
    )
    rows["y_pred"] = rows.y_true + rng.normal(0, 1, 400)
    return spark.createDataFrame(rows)


def test_report_equals_separate_scores(predictions):
    named = evaluate.with_meter_name(predictions)
    report = evaluate.evaluate_report(named, ["primary_use", "meter_name", "site_id"])
    got = {(r.group_kind, r.group): (r.n, r.rmse, r.mae) for r in report.collect()}
    assert len(got) == 3 + 4 + 3 + 1
    overall = evaluate.score_overall(predictions).first()
    assert got["overall", None] == pytest.approx((overall.n, overall.rmse, overall.mae))
    for kind, table in (("primary_use", evaluate.score_by_use(predictions)), ("meter_name", evaluate.score_by_meter(predictions)),
                        ("site_id", evaluate.score_by_site(predictions))):
        for r in table.collect():
            assert got[kind, str(r[kind])] == pytest.approx((r.n, r.rmse, r.mae))


def test_rows_without_a_group_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), ("u", 1.0, 1.0)], "primary_use string, y_true double, y_pred double")
    assert [r.primary_use for r in evaluate.score_by_use(df).collect()] == ["u"]
    kinds = [(r.group_kind, r.n) for r in evaluate.evaluate_report(df, ["primary_use"]).orderBy("n").collect()]
    assert kinds == [("primary_use", 1), ("overall", 2)]


def test_scores_are_sorted(predictions):
    rmse = [r.rmse for r in evaluate.score_by_site(predictions).collect()]
    assert rmse == sorted(rmse)


def test_failure_tables(predictions):
    report = evaluate.evaluate_report(predictions, ["primary_use"], ["model"])
    assert evaluate.failure_long(report).count() == 2 * 3 * 3
    pivot = evaluate.failure_pivot(report, "primary_use", ["a", "b"]).collect()
    assert len(pivot) == 3 and all(r.a > 0 and r.b > 0 for r in pivot)
    assert evaluate.worst_groups(report, 2).count() == 4
    best = evaluate.best_model(report.where("group_kind = 'overall'"), excluded=("b",)).first()
    assert best.model == "a"
    assert [r.model for r in evaluate.nested_report(report).orderBy("model").collect()] == ["a", "b"]


def test_worst_meters(predictions):
    out = evaluate.worst_meters(predictions, ["meter"], ["primary_use"]).collect()
    assert [r.rmse for r in out] == sorted((r.rmse for r in out), reverse=True)
    for r in out:
        assert r.variance_component == pytest.approx(np.sqrt(r.rmse**2 - r.bias**2), rel=1e-9)


def test_cases_fall_back_to_the_smallest_errors(predictions):
    hits = evaluate.pick_cases(predictions, F.col("abs_err") < 0.2, True, F.lit(True), 5)
    assert hits.where("abs_err >= 0.2").count() == 0 and hits.count() > 5
    none = evaluate.pick_cases(predictions, F.col("y_true") > 1e9, True, F.col("meter") == 1, 5)
    assert none.count() == 5 and none.where("meter <> 1").count() == 0


def test_compare_runs_keeps_common_models(spark):
    a = spark.createDataFrame([("m", 8.0), ("only", 1.0)], "model string, rmse double")
    b = spark.createDataFrame([("m", 10.0), ("other", 1.0)], "model string, rmse double")
    assert [tuple(r) for r in joins.compare_runs(a, b).collect()] == [("m", 8.0, 10.0, 2.0, 20.0)]


def test_box_stats_equal_pandas(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, 200), 15, -20]
    out = explore.box_stats(spark.createDataFrame([("g", float(v)) for v in x], "g string, x double"), "g", "x").first()
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert (out.q1, out["median"], out.q3, out.low, out.high) == pytest.approx((q1, q2, q3, inside.min(), inside.max()))


def test_histogram_equals_numpy(spark):
    x = np.random.default_rng(6).normal(0, 1, 500)
    out = {r.bin: r.n for r in explore.histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 12).collect()}
    counts, _ = np.histogram(x, 12)
    assert [out.get(i, 0) for i in range(12)] == counts.tolist()
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert explore.histogram(same, "x", 4).agg(F.sum("n")).first()[0] == 2
    assert explore.histogram(same.where("x > 5"), "x", 4).count() == 0


def test_correlation_skips_nulls_by_pair(spark):
    rows = pd.DataFrame({"a": [1, 2, 3, 4, 5.0], "b": [2, 1, 4, 3, None], "c": [5, 3, None, 1, 0.0]})
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "a double, b double, c double")
    want = rows.corr()
    for r in explore.correlation_matrix(df).collect():
        assert r["corr"] == pytest.approx(want.loc[r.a, r.b])


def test_samples_are_stable_and_bounded(spark):
    df = spark.range(5000).withColumn("meter", (F.col("id") % 7 == 0).cast("int"))
    one = sampling.sample_n(df, 100, ["id"]).select("id").collect()
    again = sampling.sample_n(df.repartition(13), 100, ["id"]).select("id").collect()
    assert sorted(one) == sorted(again) and len(one) == 100
    capped = {r.meter: r["count"] for r in sampling.cap_per_stratum(df, ["meter"], 900, ["id"]).groupBy("meter").count().collect()}
    assert capped == {0: 900, 1: 715}
    keys = sampling.sample_stratified_keys(df, ["id", "meter"], "meter", 70)
    assert {r.meter: r["count"] for r in keys.groupBy("meter").count().collect()} == {0: 60, 1: 10}
    few = sampling.sample_stratified_keys(df.limit(30), ["id", "meter"], "meter", 1)
    assert few.count() == 1
