"""Forests, lines and boosting of growing prefixes share what does not differ between them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions.metrics import score_columns
from meterlake.operators import boosting, forest, prefixes, split
from meterlake.operators.series import Series
from meterlake.plans import training
from meterlake.plans.prepare import Prepared

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 4_000
    x = pd.DataFrame({"a": rng.integers(0, 20, n), "b": rng.integers(0, 6, n) / 4, "c": rng.normal(size=n).round(1)})
    x["label"] = np.where(x.a > 11, 3.0, 0.0) + x.b * (x.a % 3) + rng.normal(scale=0.3, size=n)
    x["id"], x["part"] = range(n), np.arange(n) // 1_600  # groups of 1,600, 3,200 and 4,000 rows
    x.loc[x.part == 0, "a"] = x.a // 2 * 2  # the smallest group has other bins
    x["timestamp"] = pd.date_range("2016-01-01", periods=n, freq="h")
    return spark.createDataFrame(x).repartition(5).persist()


def predictions(model, rows):
    return model.transform(rows).orderBy("id").toPandas()["_prediction"].to_numpy()


@pytest.mark.parametrize("bins, local", [(128, 1 << 19), (16, 50)])
def test_a_group_has_the_trees_of_its_own_rows(rows, monkeypatch, bins, local):
    monkeypatch.setattr(forest, "LOCAL_CELLS", local)
    nested = forest.Nested(rows, NAMES, "label", "part", 3, bins)
    coded, different = nested.coded(rows, "id")
    for k in range(3):
        alone = forest.fit(rows.where(F.col("part") <= k), NAMES, "label", trees=1, depth=5, rate=None, min_rows=20, bins=bins)
        made = nested.fit(k, trees=1, depth=5, rate=None, min_rows=20)
        assert [e.tolist() for e in made.edges] == [e.tolist() for e in alone.edges]
        want = predictions(alone, rows)
        np.testing.assert_allclose(predictions(made, rows), want, rtol=1e-9)
        np.testing.assert_allclose(made.of_coded(coded, different).orderBy("id").toPandas()["_prediction"], want, rtol=1e-9)
        np.testing.assert_allclose(made.featureImportances, alone.featureImportances, rtol=1e-9)


def test_more_than_256_common_bins_take_two_bytes(spark):
    x = pd.DataFrame({"a": np.arange(3_000.0), "label": np.sin(np.arange(3_000) / 200), "id": range(3_000), "part": np.arange(3_000) // 1_000})
    wide = spark.createDataFrame(x)
    nested = forest.Nested(wide, ["a"], "label", "part", 3, 250)
    assert len(nested.common[0]) > 256
    made, alone = nested.fit(2, trees=1, rate=None), forest.fit(wide, ["a"], "label", trees=1, rate=None, bins=250)
    want = predictions(alone, wide)
    np.testing.assert_allclose(made.of_coded(*nested.coded(wide, "id")).orderBy("id").toPandas()["_prediction"], want, rtol=1e-9)


def test_every_row_of_a_group_is_drawn_on_its_own_whatever_the_order(rows):
    nested = forest.Nested(rows, ["b"], "label", "part", 3)
    again = forest.Nested(rows.orderBy(F.desc("id")), ["b"], "label", "part", 3)
    table = forest._poisson(0.5)
    for k, n in enumerate((1_600, 3_200, 4_000)):
        s = forest.Settings(50, 3, 0.5, 1, 7, [6], k, nested._places(k))
        read = [[forest._NestedChunk(*r[:-1], s) for r in x.chunks.orderBy("chunk").collect()] for x in (nested, again)]
        assert sum(c.counts.sum() for c in read[0]) == n and nested.rows[k] == n and nested.cells[k] == 6
        drawn = [[sum(c.draw(t, table)[0].sum() for c in x) for t in range(50)] for x in read]
        assert drawn[0] == drawn[1] and abs(np.mean(drawn[0]) - n / 2) < 0.03 * n and np.std(drawn[0]) > 0.3 * np.sqrt(n / 2)


def test_a_cell_of_very_many_rows_is_spread(rows, monkeypatch):
    monkeypatch.setattr(forest, "MAP_ROWS", 400)
    one = forest.Nested(rows.withColumn("b", F.lit(1.0)), ["b"], "label", "part", 3)
    ends = [r["ends"] for r in one.chunks.collect()]
    assert len(ends) > 4 and sum(e[-1] for e in ends) == 4_000 and max(e[-1] for e in ends) < 2_000


def test_prefixes_are_cut_and_dealt_out_once(spark, rows, monkeypatch):
    calls = {"quantiles": 0, "chunks": 0}
    real, real_chunks = split.global_quantiles, forest.Nested._chunks
    monkeypatch.setattr(split, "global_quantiles", lambda *a, **k: calls.update(quantiles=calls["quantiles"] + 1) or real(*a, **k))
    monkeypatch.setattr(forest.Nested, "_chunks", lambda *a: calls.update(chunks=calls["chunks"] + 1) or real_chunks(*a))
    prep = Prepared(rows, rows, NAMES, None, Series(("id",)), log_target=False)
    models = {"random_forest": {"n_trees": 3, "max_depth": 4}, "decision_tree": {"max_depth": 4}, "ols": {}}
    found = training.sample_complexity(prep, models, (0.2, 0.5, 1.0)).collect()
    assert sorted((r.model, r.fraction, r.n_train) for r in found) == [(m, s, n) for m in ("decision_tree", "ols", "random_forest") for s, n in ((0.2, 800), (0.5, 2_000), (1.0, 4_000))]
    assert calls == {"quantiles": 1, "chunks": 1} and all(r.n == 4_000 and r.rmse < 2.5 for r in found)
    whole = {r.model: r.rmse for r in found if r.fraction == 1.0}
    assert whole["random_forest"] == pytest.approx(whole["decision_tree"], rel=0.5)


def test_cuts_are_those_of_lone_prefixes(rows):
    late = rows.withColumn("timestamp", F.when(F.col("id") % 10 > 0, F.date_trunc("day", "timestamp")))
    for least in (1, 900):
        for share, (cut, n) in zip((0.1, 0.33, 1.0), split.chrono_cuts(late, (0.1, 0.33, 1.0), at_least=least)):
            alone = split.chrono_prefix(late, share, at_least=least)
            mine = late if cut is None else late.where(split.seconds("timestamp") <= cut)
            assert n == alone.count() and mine.exceptAll(alone).isEmpty()


@pytest.mark.parametrize("log_target", [True, False])
def test_scores_of_lines_are_those_of_single_passes(rows, log_target):
    val = rows.withColumns({"label": F.when(F.col("id") % 7 > 0, F.col("label")), "b": F.when(F.col("id") % 5 > 0, F.col("b"))})
    fitted = [m for _, _, m in prefixes.fit_prefixes(rows, NAMES, {"ols": {}, "lasso": {}}, [0.3, 1.0])]
    found = {r["_k"]: r for r in prefixes.scores(fitted, val, log_target=log_target).collect()}
    for k, m in enumerate(fitted):
        scored = training.real_scale(val.withColumn("p", prefixes.predicted(m)), prediction="p", log_target=log_target)
        want = scored.agg(F.count(F.lit(1)).alias("n"), *score_columns()).first()
        assert found[k].n == want.n == 4_000
        np.testing.assert_allclose([found[k][c] for c in ("rmse", "mae", "cv_rmse", "rmsle")], [want[c] for c in ("rmse", "mae", "cv_rmse", "rmsle")], rtol=1e-9)
    assert prefixes.scores(fitted, val.limit(0)).count() == 0


def test_cells_of_plain_columns_are_those_of_arrays(spark, rows, monkeypatch):
    def cells():
        made = boosting._cells(rows, F.col("id") % 4 == 0, "x", "label", True, NAMES)
        return sorted((tuple(r.x.toArray()), r._n, round(r._sum, 9), round(r._held_squares, 9), tuple(sorted(r._labels))) for r in made.collect())

    few = cells()
    monkeypatch.setattr(boosting, "ARRAY_ROWS", 0)
    assert cells() == few and sum(c[1] for c in few) == 3_000
    with pytest.raises(ValueError, match="null"):
        boosting._cells(rows.withColumn("a", F.when(F.col("a") > 3, F.col("a"))), F.lit(False), "x", "label", True, NAMES)
