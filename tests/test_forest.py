import numpy as np
import pandas as pd
import pytest

from meterlake.operators import forest, models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 6_000
    x = pd.DataFrame({"a": rng.integers(0, 20, n), "b": rng.integers(0, 6, n) / 4, "c": rng.normal(size=n).round(1)})
    x["label"] = np.where(x.a > 11, 3.0, 0.0) + x.b * (x.a % 3) + rng.normal(scale=0.3, size=n)
    x["id"] = range(n)
    x["timestamp"] = pd.Timestamp("2016-01-01")
    return spark.createDataFrame(x).repartition(5).persist()


def predictions(model, rows):
    return model.transform(rows).orderBy("id").toPandas()["_prediction"].to_numpy()


def test_a_tree_of_all_rows_is_the_plain_tree(rows):
    own = forest.fit(rows, NAMES, "label", trees=1, depth=5, rate=None, min_rows=20, bins=128)
    plain = models.DecisionTree(max_depth=5, min_rows=20, max_bins=128).fit(rows, NAMES)
    want = plain.predict(rows).orderBy("id").toPandas().prediction
    np.testing.assert_allclose(predictions(own, rows), want, rtol=1e-9)
    np.testing.assert_allclose(own.featureImportances, plain.model.featureImportances.toArray(), rtol=1e-6)


def test_upper_levels_and_single_tasks_grow_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(forest, "durable", lambda df: df.localCheckpoint())  # the same chunks for both
    edges, n = forest.cut_points(rows, NAMES, 64)
    written = forest.chunks(rows, NAMES, "label", edges, n, 1)
    monkeypatch.setattr(forest, "chunks", lambda *_: written)
    made = []
    for cells, held, sent in ((1 << 18, 1 << 26, 1 << 27), (150, 5_000, 1_000), (0, 1, 1)):
        for name, value in (("LOCAL_CELLS", cells), ("TASK_BYTES", held), ("SENT_CELLS", sent), ("NODES", 4 if held == 1 else 64)):
            monkeypatch.setattr(forest, name, value)
        made.append(forest.fit(rows, NAMES, "label", trees=3, depth=6, rate=0.5, min_rows=10))
    for other in made[1:]:
        np.testing.assert_allclose(predictions(other, rows), predictions(made[0], rows), rtol=1e-9)
        np.testing.assert_allclose(other.featureImportances, made[0].featureImportances, rtol=1e-9)
        assert [len(t[0]) for t in other.trees] == [len(t[0]) for t in made[0].trees]


def test_every_row_is_drawn_on_its_own(rows):
    edges, n = forest.cut_points(rows, ["b"], 64)
    s = forest.Settings(50, 3, 0.5, 1, 7, [6])
    table = forest._poisson(0.5)
    read = [forest._Chunk(*r, s) for r in forest.chunks(rows, ["b"], "label", edges, n, 7).collect()]
    assert sum(c.counts.sum() for c in read) == n == 6_000
    drawn = np.array([sum(c.draw(t, table)[0].sum() for c in read) for t in range(50)])
    assert abs(drawn.mean() - 3_000) < 30 and 25 < drawn.std() < 90  # the square root of 3,000 is 55
    again = np.array([sum(c.draw(t, table)[0].sum() for c in read) for t in range(50)])
    np.testing.assert_array_equal(drawn, again)


def test_the_job_count_of_a_forest_does_not_grow_with_its_trees(spark, rows):
    def jobs(trees):
        group = f"forest of {trees}"
        spark.sparkContext.setJobGroup(group, group)
        models.RandomForest(n_trees=trees, max_depth=12, min_rows=2, memory_mb=1).fit(rows, NAMES)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(60) == jobs(3)


def test_equal_labels_make_one_leaf_and_nulls_are_refused(spark, rows):
    from pyspark.sql import functions as F

    flat = forest.fit(rows.withColumn("label", F.lit(0.1)), NAMES, "label", trees=3, depth=4)
    assert [len(t[0]) for t in flat.trees] == [1, 1, 1] and set(predictions(flat, rows).round(12)) == {0.1}
    with pytest.raises(Exception, match="null"):
        forest.fit(rows.withColumn("a", F.when(F.col("a") > 3, F.col("a"))), NAMES, "label", trees=2, depth=2)
    with pytest.raises(ValueError):
        forest.fit(rows.limit(0), NAMES, "label", trees=2, depth=2)


def test_a_depth_sweep_keeps_no_tree_of_java_nodes(rows, monkeypatch):
    def refuse(*_):
        raise AssertionError("node by node")

    monkeypatch.setattr(models, "cut_at", refuse)
    swept = models.depth_sweep(rows, rows, NAMES, (2, 5), log_target=False, min_rows=20, max_bins=128).collect()
    for r in swept:
        plain = models.DecisionTree(max_depth=r.max_depth, min_rows=20, max_bins=128).fit(rows, NAMES).predict(rows).toPandas()
        assert r.rmse == pytest.approx(np.sqrt(np.mean((plain.prediction - plain.label) ** 2)), rel=1e-9)


def test_few_cells_go_to_the_tasks_that_grow_trees_at_once(rows, monkeypatch):
    def refuse(*_):
        raise AssertionError("a pass for every level")

    want = predictions(forest.fit(rows, NAMES, "label", trees=2, depth=4, rate=None, min_rows=10), rows)
    monkeypatch.setattr(forest, "_upper_level", refuse)
    found = forest.fit(rows, NAMES, "label", trees=2, depth=4, rate=None, min_rows=10)
    np.testing.assert_allclose(predictions(found, rows), want, rtol=1e-9)


def test_sums_left_by_a_sibling_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 12, (5_000, 3)).astype(np.uint8)
    w = rng.poisson(2, 5_000) + 1.0
    y = w * np.where(cells[:, 0] > 5, 3.0, cells[:, 1]) + rng.normal(size=5_000)
    s = forest.Settings(1, 8, None, 20, 1, [12, 12, 12])
    kept = forest.grow(cells, w, y, 8, s)
    monkeypatch.setattr(forest, "KEPT_SUMS", 0)  # every node added up
    for a, b in zip(kept, forest.grow(cells, w, y, 8, s)):
        np.testing.assert_allclose(a, b, rtol=1e-9)
