"""Trees of all segments together against separate fits and a plain numpy fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.operators import segment_trees as st
from meterlake.plans import training


def frame(n=600, seed=0):
    rng = np.random.default_rng(seed)
    segment = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    x, z = rng.integers(0, 8, n).astype(float), rng.normal(size=n).round(3)
    y = np.where(segment == "a", x, -2 * z) + (x > 3) * 2 + rng.normal(0, 0.3, n)
    return pd.DataFrame({"seg": segment, "x": x, "z": z, "label": y, "held": rng.random(n) < 0.2})


def plain(pdf, edges, rounds, step, depth, min_rows):
    """Predictions of all rows after each round, for one segment, node by node."""
    x = np.column_stack([np.searchsorted(e, pdf[c], side="left") for c, e in zip(("x", "z"), edges)])
    y, train = pdf.label.to_numpy(), ~pdf.held.to_numpy()
    score = np.full(len(y), y[train].mean())
    out = [score.copy()]

    def grow(rows, level, left):
        here = rows & train
        if level == depth:
            return np.where(rows, left[here].mean() if here.any() else 0.0, 0.0)
        best = (1e-12, None)
        for f in range(2):
            for b in range(256):
                lo = here & (x[:, f] <= b)
                hi = here & (x[:, f] > b)
                if lo.sum() >= min_rows and hi.sum() >= min_rows:
                    gain = left[lo].sum() ** 2 / lo.sum() + left[hi].sum() ** 2 / hi.sum() - left[here].sum() ** 2 / here.sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
        if best[1] is None:
            return grow(rows, depth, left)
        f, b = best[1]
        return grow(rows & (x[:, f] <= b), level + 1, left) + grow(rows & (x[:, f] > b), level + 1, left)

    for _ in range(rounds):
        score = score + step * grow(np.ones(len(y), bool), 0, y - score)
        out.append(score.copy())
    return out


EDGES = [[float(v) for v in range(7)], [-1.0, -0.5, 0.0, 0.5, 1.0]]
SETTINGS = dict(rounds=4, patience=10, step=0.5, depth=2, min_rows=5)


def test_equal_plain_fits_and_keep_the_best_round(spark):
    pdf = frame()
    model = st.fit(spark.createDataFrame(pdf).repartition(3), ["x", "z"], "seg", held=F.col("held"), edges=EDGES, **SETTINGS)
    losses = model.losses.toPandas().set_index(["_segment", "round"]).loss
    best = model.starts.toPandas().set_index("_segment").best
    got = st.predict(model, spark.createDataFrame(pdf.reset_index()), "seg").toPandas().set_index("index").prediction
    for name, part in pdf.groupby("seg"):
        want = plain(part, EDGES, 4, 0.5, 2, 5)
        held = part.held.to_numpy()
        expected = [((part.label.to_numpy() - s)[held] ** 2).mean() for s in want]
        np.testing.assert_allclose([losses[name, r] for r in range(5)], expected, rtol=1e-9)
        assert best[name] == int(np.argmin(expected))
        np.testing.assert_allclose(got[part.index], want[best[name]], rtol=1e-9)
    assert set(st.importances(model).toPandas().feature) == {"x", "z"}


def test_together_equals_alone(spark):
    pdf = frame(300, seed=3)
    together = st.fit(spark.createDataFrame(pdf), ["x", "z"], "seg", edges=EDGES, **SETTINGS | {"rounds": 2}).losses.toPandas()
    for name, part in pdf.groupby("seg"):
        alone = st.fit(spark.createDataFrame(part), ["x", "z"], "seg", edges=EDGES, **SETTINGS | {"rounds": 2}).losses.toPandas()
        both = together[together._segment == name].merge(alone, on="round")
        np.testing.assert_allclose(both.loss_x, both.loss_y, rtol=1e-9)


def test_thousands_of_segments(spark):
    rows = spark.range(40_000).select((F.col("id") % 10_000).alias("seg"), (F.col("id") % 4 % 2).cast("double").alias("x"), F.expr("id div 10000 % 2").cast("double").alias("z"))
    rows = rows.withColumn("label", F.col("z") * (F.col("seg") + 1))
    model = st.fit(rows, ["x", "z"], "seg", rounds=1, step=1.0, depth=1, min_rows=1, edges=[[0.0], [0.0]])
    off = st.predict(model, rows, "seg").where(F.abs(F.col("prediction") - F.col("label")) > 1e-6)
    assert model.starts.count() == 10_000 and off.count() == 0


def test_nulls_empty_and_bad_settings(spark):
    rows = spark.createDataFrame([(None, None, 1.0), (None, 2.0, 3.0), ("a", 1.0, 5.0), ("a", float("nan"), 5.0), ("b", 1.0, None)], "seg string, x double, label double")
    model = st.fit(rows, ["x"], "seg", rounds=2, step=1.0, depth=2, min_rows=1, edges=[[1.0]])
    got = sorted((r.seg or "", r.prediction) for r in st.predict(model, rows, "seg").collect())
    assert got == [("", 1.0), ("", 3.0), ("a", 5.0), ("a", 5.0)]  # a segment without a label is not known
    none = st.fit(rows.limit(0), ["x"], "seg", rounds=2, edges=[[1.0]])
    assert st.predict(none, rows, "seg").count() == 0
    with pytest.raises(ValueError):
        st.fit(rows, ["x"], "seg", depth=0)
    with pytest.raises(ValueError):
        st.fit(rows, ["x"], "seg", edges=[[1.0], [2.0]])


def test_own_trees_beat_one_model_where_segments_differ(spark):
    pdf = pd.DataFrame({"seg": np.repeat(["up", "down", "rare"], [300, 300, 5]), "x": np.tile(np.arange(55.0), 11), "z": 0.0})
    pdf["label"] = np.where(pdf.seg == "up", pdf.x, 60 - pdf.x) / 10
    pdf["timestamp"] = pd.Timestamp("2016-01-01") + pd.to_timedelta(np.arange(len(pdf)) * 7919 % 605, unit="h")
    rows = spark.createDataFrame(pdf)
    found = training.segments_together(rows, rows.withColumn("meter_reading", F.expm1("label")), ["x", "z"], "seg", 50, rounds=3, step=0.5, min_rows=5)
    out = training.compare_segments(found, "seg").toPandas().set_index("seg")
    assert out.loc["up", "rmse_own"] < 0.5 * out.loc["up", "rmse_global"]
    assert np.isnan(out.loc["rare", "rmse_own"]) and out.loc["rare", "n_global"] == 5


@pytest.mark.parametrize("patience", [1, 3])
def test_one_task_and_rounds_of_jobs_give_the_same_trees(spark, monkeypatch, patience):
    pdf = frame(500, seed=5)
    pdf.loc[pdf.seg == "c", "held"] = False  # judged by its training rows
    rows = spark.createDataFrame(pdf)
    settings = SETTINGS | {"rounds": 6, "patience": patience, "step": 1.0, "min_rows": 1}
    fits = []
    for most in (1_000_000, 200, 0):  # all in tasks, the smaller ones only, none
        monkeypatch.setattr(st, "LOCAL_ROWS", most)
        fits.append(st.fit(rows, ["x", "z"], "seg", held=F.col("held"), edges=EDGES, **settings))
    table = lambda df, *by: df.toPandas().sort_values(list(by)).reset_index(drop=True)
    for other in fits[1:]:
        pd.testing.assert_frame_equal(table(fits[0].losses, "_segment", "round"), table(other.losses, "_segment", "round")[fits[0].losses.columns], check_dtype=False)
        pd.testing.assert_frame_equal(table(fits[0].starts, "_segment"), table(other.starts, "_segment"))
        pd.testing.assert_frame_equal(table(fits[0].trees, "_segment", "round"), table(other.trees, "_segment", "round")[fits[0].trees.columns])


def test_rounds_of_small_segments_take_no_jobs_of_their_own(spark):
    rows = spark.createDataFrame(frame(300, seed=6))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for rounds in (2, 8):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        st.fit(rows, ["x", "z"], "seg", held=F.col("held"), edges=EDGES, **SETTINGS | {"rounds": rounds})
        jobs.append(len(tracker.getJobIdsForGroup(f"rounds {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 2
