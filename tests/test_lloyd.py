"""K-means of several k at once against plain iterations."""

import numpy as np
import pandas as pd
import pytest

from meterlake.operators import lloyd

COLUMNS = ["a", "b"]


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS)).repartition(3)


def blobs(n=240, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.3, (n // 4, 2)) for c in ((0, 0), (5, 0), (0, 5), (9, 9))])


def plain(x, centres, rounds=300):
    for done in range(1, rounds + 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        label = d.argmin(1)
        after = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.abs(after - centres).max() <= 1e-9:
            return centres, d.min(1).sum(), done
        centres = after


def test_all_k_together_equal_each_alone(spark):
    x = blobs()
    first = lloyd.seeds(frame(spark, x), COLUMNS, 6)
    centres, cost, n_iter = lloyd.settle(frame(spark, x), COLUMNS, {k: first[:k] for k in (1, 2, 4, 6)})
    for k in (1, 2, 4, 6):
        want, inertia, done = plain(x, first[:k])
        np.testing.assert_allclose(centres[k], want, rtol=1e-9, atol=1e-9)
        assert cost[k] == pytest.approx(inertia, rel=1e-9) and n_iter[k] == done


def test_seeds_lie_far_apart(spark):
    found = lloyd.seeds(frame(spark, blobs()), COLUMNS, 4)
    assert len({(round(a / 5), round(b / 5)) for a, b in found}) == 4
    assert len(lloyd.seeds(frame(spark, [[1, 1]] * 5 + [[2, 2]]), COLUMNS, 4)) == 2


def test_costs_never_rise_with_k(spark):
    x = np.random.default_rng(4).uniform(0, 1, (150, 2))
    _, cost, n_iter = lloyd.fit_all(frame(spark, x), COLUMNS, range(2, 9))
    assert [cost[k] for k in range(2, 9)] == sorted(cost.values(), reverse=True) and min(n_iter.values()) >= 2


def test_a_worse_start_is_mended_from_fewer_clusters(spark, monkeypatch):
    x = blobs()
    bad = np.array([[9, 9], [0, 0], [5, 0], [100, 100], [101, 101]], float)  # the last two are nobody's
    monkeypatch.setattr(lloyd, "seeds", lambda *_: bad)
    _, cost, _ = lloyd.fit_all(frame(spark, x), COLUMNS, [3, 4, 5])
    assert cost[5] <= cost[4] <= cost[3]


def test_few_distinct_profiles_and_none(spark):
    centres, cost, _ = lloyd.fit_all(frame(spark, [[1, 1]] * 5 + [[2, 2]] * 3), COLUMNS, [2, 5])
    assert cost == {2: 0.0, 5: 0.0} and len(centres[5]) == 2
    for rows in ([[1, 1]] * 4,):
        with pytest.raises(ValueError):
            lloyd.fit_all(frame(spark, rows), COLUMNS, [2])
    with pytest.raises(ValueError):
        lloyd.fit_all(spark.createDataFrame([], "a double, b double"), COLUMNS, [2])
    with pytest.raises(ValueError):
        lloyd.fit_all(frame(spark, [[1, 1], [2, 2]]), COLUMNS, [0])
