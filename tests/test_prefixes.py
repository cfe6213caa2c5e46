"""Linear models on prefixes from moments against separate fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.operators import models, prefixes
from meterlake.operators.split import chrono_prefix

NAMES = ["a", "b", "late", "constant"]
SHARES = [0.1, 0.3, 0.75, 1.0]
MODELS = {
    "ols": {}, "ridge": {}, "lasso": {"alphas": [0.001, 0.05, 5.0]}, "elasticnet": {"alphas": [0.01, 0.5], "l1_ratios": [0.2, 0.9], "cv": 2},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 900
    t = np.sort(rng.integers(0, 300, n))  # hours, many of them several times
    a, b = rng.normal(50, 10, n), rng.normal(0, 0.01, n)
    late = np.where(t > 200, rng.normal(0, 1, n), 3.0)  # constant at first
    y = 1 + 0.05 * a + 20 * b + 0.3 * late + rng.normal(0, 0.5, n)
    stamps = pd.Timestamp("2016-01-01") + pd.to_timedelta(t, "h")
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "late": late, "constant": 1.0, "label": y, "timestamp": stamps}))


def test_every_prefix_equals_a_fit_of_its_own(rows):
    found = prefixes.fit_prefixes(rows, NAMES, MODELS, SHARES)
    assert [(s, m.name) for s, _, m in found] != [] and len(found) == len(SHARES) * len(MODELS)
    for share, n, fitted in found:
        own = chrono_prefix(rows, share)
        assert n == own.count()
        want = models.REGISTRY[fitted.name](**MODELS[fitted.name]).fit(own, NAMES)
        assert fitted.scaler.kept == want.scaler.kept
        np.testing.assert_allclose(list(fitted.model.coefficients), list(want.model.coefficients), rtol=1e-5, atol=1e-7)
        assert fitted.model.intercept == pytest.approx(want.model.intercept, rel=1e-8)
        if fitted.name != "ols":
            assert fitted.chosen == want.chosen
        pair = fitted.predict(own).select("prediction", prefixes.predicted(fitted).alias("p")).toPandas()
        np.testing.assert_allclose(pair.prediction, pair.p, rtol=1e-9)


def test_one_row_and_repeated_times(rows):
    same = rows.withColumn("timestamp", F.lit("2016-01-01").cast("timestamp"))
    for share, n, fitted in prefixes.fit_prefixes(same, NAMES, {"ols": {}}, [0.1, 1.0]):
        assert n == 900  # rows of the last time stay together
    (_, n, fitted), = prefixes.fit_prefixes(rows.limit(1), NAMES, {"ridge": {}}, [0.5])
    assert n == 1 and fitted.scaler.kept == []
