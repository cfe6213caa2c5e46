"""Values and sessions at the edges: infinities, huge ranges, whole histograms, raw targets, sessions without a folder."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake import session
from meterlake.operators import explore
from meterlake.operators.models import REGISTRY
from meterlake.operators.quantiles import group_quantiles
from meterlake.operators.series import Series
from meterlake.plans import training
from meterlake.plans.prepare import Prepared


@pytest.mark.parametrize(
    "given",
    [
        [float("inf")] * 30 + [float("-inf")] * 20 + list(range(50)),
        [1.7e308, -1.7e308] * 40 + [0.0, 1e-300, -1e-300],
        list(np.random.default_rng(2).normal(0, 1, 300) ** 9),
        [5.0] * 100,
        [None, float("nan"), *range(60)],
        [float("inf")] * 40,
    ],
)
def test_counting_ends_and_equals_percentile(spark, given):
    rows = [(k % 2, None if v is None else float(v)) for k, v in enumerate(given)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    plain, counted = (
        {r.g: r.q for r in group_quantiles(df, ["g"], "v", probs, large_rows=n).collect()} for n in (10_000, 3)
    )
    assert plain.keys() == counted.keys()
    for g in plain:
        np.testing.assert_array_equal(plain[g], counted[g])


def test_histogram_counts_all_positive_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (0.01, 0.5, 1, 10, 9_999, 10_000, 12_345, 1e9)], "v double")
    bins = {r.bin: r.n for r in explore.log_spaced_histogram(df, "v").collect()}
    assert bins[-1] == 2 and bins[49] == 2 and sum(bins.values()) == 8


def test_density_of_nothing_and_of_large_values(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert explore.density_by(df, "g", "v").collect() == []
    rows = [("a", 1e9 + float(x)) for x in np.random.default_rng(1).normal(0, 1, 400)]
    out = explore.density_by(spark.createDataFrame(rows, "g string, v double"), "g", "v").toPandas().sort_values("x")
    area = np.trapezoid(out.density, out.x)
    assert 0.9 < area < 1.05


@pytest.mark.parametrize("log_target", [True, False])
def test_models_of_raw_and_log_targets_score_on_readings(spark, log_target):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, 300)
    y = 5000 + 9000 * x + rng.normal(0, 50, 300)
    rows = [(int(k % 3), int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "building_id int, timestamp int, x double, meter_reading double")
    df = df.withColumn("label", F.log1p("meter_reading") if log_target else F.col("meter_reading"))
    prep = Prepared(df.where("timestamp < 200"), df.where("timestamp >= 200"), ["x"], None, Series(("building_id",)), log_target)
    score = training.score_model(REGISTRY["ols"](), prep)
    assert 10 < score["rmse"] < 1500 and score["n"] == 100


def test_holidays_of_any_year(spark):
    from meterlake.operators.features import with_holiday_flag

    days = ["1950-07-04", "2041-07-04", "2041-07-08", "2100-12-25"]
    df = spark.createDataFrame([(d,) for d in days], "t string").withColumn("timestamp", F.col("t").cast("timestamp"))
    assert {r.t: r.is_holiday for r in with_holiday_flag(df).collect()} == {"1950-07-04": 1, "2041-07-04": 1, "2041-07-08": 0, "2100-12-25": 1}


def test_segments_without_a_model_keep_their_row(spark):
    rows = [("a", "own", 1.0, 2.0), ("a", "global", 1.0, 4.0), ("b", "global", 3.0, 3.0), (None, "global", 1.0, 1.0), (None, "own", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "segment string, model string, y_true double, y_pred double")
    got = {(r.segment, r.pooled): r for r in training.compare_segments(df, "segment").collect()}
    assert set(got) == {("a", False), ("b", False), (None, False), (None, True)}
    assert got["b", False].n_own is None and got["b", False].rmse_global == 0
    assert got[None, True].n_own == got[None, True].n_global == 2 and got["a", False].gain == 2


PLAIN = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {repo!r})
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as entry
print("ROWS", entry.queries()["join_context"](spark, {folder!r}).count(), entry.queries()["te_fit"](spark, {folder!r}).count())
"""


def test_queries_run_in_a_session_that_names_no_folder(folder, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    code = PLAIN.format(repo=repo, folder=folder)
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


class Cluster:
    """What `shared_folder` asks of a session."""

    def __init__(self, master, **settings):
        self.sparkContext, self.conf, self.master, self.settings = self, self, master, settings

    def get(self, key, default):
        return self.settings.get(key, default)


def test_a_cluster_has_to_name_a_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster("local-cluster[2,1,1024]"))
    assert session.shared_folder(Cluster("yarn", **{session.SHARED: "hdfs:///x"})) == "hdfs:///x"
    assert session.shared_folder(Cluster("yarn", **{"spark.checkpoint.dir": "s3://y"})) == "s3://y"
    assert session.shared_folder(Cluster("local[*]")).endswith("meterlake")
