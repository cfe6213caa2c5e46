"""Boosted regression trees that keep their best round.

Every round fits one tree, on a sample of rows and features, to what the trees so far leave of the label. Rows of equal
features have equal scores, so they are kept as one weighted cell, from which each row is drawn on its own. The score of every
cell is kept beside it, so that one pass adds a tree and gives the loss on the held-out rows after that round. Fitting stops
when no round has been better for `patience` rounds, and the model is cut after the best one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import durable

ROUNDS_PER_WRITE = 20  # after so many rounds the scores are written, which cuts the lineage
CELL_ROWS = 1024  # labels of one row of the cells, about
ARRAY_ROWS = 5_000_000  # more rows are grouped by plain columns, which Spark compares faster than arrays; cells, and so draws, come in another order


def as_model(
    trees: list[DecisionTreeRegressionModel], weights: list[float], n_features: int, features: str, prediction: str
) -> GBTRegressionModel:
    """The weighted sum of these trees as one model."""
    context = SparkContext._active_spark_context
    gateway, jvm = context._gateway, context._jvm
    java_trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    java_weights = gateway.new_array(jvm.double, len(weights))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        java_trees[k], java_weights[k] = tree._java_obj, float(weight)
    java = jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boosted_{len(trees)}", java_trees, java_weights, n_features)
    return GBTRegressionModel(java).setFeaturesCol(features).setPredictionCol(prediction)


def weighted_leaves(min_rows: int, rows: float, depth: int) -> dict:
    """Settings of a tree on weighted cells, none of whose leaves stands for fewer than `min_rows` of the `rows` rows."""
    share = max(0.0, (min_rows - 0.5) / rows)
    # where not even two such leaves fit, there is nothing to split
    return {"minInstancesPerNode": 1, "minWeightFractionPerNode": share, "maxDepth": depth} if share < 0.5 else {"minInstancesPerNode": 1, "maxDepth": 0}


def _cells(rows: DataFrame, held: Column, features: str, label: str, keep: bool, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of equal features as one.

    A cell has the number and sum of its training labels and, where `keep`, the labels themselves, at most about
    `CELL_ROWS` of them: larger cells are several. It also has number, sum and sum of squares of the held-out labels, or of
    all where none is held out. All labels are less the mean. Where `columns` are named, rows have the features there, and only
    the cells get vectors.
    """
    x = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)] if columns else [vector_to_array(features).alias("_x")]
    names = [f"_x{k}" for k in range(len(columns))] if columns else ["_x"]
    strange = reduce(or_, [F.col(c).isNull() | F.isnan(c) for c in names]) if columns else F.lit(False)
    plain = rows.select(*x, F.col(label).cast("double").alias("_y"), F.coalesce(held, F.lit(False)).alias("_held"))
    train = ~F.col("_held")
    found = plain.agg(F.count(F.lit(1)), F.count("_y"), F.count_if("_held"), F.count_if(train), F.avg(F.when(train, F.col("_y"))), F.count_if(strange)).first()
    n, known, n_held, n_train, start, n_strange = found
    if known < n:
        raise ValueError("a label is null")
    if n_strange:
        raise ValueError("a feature is null")
    if not n_train:
        raise ValueError("no rows to fit")
    if columns and n <= ARRAY_ROWS:
        plain, names = plain.withColumn("_x", F.array(*names)).drop(*names), ["_x"]
    part = F.lit(0)
    if keep:
        large = durable(plain.groupBy(*names).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > CELL_ROWS))
        plain = plain.join(large, names, "left")
        part = F.coalesce(F.floor(F.rand(1) * F.ceil(F.col("_size") / CELL_ROWS)), F.lit(0))
    judged = F.col("_held") if n_held else F.lit(True)
    y = F.col("_y") - float(start)
    sums = [
        F.count_if(train).cast("double").alias("_n"), F.coalesce(F.sum(F.when(train, y)), F.lit(0.0)).alias("_sum"),
        F.count_if(judged).cast("double").alias("_held_n"), F.coalesce(F.sum(F.when(judged, y)), F.lit(0.0)).alias("_held_sum"),
        F.coalesce(F.sum(F.when(judged, y * y)), F.lit(0.0)).alias("_held_squares"),
    ]
    sums += [F.collect_list(F.when(train, y)).alias("_labels")] if keep else []
    made = durable(plain.groupBy(*names, part.alias("_part")).agg(*sums).withColumn("_id", F.monotonically_increasing_id()))
    vector = array_to_vector(F.col("_x") if names == ["_x"] else F.array(*names))
    return made.withColumns({features: vector, "_mean": F.lit(float(start))}).drop(*names, "_part")


def _draw(share: float, seed: int):
    """For each cell the number and the sum of the labels drawn; each row is drawn on its own, by its cell, place and seed."""

    def drawn(ids: pa.Array, labels: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(labels).to_numpy(zero_copy_only=False).astype(np.int64)
        y, ends = labels.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        place = np.arange(len(y)) - np.repeat(ends - sizes, sizes)
        z = np.repeat(ids.to_numpy(zero_copy_only=False).astype(np.uint64), sizes)
        for more in (place.astype(np.uint64), np.uint64(seed)):  # the mixing steps of splitmix64
            z = z * np.uint64(0x9E3779B97F4A7C15) + more + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
        kept = (z >> np.uint64(11)).astype(float) * 2.0**-53 < share
        cell = np.repeat(np.arange(len(sizes)), sizes)[kept]
        n, s = np.bincount(cell, minlength=len(sizes)).astype(float), np.bincount(cell, y[kept], len(sizes)).astype(float)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(s)], ["n", "s"])

    return F.arrow_udf(drawn, "n double, s double")


def boost(
    rows: DataFrame, held: Column, features: str, label: str, prediction: str, rounds: int = 1_500, patience: int = 50,
    step: float = 0.05, max_features: float | str = 0.9, max_samples: float = 0.9, seed: int = 42, columns: Sequence[str] = (), **tree,
) -> tuple[GBTRegressionModel, list[float]]:
    """The model of the best round, and the loss after each round (0 for the mean alone) on the rows where `held` holds.

    `rows` has the vectors `features`, or the numbers `columns` they are made of, and `label`; `tree` are settings of the single
    trees. The loss is the mean squared error. Where no row is held out, the loss is that of the training rows.
    """
    if rounds < 0 or patience < 1:
        raise ValueError("rounds is at least 0 and patience at least 1")
    min_rows = tree.pop("minInstancesPerNode", 1)
    cells = _cells(rows, held, features, label, keep=max_samples < 1.0, columns=columns)
    setup = {"featuresCol": features, "labelCol": "_left", "predictionCol": "_tree", "seed": seed}
    learned = cells.where("_n > 0")
    mean = DecisionTreeRegressor(maxDepth=0, weightCol="_n", **setup).fit(learned.select(features, (F.col("_sum") / F.col("_n") + F.col("_mean")).alias("_left"), "_n"))
    # labels enter less their mean, so that the sum of squares loses no digits
    error = F.col("_held_squares") - 2 * F.col("_score") * F.col("_held_sum") + F.col("_held_n") * F.col("_score") * F.col("_score")
    loss: Callable[[DataFrame], float] = lambda df: max(0.0, float(df.agg(F.sum(error) / F.sum("_held_n")).first()[0]))
    now = cells.withColumn("_score", F.lit(0.0)).persist()
    drawn = now
    losses, trees = [loss(now)], []
    try:
        for k in range(rounds):
            take = F.struct(F.col("_n").alias("n"), F.col("_sum").alias("s")) if max_samples >= 1.0 else _draw(max_samples, seed + k)("_id", "_labels")
            taken = now.where("_n > 0").select(features, "_score", take.alias("_take")).where("_take.n > 0")
            left = F.col("_take.s") / F.col("_take.n") - F.col("_score")
            drawn = taken.select(features, left.alias("_left"), F.col("_take.n").alias("_n")).persist()
            total = drawn.agg(F.sum("_n")).first()[0] or 0.0
            if not total:
                raise ValueError("no row was drawn")
            settings = setup | tree | {"seed": seed + k} | weighted_leaves(min_rows, total, tree.get("maxDepth", 5))
            forest = RandomForestRegressor(numTrees=1, weightCol="_n", subsamplingRate=1.0, featureSubsetStrategy=str(max_features), bootstrap=False, **settings)
            trees.append(forest.fit(drawn).trees[0].setFeaturesCol(features).setPredictionCol("_tree"))
            drawn.unpersist()
            added = trees[-1].transform(now).withColumn("_score", F.col("_score") + step * F.col("_tree")).drop("_tree")
            after = (durable(added) if (k + 1) % ROUNDS_PER_WRITE == 0 else added).persist()
            losses.append(loss(after))
            now.unpersist()
            now = after
            best = min(range(len(losses)), key=losses.__getitem__)
            if k + 1 - best >= patience:
                break
    finally:
        drawn.unpersist()
        now.unpersist()
    best = min(range(len(losses)), key=losses.__getitem__)
    return as_model([mean, *trees[:best]], [1.0] + [step] * best, mean.numFeatures, features, prediction), losses
