"""Regressors on a feature table: a name, a family, fit, predict and importances.

Fitting is Spark ML's. Predictions come as a column next to the keys of a row, on the scale of the label.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.metrics import rmse
from meterlake.functions.scalars import from_log, seconds
from meterlake.operators import forest
from meterlake.operators.boosting import boost, weighted_leaves
from meterlake.operators.quantiles import global_quantiles
from meterlake.operators.split import with_fold_block
from meterlake.session import cut_lineage, durable

VECTOR = "_features"


class Standardizer:
    """Drops constant columns (deviation up to 1e-8) and scales the rest by population mean and deviation."""

    def __init__(self, least: float = 1e-8):
        self.least = least
        self.kept: list[str] = []
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Standardizer:
        stats = df.agg(
            *[F.avg(F.col(c).cast("double")).alias(f"{c}|m") for c in columns],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}|s") for c in columns],
        ).first()  # two numbers per feature
        self.stats = {c: (stats[f"{c}|m"], stats[f"{c}|s"]) for c in columns}
        self.kept = [c for c in columns if (self.stats[c][1] or 0.0) > self.least]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.stats:
            raise RuntimeError("fit the standardizer before transform")
        return df.withColumns({c: (F.col(c) - self.stats[c][0]) / self.stats[c][1] for c in self.kept})


class Regressor:
    """Base of all models; subclasses set `name`, `family` and `_train`."""

    name = "base"
    family = "none"

    def __init__(self, **params):
        self.params = params
        self.model = None
        self.features: list[str] = []
        self.train_seconds = 0.0

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label", time_col: str = "timestamp") -> Regressor:
        self.features = list(features)
        start = time.perf_counter()
        self.model = self._train(df, label, time_col)
        self.train_seconds = time.perf_counter() - start
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.model is None:
            raise RuntimeError(f"fit {self.name} before predict")
        scored = self.model.transform(self._vectors(df)).select(*[F.col(c) for c in df.columns], F.col("_prediction").alias(out))
        return scored

    def fit_predict(self, train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
        return self.fit(train, features, label).predict(val)

    def feature_importance(self) -> dict[str, float]:
        raise NotImplementedError

    def importance_table(self, spark) -> DataFrame:
        rows = [(f, float(v)) for f, v in self.feature_importance().items()]  # one row per feature
        return spark.createDataFrame(rows, "feature string, value double")

    def _train(self, df: DataFrame, label: str, time_col: str):
        raise NotImplementedError

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol=VECTOR).transform(df)

    def _setting(self, key: str, default):
        value = self.params.get(key)
        return default if value is None else value


class _Linear(Regressor):
    family = "linear"

    def _vectors(self, df: DataFrame) -> DataFrame:
        scaled = self.scaler.transform(df.select("*", *[F.col(c).alias(f"_raw_{c}") for c in self.scaler.kept]))
        vectors = VectorAssembler(inputCols=self.scaler.kept, outputCol=VECTOR).transform(scaled)
        # the caller gets the columns as they came
        return vectors.withColumns({c: F.col(f"_raw_{c}") for c in self.scaler.kept})

    def _scaled(self, df: DataFrame, label: str, time_col: str | None = None) -> DataFrame:
        self.scaler = Standardizer().fit(df, self.features)
        kept = [F.col(label).alias("_label")] + ([F.col(time_col).alias("_time")] if time_col else [])
        return self._vectors(df).select(VECTOR, *kept).persist()

    def feature_importance(self) -> dict[str, float]:
        return dict(zip(self.scaler.kept, map(float, self.model.coefficients)))

    @staticmethod
    def _solve(rows: DataFrame):
        """Least squares without a penalty."""
        return LinearRegression(
            featuresCol=VECTOR, labelCol="_label", predictionCol="_prediction", standardization=False, solver="normal",
        ).fit(rows)


class OLS(_Linear):
    name = "ols"

    def solve(self, blocks: list[np.ndarray]) -> Line:
        """The line of all rows, from the moments of blocks of time."""
        return elastic_line(sum(blocks), 0.0, 0.0, False)

    def _train(self, df, label, time_col):
        rows = self._scaled(df, label)
        model = self._solve(rows)
        rows.unpersist()
        return model


class Line:
    """A fitted linear model that scores with built-in functions."""

    def __init__(self, coefficients: np.ndarray, intercept: float):
        self.coefficients, self.intercept = coefficients, float(intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        parts = F.zip_with(vector_to_array(VECTOR), weights, lambda x, w: x * w)
        return df.withColumn("_prediction", F.aggregate(parts, F.lit(self.intercept), lambda total, x: total + x))


def moments(df: DataFrame, columns: Sequence[str], by: str) -> dict[int, np.ndarray]:
    """By value of `by`: the sums of products of all pairs of (1, *columns), in one pass.

    Each task adds up its batches; the sums of the tasks meet by block and place. A few hundred numbers per block come to
    the driver.
    """
    width = len(columns) + 1

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(block)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
            for b in np.unique(block):
                part = x[block == b]
                total[int(b)] = total.get(int(b), 0) + part.T @ part
        rows = [pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["block", "m"])

    rows = df.select(F.col(by).cast("int").alias("block"), *[F.col(c).cast("double") for c in columns])
    cells = rows.mapInArrow(gram, "block int, m array<double>").select("block", F.posexplode("m").alias("at", "x"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("block", "at").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["block"], np.zeros(width * width))[r["at"]] = r["x"]
    if any(np.isnan(m).any() for m in out.values()):
        raise ValueError("a feature or the label is null")
    return {b: m.reshape(width, width) for b, m in out.items()}


def elastic_line(m: np.ndarray, alpha: float, l1_ratio: float, per_row: bool, rounds: int = 10_000, tol: float = 1e-12) -> Line:
    """The penalised least-squares line of rows with the moments `m` (1, features, label), by coordinate descent.

    `per_row`: half the mean squared error plus alpha (l1 |w| + (1 - l1) / 2 w w), as for lasso and elastic net; otherwise
    the sum of squared errors plus alpha w w, as for ridge.
    """
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] / n - np.outer(mean, mean)
    gram, cross = centred[:-1, :-1], centred[:-1, -1]
    l1, l2 = (alpha * l1_ratio, alpha * (1 - l1_ratio)) if per_row else (0.0, alpha / n)
    w = np.zeros(len(cross))
    if not l1:
        w = np.linalg.lstsq(gram + l2 * np.eye(len(w)), cross, rcond=None)[0]
    else:
        for _ in range(rounds):
            before = w.copy()
            for j in range(len(w)):
                rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
            if np.abs(w - before).max(initial=0.0) <= tol * max(1.0, np.abs(w).max(initial=0.0)):
                break
    return Line(w, mean[-1] - mean[:-1] @ w)


def squared_error(m: np.ndarray, line: Line) -> float:
    """Sum of squared errors of the line over rows with the moments `m`."""
    v = np.concatenate(([-line.intercept], -line.coefficients, [1.0]))
    return float(max(v @ m @ v, 0.0))


class _Penalised(_Linear):
    """Chooses the penalty on expanding folds cut by time, then fits on all rows.

    The rows are read once, for the moments of every block of time. All penalties, ratios and folds are solved from these.
    """

    per_row = True
    # The penalties to choose from.
    default_alphas = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
    ratios: tuple[float, ...] = (0.0,)

    def _candidates(self):
        return [(a, r) for r in self._setting("l1_ratios", self.ratios) for a in self._setting("alphas", self.default_alphas)]

    def _loss(self, m: np.ndarray, line: Line) -> float:
        """The mean squared error."""
        return squared_error(m, line) / m[0, 0]

    def _train(self, df, label, time_col):
        splits = self._setting("cv", 3)
        self.scaler = Standardizer().fit(df, self.features)
        known = self.scaler.transform(df.select(*self.scaler.kept, F.col(label).alias("_label"), F.col(time_col).alias("_time")))
        blocks = moments(with_fold_block(known, splits, "_time"), [*self.scaler.kept, "_label"], "block")
        return self.solve([blocks.get(b, np.zeros((len(self.scaler.kept) + 2,) * 2)) for b in range(splits + 1)])

    def solve(self, blocks: list[np.ndarray]) -> Line:
        """The line with the best penalty over the folds, each of which learns from the blocks before its own."""
        losses = {}
        for candidate in self._candidates():
            per_fold = []
            for fold in range(1, len(blocks)):
                earlier = sum(blocks[:fold])
                if earlier[0, 0] and blocks[fold][0, 0]:
                    per_fold.append(self._loss(blocks[fold], elastic_line(earlier, *candidate, self.per_row)))
            losses[candidate] = sum(per_fold) / max(1, len(per_fold))
        self.chosen = min(losses, key=losses.get)
        return elastic_line(sum(blocks), *self.chosen, self.per_row)


class Ridge(_Penalised):
    name = "ridge"
    per_row = False

    def _loss(self, m, line):
        """1 - R2, so the best R2 has the smallest loss."""
        spread = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
        return squared_error(m, line) / spread if spread > 0 else 0.0


class Lasso(_Penalised):
    name = "lasso"
    ratios = (1.0,)

    def _candidates(self):
        return [(a, 1.0) for a in self._setting("alphas", self.default_alphas)]


class ElasticNet(_Penalised):
    name = "elasticnet"
    # The shares of the absolute penalty to choose from.
    ratios = (0.1, 0.3, 0.5, 0.7, 0.9)


class _Tree(Regressor):
    family = "trees"

    def _shared(self) -> dict:
        return dict(
            featuresCol=VECTOR, labelCol="_label", predictionCol="_prediction", seed=self._setting("seed", 42),
            minInstancesPerNode=self._setting("min_rows", 50), maxBins=self._setting("max_bins", 64),
            cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=self._setting("memory_mb", 512),
        )

    def feature_importance(self) -> dict[str, float]:
        found = self.model.featureImportances
        return {f: float(found[i]) for i, f in enumerate(self.features)}


class DecisionTree(_Tree):
    name = "decision_tree"

    def _train(self, df, label, time_col):
        """On rows of equal features as one, weighted by their number; the splits are those of the single rows."""
        cut_lineage(df.sparkSession)  # for checkpointInterval
        n, y = F.count(F.lit(1)), F.col(label).cast("double")
        cells = durable(df.groupBy(*self.features).agg(n.cast("double").alias("_n"), F.when(F.count(y) == n, F.avg(y)).alias("_label")))
        rows = cells.agg(F.sum("_n")).first()[0] or 1.0
        settings = self._shared() | weighted_leaves(self._setting("min_rows", 50), rows, self._setting("max_depth", 16))
        return DecisionTreeRegressor(weightCol="_n", **settings).fit(self._vectors(cells).select(VECTOR, "_label", "_n"))


class RandomForest(_Tree):
    name = "random_forest"

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df  # the forest reads the columns

    def _train(self, df, label, time_col):
        return forest.fit(df, self.features, label, bins=self._setting("max_bins", 64), **self._grown())

    def _grown(self) -> dict:
        n_trees = self._setting("n_trees", 200)
        return dict(
            trees=n_trees, depth=self._setting("max_depth", 16), rate=self._setting("max_samples", 0.5) if n_trees > 1 else None,
            min_rows=self._setting("min_rows", 50), seed=self._setting("seed", 42),
        )

    def nested(self, df: DataFrame, features: Sequence[str], group: str, groups: int, label: str = "label") -> forest.Nested:
        """The rows of nested groups, from which `fit_group` fits each."""
        return forest.Nested(df, features, label, group, groups, self._setting("max_bins", 64))

    def fit_group(self, rows: forest.Nested, k: int) -> RandomForest:
        """`fit` on group k; the time of the fit is without that of the common rows."""
        self.features = rows.features
        start = time.perf_counter()
        self.model = rows.fit(k, **self._grown())
        self.train_seconds = time.perf_counter() - start
        return self


class BoostedTrees(_Tree):
    """The model of the best round on the last tenth of the training time; `losses` has the loss after every round. Rows of a
    single point in time have no last tenth: then `rounds`, a hundred at most, are fitted by the loss on all rows."""

    name = "boosted_trees"

    def _train(self, df, label, time_col):
        shared = self._shared()
        tree = {k: shared[k] for k in ("minInstancesPerNode", "maxBins", "cacheNodeIds", "checkpointInterval", "maxMemoryInMB")}
        share, rounds = self._setting("stopping_share", 0.1), self._setting("rounds", 1_500)
        held = F.lit(False)
        if share:
            cut = global_quantiles(df.select(seconds(time_col).alias("_s")), "_s", [1 - share]).first()["q"][0]
            held = seconds(time_col) > cut
            share = not df.where(held).isEmpty()
        cut_lineage(df.sparkSession)  # for checkpointInterval
        names = [f"_feature_{k}" for k in range(len(self.features))]
        rows = df.select(*[F.col(f).alias(n) for f, n in zip(self.features, names)], F.col(label).alias("_label"), held.alias("_late"))
        model, self.losses = boost(
            rows, F.col("_late"), VECTOR, "_label", "_prediction", rounds if share else min(rounds, 100), self._setting("patience", 50),
            self._setting("step", 0.05), self._setting("max_features", 0.9), self._setting("max_samples", 0.9), self._setting("seed", 42), names,
            maxDepth=self._setting("max_depth", 6), **tree,
        )
        self.best_round = min(range(len(self.losses)), key=self.losses.__getitem__)
        return model


REGISTRY: dict[str, Callable[..., Regressor]] = {
    m.name: m for m in (OLS, Ridge, Lasso, ElasticNet, DecisionTree, RandomForest, BoostedTrees)
}


LINEAR = {name: m for name, m in REGISTRY.items() if issubclass(m, _Linear)}


def cut_at(tree: DecisionTreeRegressionModel, depths: Sequence[int]) -> list[list[float]]:
    """For every leaf, in the order of `predictLeaf`, what the tree would predict there if it ended at each of `depths`.

    Greedy trees nest: one that may go deeper makes the same splits first, so the values are those of shallower fits.
    """
    out: list[list[float]] = []
    todo = [(tree._call_java("rootNode"), [])]
    while todo:
        node, above = todo.pop()
        path = [*above, node.prediction()]
        if node.subtreeDepth():
            todo += [(node.rightChild(), path), (node.leftChild(), path)]
        else:
            out.append([path[min(d, len(path) - 1)] for d in depths])
    return out


def depth_sweep(train: DataFrame, val: DataFrame, features: Sequence[str], depths: Sequence[int], label: str = "label", log_target: bool = True, **params) -> DataFrame:
    """Validation RMSE of the reading of a decision tree per depth; the label is its log where `log_target`.

    Only the deepest tree is fitted, and its fit time told; the others are cut from it, as greedy trees nest. All are scored
    in one pass. The tree is kept as arrays, since it may have a leaf for every few rows.
    """
    start = time.perf_counter()
    settings = {"min_rows": params.get("min_rows") or 50, "bins": params.get("max_bins") or 64, "seed": params.get("seed") or 42}
    deepest = forest.fit(train, features, label, trees=1, depth=max(depths), rate=None, **settings)
    took = time.perf_counter() - start
    each = deepest.at_depths(val.select(label, *features), depths, "_cuts").select(label, F.posexplode("_cuts").alias("_at", "prediction"))
    if log_target:
        each = each.withColumns({label: from_log(label), "prediction": from_log("prediction")})
    errors = {r["_at"]: r["rmse"] for r in each.groupBy("_at").agg(rmse(label, "prediction").alias("rmse")).collect()}
    rows = [(d, errors.get(k), took if d == max(depths) else None) for k, d in enumerate(depths)]
    return train.sparkSession.createDataFrame(rows, "max_depth int, rmse double, train_seconds double")


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    """The k features with the largest absolute value."""
    return importance.orderBy(F.desc(F.abs("value")), "feature").limit(k)
