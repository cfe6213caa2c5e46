"""Queries that state what a fit has to satisfy: closed forms of one-feature lines, and counts of broken conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import models, sampling, segments
from meterlake.operators.encoding import TargetEncoder
from meterlake.operators.features import drop_prefixed
from meterlake.plans.queries.catalog import query, r, sr
from meterlake.plans.queries.models import ALL_MODELS, FEATURES, prepared, profiles
from meterlake.session import durable, scratch_path, side_by_side
from meterlake.sources import frames, tables

# the covariance of the standardised quantity with the price, and the number of rows
_B = "SELECT covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) AS b, count(*) AS n FROM lineitem"


def line(spark, d, name: str, **params):
    lines = frames.table(spark, d, "lineitem")
    model = models.REGISTRY[name](cv=2, **params).fit(lines, ["l_quantity"], "l_extendedprice", "l_shipdate")
    return spark.createDataFrame([(float(model.model.coefficients[0]),)], "slope double").select(r("slope", 3))


@query("ridge_line", f"SELECT {sr('b * n / (n + 5000.0)', 3, 'slope')} FROM ({_B})")
def ridge_line(spark, d):
    return line(spark, d, "ridge", alphas=[5000.0])


@query("lasso_line", f"SELECT {sr('sign(b) * greatest(abs(b) - 1500.0, 0)', 3, 'slope')} FROM ({_B})")
def lasso_line(spark, d):
    return line(spark, d, "lasso", alphas=[1500.0])


@query("elasticnet_line", f"SELECT {sr('sign(b) * greatest(abs(b) - 0.6, 0) / 2.4', 3, 'slope')} FROM ({_B})")
def elasticnet_line(spark, d):
    return line(spark, d, "elasticnet", alphas=[2.0], l1_ratios=[0.3])


@query("top_feature_line", f"SELECT 'l_quantity' AS feature, {sr('b', 3, 'value')} FROM ({_B})")
def top_feature_line(spark, d):
    model = models.OLS().fit(frames.table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return models.top_features(model.importance_table(spark), 3).select("feature", r("value", 3))


@query(
    "ols_normal_equations",
    "SELECT * FROM (VALUES " + ", ".join(f"('{f}', 0.0::DOUBLE)" for f in FEATURES) + ") AS t(feature, residual) WHERE (SELECT count(*) FROM lineitem) > 0",
)
def ols_normal_equations(spark, d):
    """The mean product of residual and feature, which least squares makes zero."""
    prep = prepared(spark, d)
    fitted = models.OLS().fit(prep.train, prep.features).predict(prep.train)
    gap = F.col("label") - F.col("prediction")
    wide = fitted.agg(*[F.abs(F.round(F.avg(gap * F.col(f)), 5)).alias(f) for f in FEATURES])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("residual")) for f in FEATURES])).alias("x")).select("x.*")


_TRAIN = "SELECT count(*) AS n, CAST(0 AS BIGINT) AS broken FROM lineitem WHERE l_shipdate < '2000-01-01'"


@query("tree_leaf_means", _TRAIN)
def tree_leaf_means(spark, d):
    """A tree predicts the mean label of the training rows of a leaf."""
    prep = prepared(spark, d)
    leaves = models.DecisionTree().fit(prep.train, prep.features).predict(prep.train)
    leaves = leaves.groupBy("prediction").agg(F.avg("label").alias("mean"), F.count(F.lit(1)).alias("rows"))
    return leaves.agg(F.sum("rows").alias("n"), F.count_if(F.abs(F.col("mean") - F.col("prediction")) > 1e-6).alias("broken"))


def within_labels(prep, model):
    fitted = model.fit(prep.train, prep.features).predict(prep.train)
    low, high = prep.train.agg(F.min("label"), F.max("label")).first()
    outside = ~F.col("prediction").between(low - 1e-9, high + 1e-9)
    return fitted.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("broken"))


@query("forest_within_labels", _TRAIN)
def forest_within_labels(spark, d):
    """A forest averages means, which lie between the smallest and the largest label."""
    return within_labels(prepared(spark, d), models.RandomForest())


@query(
    "importance_sums",
    "SELECT * FROM (VALUES ('decision_tree', 1.0::DOUBLE), ('random_forest', 1.0::DOUBLE), ('boosted_trees', 1.0::DOUBLE)) AS t(model, total) "
    "WHERE (SELECT count(*) FROM lineitem) > 0",
)
def importance_sums(spark, d):
    """Importances of every kind of tree add up to 1. Boosting holds no rows out here, since a model whose best round is the
    mean has no importances."""
    prep = prepared(spark, d).learned().stored()
    made = [models.RandomForest(), models.BoostedTrees(rounds=10, step=0.3, stopping_share=0), models.DecisionTree()]
    total = lambda m: round(sum(m.fit(prep.train, prep.features).feature_importance().values()), 6)
    rows = [(m.name, t) for m, t in zip(made, side_by_side(spark, [lambda m=m: total(m) for m in made]))]
    return spark.createDataFrame(rows, "model string, total double")


_USERS = "SELECT count(DISTINCT user_id) AS n, CAST(0 AS BIGINT) AS broken FROM events"


def distances(p, model):
    """The squared distances of every profile from the three centroids, in their order."""

    def from_centre(centre):
        gaps = F.zip_with(F.array(*segments.HOURS), F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)

    return p.select("user_id", F.array(*[from_centre(c) for c in model.clusterCenters()]).alias("d"))


@query("kmeans_nearest", _USERS)
def kmeans_nearest(spark, d):
    """Every profile has the label of its nearest centroid."""
    p = profiles(spark, d)
    model = segments.fit_kmeans(p, 3)
    own = distances(p, model).join(segments.assign_clusters(model, p), "user_id")
    farther = F.get("d", F.col("cluster")) > F.array_min("d") + 1e-9
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(farther).alias("broken"))


@query("kmeans_centroid_means", "SELECT CAST(c AS INTEGER) AS cluster, CAST(0 AS BIGINT) AS broken FROM range(3) t(c) WHERE (SELECT count(*) FROM events) > 0")
def kmeans_centroid_means(spark, d):
    """Every centroid is the mean of its members."""
    p = profiles(spark, d)
    model = segments.fit_kmeans(p, 3)
    means = segments.cluster_means(p, segments.assign_clusters(model, p), ["user_id"])
    both = means.select("cluster", F.array(*segments.HOURS).alias("a")).join(segments.centroids(spark, model).select("cluster", F.array(*segments.HOURS).alias("b")), "cluster")
    apart = F.size(F.filter(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda g: g > 1e-3)).cast("long")
    return both.select("cluster", apart.alias("broken"))


@query("elbow_falls", "SELECT CAST(9 AS BIGINT) AS n, CAST(0 AS BIGINT) AS broken FROM range(1) WHERE (SELECT count(*) FROM events) > 0")
def elbow_falls(spark, d):
    """Two to ten clusters never cost more than one, whose cost is the spread of the profiles."""
    p = profiles(spark, d)
    whole = p.agg(sum((F.var_pop(h) * F.count(h) for h in segments.HOURS), F.lit(0.0)))
    curve = segments.elbow_curve(p, range(2, 11))
    return curve.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("inertia") > whole.first()[0] + 1e-9).alias("broken"))


@query("sample_n_size", "SELECT least(count(*), 500) AS n, least(count(*), 500) AS known FROM orders")
def sample_n_size(spark, d):
    """As many rows as asked for, all different and from the table."""
    orders = frames.table(spark, d, "orders")
    drawn = sampling.sample_n(orders, 500, ["o_orderkey"])
    known = drawn.select("o_orderkey").distinct().join(orders, "o_orderkey", "left_semi")
    return drawn.agg(F.count(F.lit(1)).alias("n")).withColumn("known", known.agg(F.count(F.lit(1))).scalar())


@query(
    "registry_models",
    """SELECT * FROM (VALUES ('ols', 'linear'), ('ridge', 'linear'), ('lasso', 'linear'), ('elasticnet', 'linear'), ('decision_tree', 'trees'),
    ('random_forest', 'trees'), ('boosted_trees', 'trees')) AS t(model, family) WHERE (SELECT count(*) FROM lineitem WHERE l_shipdate < '2000-01-01') > 0""",
)
def registry_models(spark, d):
    """Every registered model fits, predicts every row and names its family."""
    prep = prepared(spark, d).learned().stored()

    def fits(name):
        model = models.REGISTRY[name](**ALL_MODELS[name]).fit(prep.train, prep.features)
        return (name, model.family) if model.predict(prep.val).where("prediction is null").isEmpty() else None

    rows = [row for row in side_by_side(spark, [lambda n=n: fits(n) for n in reversed(models.REGISTRY)]) if row]
    return spark.createDataFrame(rows, "model string, family string")


# ---- stores


@query("csv_roundtrip", f"SELECT l_returnflag, {sr('avg(l_quantity)', 6, 'mean')}, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def csv_roundtrip(spark, d):
    """A result table as a folder of CSV files and back."""
    out = frames.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "csv")
    tables.write_table(out.select("l_returnflag", r("mean", 6), "n"), path)
    return tables.read_table(spark, path, "l_returnflag string, mean double, n long")


@query(
    "prediction_store",
    "SELECT 'a' AS model, event_id, CAST(value AS DOUBLE) AS y_pred FROM events UNION ALL SELECT 'b', event_id, 2 * value FROM events",
)
def prediction_store(spark, d):
    """Two models saved, one of them again with other settings, and read back as one table."""
    events = frames.table(spark, d, "events").select("event_id", F.col("value").cast("double").alias("y_pred"))
    store = tables.PredictionStore(spark, scratch_path(spark, "predictions"))
    store.save("a", events, "depth 3")
    store.save("b", events, "depth 3")
    if not store.has("b", "depth 4"):
        store.save("b", events.withColumn("y_pred", 2 * F.col("y_pred")), "depth 4")
    return store.load_all().select("model", "event_id", "y_pred")


@query(
    "encoder_store",
    f"""SELECT l_returnflag, {sr('(n * m + 30 * (SELECT avg(ln(1 + l_quantity)) FROM lineitem)) / (n + 30)', 6, 'te')}
    FROM (SELECT l_returnflag, count(*) AS n, avg(ln(1 + l_quantity)) AS m FROM lineitem GROUP BY l_returnflag)""",
)
def encoder_store(spark, d):
    """A target encoder saved and loaded by another one."""
    lines = frames.table(spark, d, "lineitem").withColumn("meter_reading", F.col("l_quantity").cast("double"))
    path = scratch_path(spark, "encoder")
    TargetEncoder(["l_returnflag"], smoothing=30).fit(lines).save(path)
    again = TargetEncoder(["l_returnflag"], smoothing=30).load(spark, path)
    flags = lines.select("l_returnflag").distinct()
    return again.transform(flags).select("l_returnflag", r(again.column, 6, "te"))


@query("drop_prefix", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def drop_prefix(spark, d):
    lines = frames.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return drop_prefixed(lines.withColumns({"te_quantity": F.col("l_quantity") * 2, "te_": F.lit(1)}))
