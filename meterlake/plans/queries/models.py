"""Queries that fit models, cluster profiles or draw samples.

Fitted values depend on the engine, so most have no SQL counterpart; the least-squares line and the scaled
columns do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meterlake.functions.scalars import to_log, wave
from meterlake.operators import clean, lloyd, models, sampling, segment_trees, segments
from meterlake.operators.series import Series
from meterlake.operators.split import split_at
from meterlake.plans import training
from meterlake.plans.prepare import Prepared
from meterlake.plans.queries.catalog import on, query, r, sr
from meterlake.plans.queries.sequences import prepare_lines
from meterlake.plans.queries.summaries import PROFILE_MEANS, PROFILE_TOTAL
from meterlake.session import durable, scratch_path
from meterlake.sources import frames, tables

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "month_sin", "month_cos", "dayofweek_sin", "dayofweek_cos"]
RAW = ["l_discount", "l_tax", "l_linenumber"]
CUTOFF = "2000-01-01"
# Queries that fit several models: larger steps, and an end after three rounds without gain. `fit_gbt` has the defaults.
QUICK_BOOST = {"step": 0.3, "patience": 3}
DEPTHS = (4, 8, 16, 24)
CLUSTERS = range(2, 11)
ALL_MODELS = {name: {} for name in models.REGISTRY} | {"boosted_trees": QUICK_BOOST}


def priced(spark, d):
    """Line items with calendar waves and the log price as label."""
    lines = frames.table(spark, d, "lineitem").withColumns(
        {
            "timestamp": F.col("l_shipdate"),
            "meter_reading": F.col("l_extendedprice"),
            "label": to_log("l_extendedprice"),
            "building_id": F.col("l_suppkey"),
            "meter": F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2),
        }
    )
    month, day = F.month("timestamp"), F.weekday("timestamp")
    return lines.withColumns(
        {f"{n}_{s}": wave(c, p, s) for n, c, p in (("month", month, 12), ("dayofweek", day, 7)) for s in ("sin", "cos")}
    )


def prepared(spark, d, names=FEATURES) -> Prepared:
    train, val = split_at(priced(spark, d), CUTOFF)
    return Prepared(train, val, list(names), None, frames.READINGS)


def scored(spark, d, name: str, **params):
    row = training.score_model(models.REGISTRY[name](**params), prepared(spark, d))
    return training._as_table(spark, [row], training.SCORE_SCHEMA).drop("train_seconds")


@query(
    "standardize",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - mq) / sq + 1e-9, 6) AS l_quantity,
    round((l_tax - mt) / st + 1e-9, 6) AS l_tax FROM lineitem, s""",
)
def standardize(spark, d):
    lines = frames.table(spark, d, "lineitem").withColumn("constant", F.lit(1.0))
    scaler = models.Standardizer().fit(lines, ["l_quantity", "l_tax", "constant"])
    return scaler.transform(lines).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r(c, 6) for c in scaler.kept])


@query(
    "ols_line",
    f"SELECT {sr('regr_slope(l_extendedprice, l_quantity)', 3, 'slope')}, {sr('regr_intercept(l_extendedprice, l_quantity)', 3, 'intercept')} FROM lineitem",
)
def ols_line(spark, d):
    lines = frames.table(spark, d, "lineitem")
    line = models.OLS().fit(lines, ["l_quantity"], "l_extendedprice")
    mean, spread = line.scaler.stats["l_quantity"]
    slope = float(line.model.coefficients[0]) / spread
    out = spark.createDataFrame([(slope, line.model.intercept - slope * mean)], "slope double, intercept double")
    return out.select(r("slope", 3), r("intercept", 3))


@query("fit_ols")
def fit_ols(spark, d):
    return scored(spark, d, "ols")


@query("fit_ridge")
def fit_ridge(spark, d):
    return scored(spark, d, "ridge")


@query("fit_lasso")
def fit_lasso(spark, d):
    return scored(spark, d, "lasso")


@query("fit_elasticnet")
def fit_elasticnet(spark, d):
    return scored(spark, d, "elasticnet")


@query("fit_tree_sweep")
def fit_tree_sweep(spark, d):
    prep = prepared(spark, d)
    return models.depth_sweep(prep.train, prep.val, prep.features, DEPTHS).drop("train_seconds")


@query(
    "tree_stump",
    on(
        "",
        f"""SELECT {sr('y', 4, 'mean')}, n FROM (SELECT avg(y) AS y, count(*) AS n FROM t, best GROUP BY x <= cut)""",
        t="SELECT l_quantity AS x, ln(1 + l_extendedprice) AS y FROM lineitem",
        sums="SELECT x, sum(sum(y)) OVER (ORDER BY x) AS s, sum(count(*)) OVER (ORDER BY x) AS n FROM t GROUP BY x",
        best="""SELECT x AS cut FROM sums, (SELECT sum(y) AS a, count(*) AS c FROM t) WHERE n < c
            ORDER BY s * s / n + (a - s) * (a - s) / (c - n) DESC LIMIT 1""",
    ),
)
def tree_stump(spark, d):
    """The best single split of the log price by quantity: rows and means of its two sides."""
    lines = priced(spark, d)
    stump = models.DecisionTree(max_depth=1, min_rows=1).fit(lines, ["l_quantity"])
    sides = stump.predict(lines).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return sides.select(r("prediction", 4, "mean"), "n")


@query("fit_forest")
def fit_forest(spark, d):
    return scored(spark, d, "random_forest")


@query("fit_gbt")
def fit_gbt(spark, d):
    return scored(spark, d, "boosted_trees")


@query(
    "boosting_losses",
    # a tree of a feature with three values has a leaf for each: every round takes the same share of what is left of its mean
    on(
        "",
        f"""SELECT CAST(round AS INTEGER) AS round, {sr('avg((label - score) * (label - score))', 6, 'loss')} FROM (
        SELECT l.label, round, start + (1 - pow(0.7, round)) * (m.own - start) AS score FROM lines l JOIN means m USING (meter),
        everything, unnest(range(0, 13)) AS r(round) WHERE held) GROUP BY round""",
        lines=f"""SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS meter, ln(1 + l_extendedprice) AS label,
        epoch(l_shipdate) > (SELECT quantile_cont(epoch(l_shipdate), 0.9) FROM lineitem WHERE l_shipdate < '{CUTOFF}') AS held
        FROM lineitem WHERE l_shipdate < '{CUTOFF}'""",
        means="SELECT meter, avg(label) AS own FROM lines WHERE NOT held GROUP BY meter",
        everything="SELECT avg(label) AS start FROM lines WHERE NOT held",
    ),
)
def boosting_losses(spark, d):
    """The loss on held-out rows after every round of a small model."""
    whole = {"max_features": "all", "max_samples": 1.0, "min_rows": 1}
    train = prepared(spark, d).train
    boosted = models.BoostedTrees(rounds=12, step=0.3, max_depth=2, **whole).fit(train, ["meter"])
    out = spark.createDataFrame(list(enumerate(boosted.losses)), "round int, loss double")
    return out.select("round", r("loss", 6))


@query("feature_importance")
def feature_importance(spark, d):
    prep = prepared(spark, d)
    return models.DecisionTree().fit(prep.train, prep.features).importance_table(spark)


@query("top_features")
def top_features(spark, d):
    prep = prepared(spark, d)
    return models.top_features(models.OLS().fit(prep.train, prep.features).importance_table(spark), 5)


@query("feature_ablation")
def feature_ablation(spark, d):
    sets = {"engineered": FEATURES, "raw": RAW}
    return training.ablation(lambda name: prepared(spark, d, sets[name]), ALL_MODELS)


@query("sample_complexity")
def sample_complexity(spark, d):
    return training.sample_complexity(prepared(spark, d), ALL_MODELS).drop("train_seconds")


SHARES = (0.1, 0.25, 0.5, 0.75, 1.0)


@query(
    "sample_complexity_line",
    on(
        "",
        f"""SELECT CAST(share AS DOUBLE) AS fraction, any_value(n) AS n_train, count(*) AS n,
        {sr('sqrt(avg(pow(exp(least(greatest(a + b * l_quantity, 0), 14)) - 1 - l_extendedprice, 2)))', 3, 'rmse')}
        FROM fits, (SELECT * FROM lineitem WHERE l_shipdate >= '{CUTOFF}') GROUP BY share""",
        t=f"SELECT epoch(l_shipdate) AS s, l_quantity AS x, ln(1 + l_extendedprice) AS y FROM lineitem WHERE l_shipdate < '{CUTOFF}'",
        ends=f"""SELECT share, CASE WHEN share = 1 THEN (SELECT max(s) FROM t) ELSE (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS k FROM t)
            WHERE k = greatest(1, CAST(floor(share * (SELECT count(*) FROM t)) AS BIGINT))) END AS last FROM unnest([{', '.join(map(str, SHARES))}]) AS u(share)""",
        fits="SELECT share, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ends JOIN t ON s <= last GROUP BY share",
    ),
)
def sample_complexity_line(spark, d):
    """Least squares on the quantity, fitted on growing prefixes from one scan."""
    out = training.sample_complexity(prepared(spark, d, ["l_quantity"]), {"ols": {}}, SHARES)
    return out.select("fraction", "n_train", "n", r("rmse", 3))


@query("segment_vs_global")
def segment_vs_global(spark, d):
    prep = prepared(spark, d)
    return training.segment_vs_global(prep.train, prep.val, prep.features, "meter", "boosted_trees", 100, **QUICK_BOOST)


@query(
    "segment_stumps",
    on(
        "",
        f"""SELECT s.l_suppkey, feature, cut, {sr('sl / nl', 4, 'low_mean')}, {sr('(a - sl) / (c - nl)', 4, 'high_mean')} FROM best s""",
        t="SELECT l_suppkey, ln(1 + l_extendedprice) AS y, l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem",
        long="SELECT l_suppkey, 'l_quantity' AS feature, l_quantity AS x, y FROM t UNION ALL SELECT l_suppkey, 'l_linenumber', l_linenumber, y FROM t",
        sums="""SELECT l_suppkey, feature, x AS cut, sum(sum(y)) OVER w AS sl, sum(count(*)) OVER w AS nl, sum(sum(y)) OVER g AS a, sum(count(*)) OVER g AS c
            FROM long GROUP BY l_suppkey, feature, x WINDOW w AS (PARTITION BY l_suppkey, feature ORDER BY x), g AS (PARTITION BY l_suppkey, feature)""",
        best="""SELECT * FROM sums WHERE nl >= 20 AND c - nl >= 20
            QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY sl * sl / nl + (a - sl) * (a - sl) / (c - nl) DESC) = 1""",
    ),
)
def segment_stumps(spark, d):
    """One cut per supplier, all from one pass: its feature, place and the means of both sides."""
    names, lines = ["l_quantity", "l_linenumber"], priced(spark, d)
    edges = [list(map(float, range(1, 50))), list(map(float, range(1, 7)))]  # all values of both
    model = segment_trees.fit(lines, names, "l_suppkey", rounds=1, step=1.0, depth=1, min_rows=20, edges=edges)
    e = F.array(*[F.array(*map(F.lit, line)) for line in edges])
    rows = model.trees.join(model.starts, "_segment").where(F.col("feature")[0] >= 0)
    f, side = F.col("feature")[0], lambda k: F.col("start") + F.col("value")[k]
    return rows.select(
        F.col("_segment").alias("l_suppkey"), F.array(*map(F.lit, names))[f].alias("feature"), e[f][F.col("cut")[0]].alias("cut"), r(side(0), 4, "low_mean"), r(side(1), 4, "high_mean")
    )


@query("segment_boost")
def segment_boost(spark, d):
    """Boosted trees of every supplier, grown together, against one model of all."""
    prep = prepared(spark, d)
    found = training.segments_together(prep.train, prep.val, prep.features, "l_suppkey", 100, rounds=4, patience=3, step=0.3)
    return training.compare_segments(durable(found), "l_suppkey")


@query("imputation_experiment")
def imputation_experiment(spark, d):
    """Boosted trees after each treatment of runs of zeros, all cleaned in one pass."""
    rows = frames.readings(spark, d)
    sites = frames.meta(spark, d).select("building_id", "site_id")
    treated = clean.all_treatments(rows.join(sites, "building_id", "left"), frames.READINGS, min_hours=2, quantile=0.99)
    prep_of = lambda s: prepare_lines(spark, d, clean.treatment(treated, s).select(*rows.columns), strategy=None)
    return training.imputation_experiment(prep_of, clean.STRATEGIES, **QUICK_BOOST).drop("train_seconds")


@query("train_leaderboard")
def train_leaderboard(spark, d):
    prep = prepare_lines(spark, d)
    store = tables.PredictionStore(spark, scratch_path(spark, "predictions"))
    report, about = training.train_all(prep, ALL_MODELS, store)
    return training.results_table(report, about).drop("train_seconds")


# ---- clusters


def profiles(spark, d):
    # one row per user, read by every fit
    return durable(segments.consumption_profiles(frames.table(spark, d, "events"), ["user_id"], "ts", "value"))


@query("kmeans_assign")
def kmeans_assign(spark, d):
    p = profiles(spark, d)
    return segments.assign_clusters(segments.fit_kmeans(p, 3), p)


@query("kmeans_centroids")
def kmeans_centroids(spark, d):
    return segments.centroids(spark, segments.fit_kmeans(profiles(spark, d), 3))


@query("kmeans_elbow")
def kmeans_elbow(spark, d):
    return segments.elbow_curve(profiles(spark, d), range(2, 11))


_PROFILES = f"SELECT user_id, [{', '.join(f'{h} / CASE WHEN {PROFILE_TOTAL} > 0 THEN {PROFILE_TOTAL} ELSE 1 END' for h in segments.HOURS)}] AS x FROM ({PROFILE_MEANS})"


@query(
    "lloyd_pass",
    f"""WITH p AS MATERIALIZED ({_PROFILES}),
    centres AS (SELECT k, c - 1 AS cluster, x AS centre FROM (SELECT row_number() OVER (ORDER BY user_id) AS c, x FROM p), unnest([2, 3, 5]) AS t(k) WHERE c <= k),
    gaps AS (SELECT k, cluster, user_id, x, list_sum(list_transform(list_zip(x, centre), lambda z: pow(z[1] - z[2], 2))) AS d FROM p, centres),
    nearest AS (SELECT k, user_id, arg_min(cluster, d) AS cluster, min(d) AS d, any_value(x) AS x FROM (SELECT * FROM gaps ORDER BY cluster) GROUP BY k, user_id)
    SELECT CAST(k AS INTEGER) AS k, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, {sr('sum(d)', 6, 'cost')}, {sr('avg(x[13])', 6, 'noon')} FROM nearest GROUP BY k, cluster""",
)
def lloyd_pass(spark, d):
    """One pass for three numbers of clusters, from the profiles of the first users as centres."""
    p = profiles(spark, d)
    first = np.array([list(r) for r in p.orderBy("user_id").limit(5).select(*segments.HOURS).collect()])
    out = lloyd.lloyd_pass(p, segments.HOURS, {k: first[:k] for k in (2, 3, 5)})
    return out.select("k", "cluster", "n", r("cost", 6), r(F.col("h12") / F.col("n"), 6, "noon"))


@query(
    "cluster_composition",
    on(
        "meta",
        f"""SELECT cluster, primary_use, n, {sr('100.0 * n / sum(n) OVER (PARTITION BY cluster)', 4, 'pct')} FROM (
        SELECT CAST(user_id % 3 AS INTEGER) AS cluster, primary_use, count(DISTINCT user_id) AS n
        FROM events JOIN meta ON user_id = building_id GROUP BY 1, 2)""",
    ),
)
def cluster_composition(spark, d):
    """Uses by cluster, with fixed labels so that the table has a SQL form."""
    labels = profiles(spark, d).select("user_id", (F.col("user_id") % 3).cast("int").alias("cluster"))
    uses = frames.meta(spark, d).select(F.col("building_id").alias("user_id"), "primary_use")
    return segments.cluster_composition(labels.join(uses, "user_id")).withColumn("pct", r("pct"))


@query(
    "cluster_means",
    f"WITH means AS ({PROFILE_MEANS}) SELECT CAST(user_id % 3 AS INTEGER) AS cluster, "
    + ", ".join(sr(f"avg({h} / CASE WHEN {PROFILE_TOTAL} > 0 THEN {PROFILE_TOTAL} ELSE 1 END)", 6, h) for h in segments.HOURS)
    + " FROM means GROUP BY 1",
)
def cluster_means(spark, d):
    p = profiles(spark, d)
    labels = p.select("user_id", (F.col("user_id") % 3).cast("int").alias("cluster"))
    out = segments.cluster_means(p, labels, ["user_id"])
    return out.select("cluster", *[r(h, 6) for h in segments.HOURS])


def prepared_events(spark, d) -> Prepared:
    """Events as readings of their user, with calendar waves and the size of the user's building."""
    events = frames.table(spark, d, "events").withColumns(
        {"building_id": F.col("user_id"), "meter_reading": F.col("value"), "label": to_log("value"), "timestamp": F.col("ts")}
    )
    rows = events.join(frames.meta(spark, d), "building_id").withColumns(
        {f"hour_{s}": wave(F.hour("timestamp"), 24, s) for s in ("sin", "cos")}
    )
    train, val = split_at(rows, "2024-01-22")
    return Prepared(train, val, ["hour_sin", "hour_cos", "square_feet"], None, Series(("building_id",), "timestamp", ("event_id",)))


@query("cluster_segments")
def cluster_segments(spark, d):
    """A model per cluster of users against one model for all."""
    prep = prepared_events(spark, d)
    labels, _ = training.cluster_meters(prep, CLUSTERS)
    train, val = (fold.join(labels, "building_id") for fold in (prep.train, prep.val))
    return training.segment_vs_global(train, val, prep.features, "cluster", "boosted_trees", 20, **QUICK_BOOST)


# ---- samples


@query("sample_n")
def sample_n(spark, d):
    return sampling.sample_n(frames.table(spark, d, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("sample_stratified")
def sample_stratified(spark, d):
    return sampling.sample_stratified_keys(frames.readings(spark, d), ["building_id", "meter"], "meter", 12)


@query("sample_cap")
def sample_cap(spark, d):
    keys = ["building_id", "l_orderkey", "l_linenumber", "l_partkey"]
    return sampling.cap_per_stratum(frames.readings(spark, d), ["meter"], 400, keys).select("meter", *keys)


@query("sample_cap_sizes", on("readings", "SELECT meter, least(count(*), 400) AS n FROM readings GROUP BY meter"))
def sample_cap_sizes(spark, d):
    return sample_cap(spark, d).groupBy("meter").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_stratified_sizes",
    on(
        "readings",
        """SELECT meter, CAST(greatest(1, round_even(12 * n / sum(n) OVER (), 0)) AS BIGINT) AS n
        FROM (SELECT meter, count(DISTINCT building_id) AS n FROM readings GROUP BY meter)""",
    ),
)
def sample_stratified_sizes(spark, d):
    return sample_stratified(spark, d).groupBy("meter").agg(F.count(F.lit(1)).alias("n"))

