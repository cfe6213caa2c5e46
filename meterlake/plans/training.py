"""Baselines, the training job and the experiments around it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.metrics import score_columns
from meterlake.functions.scalars import LOG_CEILING, clip_real, from_log, seconds
from meterlake.operators import evaluate, segment_trees
from meterlake.operators.joins import compare_runs, group_mean_lookup
from meterlake.operators.models import LINEAR, REGISTRY, RandomForest, Regressor
from meterlake.operators.prefixes import fit_prefixes
from meterlake.operators.prefixes import scores as prefix_scores
from meterlake.operators.quantiles import global_quantiles
from meterlake.operators.segments import assign_clusters, consumption_profiles, elbow_curve, fit_kmeans, pick_elbow
from meterlake.operators.split import chrono_cuts
from meterlake.plans.prepare import Prepared
from meterlake.session import durable, side_by_side
from meterlake.sources.tables import PredictionStore

GROUPS = ("primary_use", "meter_name", "site_id")


def baseline_group_mean(
    train: DataFrame, val: DataFrame, keys: Sequence[str], value: str = "meter_reading", ceiling: float | None = LOG_CEILING
) -> DataFrame:
    """Predict the training mean of the meter, else of all meters. `ceiling` limits actual and predicted readings on the
    log scale, as for models of the log; None limits them from below only, as for models of the reading."""
    rows = group_mean_lookup(train, val, keys, value, "_mean")
    return rows.withColumns({"y_true": clip_real(value, ceiling), "y_pred": clip_real("_mean", ceiling)}).drop("_mean")


def baseline_lag(
    val: DataFrame, value: str = "meter_reading", lag: str = "lag_24h", ceiling: float | None = LOG_CEILING
) -> DataFrame:
    """Predict the lagged reading, else the median of the validation readings."""
    median = global_quantiles(val, value, [0.5]).select(F.col("q")[0])
    pred = F.coalesce(F.col(lag), median.scalar())
    return val.withColumns({"y_true": clip_real(value, ceiling), "y_pred": clip_real(pred, ceiling)})


def real_scale(
    predicted: DataFrame, label: str = "label", prediction: str = "prediction", log_target: bool = True
) -> DataFrame:
    """Actual and predicted readings: back from the log scale, both limited to its range, or as they are, not below 0."""
    if not log_target:
        return predicted.withColumns({"y_true": clip_real(label, None), "y_pred": clip_real(prediction, None)})
    return predicted.withColumns({"y_true": from_log(label), "y_pred": from_log(prediction)})


def report(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Overall and per use, meter type and site, for every model in one pass."""
    named = evaluate.with_meter_name(predictions)
    return evaluate.evaluate_report(named, [g for g in GROUPS if g in named.columns], by)


def train_all(
    prep: Prepared,
    models: dict[str, dict],
    store: PredictionStore,
    refit: bool = False,
    skip: Iterable[str] = (),
    at_once: int = 4,
) -> tuple[DataFrame, dict[str, dict]]:
    """Fit every model of `models` (name: parameters) that the store does not hold, plus both baselines. `at_once` models are
    fitted at a time, so that their fit times are not those of lone fits; their predictions are stored one after another.

    Returns the long score report and, per model, its family, fit time and importances.
    """
    prep = prep.stored()
    keys = [*prep.series.keys, *prep.series.order]
    about: dict[str, dict] = {}
    folds = json.dumps([r.asDict() for r in prep.summary().orderBy("fold").collect()] + [prep.log_target], default=str)  # two rows
    context = [c for c in (*keys, "site_id", "primary_use") if c in prep.val.columns]
    ceiling = LOG_CEILING if prep.log_target else None
    baselines = {"baseline_group_mean": baseline_group_mean(prep.train, prep.val, prep.series.keys, ceiling=ceiling)}
    if "lag_24h" in prep.val.columns:
        baselines["baseline_lag_24h"] = baseline_lag(prep.val, ceiling=ceiling)
    for name, rows in baselines.items():
        if refit or not store.has(name, folds):
            store.save(name, rows.select(*context, "y_true", "y_pred"), folds)
        about[name] = {"family": "baseline", "train_seconds": None, "importance": None}
    todo = {}
    for name, params in models.items():
        if name in skip:
            continue
        made = REGISTRY[name](**params)
        about[name] = {"family": made.family, "train_seconds": None, "importance": None}
        made_from = json.dumps([folds, params, prep.features], default=str, sort_keys=True)
        if refit or not store.has(name, made_from):
            todo[name] = made, made_from
    fits = [lambda made=todo[n][0]: made.fit(prep.train, prep.features, time_col=prep.series.time) for n in _slow_first(todo)]
    if fits:
        side_by_side(prep.train.sparkSession, fits, at_once)
        for name, (made, made_from) in todo.items():
            store.save(name, real_scale(made.predict(prep.val), log_target=prep.log_target).select(*context, "y_true", "y_pred"), made_from)
            about[name].update(train_seconds=made.train_seconds, importance=made.feature_importance())
    predictions = store.load_all().where(F.col("model").isin(*about))
    # a later run may replace the stored predictions
    return durable(report(predictions)), about


def results_table(scores: DataFrame, about: dict[str, dict]) -> DataFrame:
    """One row per model, best first; the fit time of a reused model is unknown, not 0."""
    rows = [(m, a["family"], a["train_seconds"]) for m, a in about.items()]
    extra = scores.sparkSession.createDataFrame(rows, "model string, family string, train_seconds double")
    overall = scores.where(F.col("group_kind") == "overall").select("model", "rmse", "mae", "cv_rmse", "rmsle")
    return evaluate.leaderboard(overall.join(F.broadcast(extra), "model"))  # one row per model


def score_model(model: Regressor, prep: Prepared, train: DataFrame | None = None) -> dict:
    """Fit on `train` (by default the whole fold) and score on validation."""
    model.fit(prep.train if train is None else train, prep.features, time_col=prep.series.time)
    scored = evaluate.score_overall(real_scale(model.predict(prep.val), log_target=prep.log_target)).first().asDict()
    return {"model": model.name, "train_seconds": model.train_seconds, **scored}


def _as_table(spark, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


SCORE_SCHEMA = "model string, n long, rmse double, mae double, cv_rmse double, rmsle double, train_seconds double"


def _slow_first(models: Iterable[str]) -> list[str]:
    """Forests, boosting and trees before lines, so that none of the slow fits is left for the end."""
    slow = ["random_forest", "boosted_trees", "decision_tree"]
    return sorted(models, key=lambda m: slow.index(m) if m in slow else len(slow))


def ablation(prep_of: Callable[[str], Prepared], models: dict[str, dict], at_once: int = 4) -> DataFrame:
    """RMSE of each model on the engineered and on the raw features, side by side. `at_once` models are fitted at a time, so
    that their fit times are not those of lone fits."""
    sets = ("engineered", "raw")
    preps = {name: prep_of(name).learned().stored() for name in sets}
    spark = preps["raw"].train.sparkSession
    which = [(name, m) for m in _slow_first(models) for name in sets]
    rows = side_by_side(spark, [lambda n=n, m=m: score_model(REGISTRY[m](**models[m]), preps[n]) for n, m in which], at_once)
    tables = {name: _as_table(spark, [r for (n, _), r in zip(which, rows) if n == name], SCORE_SCHEMA) for name in sets}
    return compare_runs(tables["engineered"], tables["raw"])


def sample_complexity(
    prep: Prepared, models: dict[str, dict], shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0), at_least: int = 1, at_once: int = 4
) -> DataFrame:
    """Scores of models trained on growing chronological prefixes. Linear models are solved from one scan of all prefixes and
    scored in one pass; their fit time is not known one by one and null. Forests are fitted one after another on rows that are
    binned and dealt out once for all prefixes. Of the others `at_once` are fitted at a time, beside the linear ones and the
    forests, so that their fit times are not those of lone fits. All read folds written with no more than they need."""
    lines = {m: p for m, p in models.items() if m in LINEAR}
    forests = {m: p for m, p in models.items() if REGISTRY[m] is RandomForest}
    spark = prep.train.sparkSession
    kept = prep.learned().stored()
    at = seconds(kept.series.time)

    def fit_lines() -> list[dict]:
        fitted = fit_prefixes(kept.train, kept.features, lines, list(shares), time=kept.series.time, at_least=at_least)
        scored = prefix_scores([m for _, _, m in fitted], kept.val, log_target=kept.log_target)
        rows = [(fitted[r["_k"]], r.asDict()) for r in scored.collect()]  # one row per share and model
        return [{"fraction": float(s), "n_train": n, "model": m.name, "train_seconds": None} | r for (s, n, m), r in rows]

    def fit_forests(cuts: dict[float, tuple[float | None, int]]) -> list[dict]:
        order = sorted(shares, key=lambda s: cuts[s][1])
        outside = [F.lit(0) if cuts[s][0] is None else F.when(at <= cuts[s][0], 0).otherwise(1) for s in order]
        train = kept.train.withColumn("_group", sum(outside, F.lit(0))).where(F.col("_group") < len(order))
        out = []
        for m, params in forests.items():
            rows = REGISTRY[m](**params).nested(train, kept.features, "_group", len(order))
            val = rows.coded(kept.val, "label")
            for k, share in enumerate(order):
                made = REGISTRY[m](**params).fit_group(rows, k)
                scored = evaluate.score_overall(real_scale(made.model.of_coded(*val, "prediction"), log_target=kept.log_target)).first()
                out.append({"fraction": share, "n_train": cuts[share][1], "model": m, "train_seconds": made.train_seconds} | scored.asDict())
        return out

    def fit_one(share: float, model: str, cut: float | None, rows: int) -> list[dict]:
        train = kept.train if cut is None else kept.train.where(at <= cut)
        return [{"fraction": share, "n_train": rows, **score_model(REGISTRY[model](**models[model]), kept, train)}]

    which = [(s, m) for m in _slow_first(models) if m not in LINEAR and m not in forests for s in sorted(shares, reverse=True)]
    cuts = dict(zip(shares, chrono_cuts(kept.train, shares, kept.series.time, at_least))) if which or forests else {}
    fits = ([lambda: fit_forests(cuts)] if forests else []) + ([fit_lines] if lines else []) + [lambda s=s, m=m: fit_one(s, m, *cuts[s]) for s, m in which]
    found = [row for rows in side_by_side(spark, fits, at_once) for row in rows]
    return _as_table(spark, found, "fraction double, n_train long, " + SCORE_SCHEMA)


def imputation_experiment(
    prep_of: Callable[[str], Prepared], strategies: Sequence[str], model: str = "boosted_trees", **params
) -> DataFrame:
    """The same model after each treatment of long zero runs: rows of both folds and the scores on validation.

    `prep_of` prepares the readings of a strategy, best from one table of `clean.all_treatments`."""
    preps = {s: prep_of(s) for s in strategies}
    spark = next(iter(preps.values())).train.sparkSession

    def scored(strategy: str) -> dict:
        prep = preps[strategy].learned().stored()
        sizes = {"strategy": strategy, "n_train": prep.train.count(), "n_val": prep.val.count()}
        return sizes | score_model(REGISTRY[model](**params), prep)

    rows = side_by_side(spark, [lambda s=s: scored(s) for s in strategies])
    return _as_table(spark, rows, "strategy string, n_train long, n_val long, " + SCORE_SCHEMA)


def segment_predictions(
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    segment: str,
    model: str = "boosted_trees",
    min_train: int = 1000,
    time_col: str = "timestamp",
    log_target: bool = True,
    most: int = 200,
    at_once: int = 4,
    **params,
) -> DataFrame:
    """Validation rows with y_true and y_pred, by `model`: "global" for one model of all rows, "own" for a model per
    segment. Segments of fewer than `min_train` training rows have no model of their own.

    Each own model is a distributed job of its own, of which `at_once` run at a time; more than `most` segments are an error.
    """
    read = dict.fromkeys([segment, *features, "label"])  # no more than the models and the scores read
    train, val = durable(train.select(*dict.fromkeys([*read, time_col]))), durable(val.select(*read))
    rows = train.groupBy(segment).count().where(F.col("count") >= min_train).orderBy(segment).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} segments to fit")

    def own(row) -> tuple[DataFrame, str]:
        here = F.col(segment).eqNullSafe(F.lit(row[segment]))
        made = REGISTRY[model](**params).fit(train.where(here), features, time_col=time_col)
        return made.predict(val.where(here)), "own"

    whole = lambda: (REGISTRY[model](**params).fit(train, features, time_col=time_col).predict(val), "global")
    scored = side_by_side(train.sparkSession, [whole, *[lambda r=r: own(r) for r in rows]], at_once)
    frames = [
        real_scale(p, log_target=log_target).select(segment, "y_true", "y_pred", F.lit(name).alias("model")) for p, name in scored
    ]
    return reduce(DataFrame.unionByName, frames)


def segments_together(
    train: DataFrame, val: DataFrame, features: Sequence[str], segment: str, min_train: int = 1000, time_col: str = "timestamp",
    held_share: float = 0.1, log_target: bool = True, **params,
) -> DataFrame:
    """`segment_predictions` for any number of segments: the trees of all of them grow together, and those of the global
    model are the same trees with one segment. The last `held_share` of the training time picks the round of each."""
    read = dict.fromkeys([segment, *features, "label"])  # no more than the trees and the scores read
    train, val = durable(train.select(*dict.fromkeys([*read, time_col]))), durable(val.select(*read))
    last = global_quantiles(train.select(seconds(time_col).alias("s")), "s", [1 - held_share]).first()
    held = seconds(time_col) > last["q"][0] if last is not None else F.lit(False)
    counts = durable(train.groupBy(F.col(segment).alias("_own")).count().where(F.col("count") >= min_train))
    large = train.join(counts, F.col(segment).eqNullSafe(F.col("_own")), "left_semi")
    edges = params.pop("edges", None) or segment_trees.bin_edges(train, features, params.pop("bins", 32))
    fit = lambda df, by: segment_trees.fit(df, features, by, held=held, edges=edges, **params)
    one = lambda df: df.withColumn("_all", F.lit(0))
    own = segment_trees.predict(fit(large, segment), val, segment)
    whole = segment_trees.predict(fit(one(train), "_all"), one(val), "_all").drop("_all")
    frames = [
        real_scale(p, log_target=log_target).select(segment, "y_true", "y_pred", F.lit(name).alias("model")) for p, name in ((whole, "global"), (own, "own"))
    ]
    return reduce(DataFrame.unionByName, frames)


def compare_segments(predictions: DataFrame, segment: str) -> DataFrame:
    """Per segment, and for all segments that have both models (`segment` null, `pooled` true): rows, RMSE, MAE, CV-RMSE and
    RMSLE of the own and of the global model, and the gain in RMSE. A segment without a model of its own keeps its row
    with the scores of the global one."""
    known = predictions.where(F.col("model") == "own").select(F.col(segment).alias("_own")).distinct()
    both = predictions.join(known, F.col(segment).eqNullSafe(F.col("_own")), "left_semi")
    errors = [F.count(F.lit(1)).alias("n"), *score_columns()]
    scored = predictions.groupBy(segment, "model").agg(*errors).withColumn("pooled", F.lit(False))
    none = F.lit(None).cast(predictions.schema[segment].dataType)
    whole = both.groupBy("model").agg(*errors).withColumns({segment: none, "pooled": F.lit(True)})
    metrics = ("n", "rmse", "mae", "cv_rmse", "rmsle")
    pick = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c))).alias(f"{c}_{name}")
    wide = scored.unionByName(whole).groupBy(segment, "pooled").agg(*[pick(m, c) for m in ("own", "global") for c in metrics])
    return wide.withColumn("gain", F.col("rmse_global") - F.col("rmse_own"))


def segment_vs_global(train: DataFrame, val: DataFrame, features: Sequence[str], segment: str, *args, **params) -> DataFrame:
    """`compare_segments` of `segment_predictions`."""
    return compare_segments(durable(segment_predictions(train, val, features, segment, *args, **params)), segment)


def cluster_meters(prep: Prepared, ks: Sequence[int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Labels of all meters and the elbow curve; meters seen only in validation join the nearest centroid."""
    keys = list(prep.series.keys)
    profiles = durable(consumption_profiles(prep.train, keys, prep.series.time))  # read by every fit
    curve = elbow_curve(profiles, ks)
    model = fit_kmeans(profiles, int(pick_elbow(curve).first()["k"]), seed)
    labels = assign_clusters(model, profiles)
    unseen = prep.val.join(labels, keys, "left_anti")
    late = assign_clusters(model, consumption_profiles(unseen, keys, prep.series.time))
    return labels.unionByName(late), curve


