"""Scores of predictions: overall, by group, by model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import metrics
from meterlake.operators.features import lookup
from meterlake.operators.quantiles import group_quantiles

# Names of the meter codes.
METER_NAMES = {0: "electricity", 1: "chilledwater", 2: "steam", 3: "hotwater"}
# Models that predict a sample of the meters only, so their overall score does not compare.
SUBSET_MODELS = ("arima", "lstm")


def _rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def with_meter_name(df: DataFrame) -> DataFrame:
    return df if "meter_name" in df.columns else df.withColumn("meter_name", lookup("meter", METER_NAMES))


def score_overall(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.agg(_rows(), *metrics.score_columns(true, pred))


def score_by(df: DataFrame, group: str, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Row count and the four errors per value of a column, smallest RMSE first; rows without a group are left out."""
    scored = df.where(F.col(group).isNotNull()).groupBy(group).agg(_rows(), *metrics.score_columns(true, pred))
    return scored.orderBy("rmse", group)


def score_by_use(df: DataFrame, **names) -> DataFrame:
    return score_by(df, "primary_use", **names)


def score_by_meter(df: DataFrame, **names) -> DataFrame:
    return score_by(with_meter_name(df), "meter_name", **names)


def score_by_site(df: DataFrame, **names) -> DataFrame:
    return score_by(df, "site_id", **names)


def score_by_building(df: DataFrame, **names) -> DataFrame:
    return score_by(df, "building_id", **names)


def score_by_floored(df: DataFrame, group: str) -> DataFrame:
    """RMSE and CV-RMSE per group, the mean of the actual values held above 1e-6."""
    scored = df.where(F.col(group).isNotNull()).groupBy(group)
    return scored.agg(_rows(), metrics.rmse().alias("rmse"), metrics.cv_rmse_floored().alias("cv_rmse"))


def evaluate_report(
    df: DataFrame, groups: Sequence[str], by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Overall score and the score per value of each grouping column in one pass.

    `group_kind` is the column name or `overall`. With `by`, such as the model, one report per combination. Rows are
    added up by all groups at once first, so that only these sums are repeated for every grouping.
    """
    by = list(by)
    kept = [*by, *[F.col(g).cast("string").alias(g) for g in groups]]
    rows = df.select(*kept, F.col(true).alias("y_true"), F.col(pred).alias("y_pred"))
    sums = rows.groupBy(*by, *groups).agg(*metrics.score_sums())
    sets = [[*by, g] for g in groups] + [by]
    marks = [F.grouping(g).alias(f"_{g}") for g in groups]
    scored = sums.groupingSets(sets, *by, *groups).agg(*marks, F.sum("_n").alias("n"), *metrics.scores_of_sums())
    in_set = [F.col(f"_{g}") == 0 for g in groups]
    kind = F.coalesce(*[F.when(m, F.lit(g)) for m, g in zip(in_set, groups)], F.lit("overall"))
    value = F.coalesce(*[F.when(m, F.col(g)) for m, g in zip(in_set, groups)])
    return scored.select(*by, kind.alias("group_kind"), value.alias("group"), "n", "rmse", "mae", "cv_rmse", "rmsle").where(
        (F.col("group_kind") == "overall") | F.col("group").isNotNull()
    )


def nested_report(report: DataFrame, by: str = "model") -> DataFrame:
    """One row per model: its overall errors and an array of group rows for every grouping."""
    errors = F.struct("n", "rmse", "mae", "cv_rmse", "rmsle")
    kinds = F.struct("group_kind", "group", "n", "rmse", "mae", "cv_rmse", "rmsle")
    return report.groupBy(by).agg(
        F.max(F.when(F.col("group_kind") == "overall", errors)).alias("overall"),
        # one entry per use, meter type and site
        F.array_sort(F.collect_list(F.when(F.col("group_kind") != "overall", kinds))).alias("groups"),
    )


def residuals_by_hour(df: DataFrame, time: str = "timestamp") -> DataFrame:
    gap = F.col("y_pred") - F.col("y_true")
    return df.groupBy(F.hour(time).alias("hour")).agg(F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"))


def residuals_by(df: DataFrame, group: str) -> DataFrame:
    """Bias, RMSE and the 99th percentile of the absolute error per group."""
    spread = group_quantiles(df.withColumn("_e", F.abs(F.col("y_pred") - F.col("y_true"))), [group], "_e", [0.99])
    scored = df.groupBy(group).agg(_rows(), metrics.bias().alias("bias"), metrics.rmse().alias("rmse"))
    return scored.join(spread.select(group, F.col("q")[0].alias("p99_abs")), group, "left")


def worst_meters(df: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """Per meter: rows, mean, RMSE, bias and the rest of the error, worst first."""
    scored = df.groupBy(*keys).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in carried],
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("y_true").alias("mean_actual"),
        metrics.rmse().alias("rmse"),
        metrics.bias().alias("bias"),
        metrics.spread().alias("variance_component"),
    )
    return scored.orderBy(F.desc("rmse"), *keys)


def worst_buildings(df: DataFrame, keys: Sequence[str] = ("building_id", "primary_use"), k: int = 20) -> DataFrame:
    """The k buildings with the largest mean absolute error."""
    return df.groupBy(*keys).agg(metrics.mae().alias("abs_err")).orderBy(F.desc("abs_err"), *keys).limit(k)


def compare_models(df: DataFrame, group: str, a: str, b: str, model: str = "model") -> DataFrame:
    """RMSE of two models per group, with ratio, difference and gain in percent of the second."""
    gap = F.pow(F.col("y_true") - F.col("y_pred"), 2)
    both = df.where(F.col(model).isin(a, b)).groupBy(group).agg(
        F.count(F.when(F.col(model) == a, 1)).alias("n"),
        F.sqrt(F.avg(F.when(F.col(model) == a, gap))).alias("rmse_a"),
        F.sqrt(F.avg(F.when(F.col(model) == b, gap))).alias("rmse_b"),
    )
    delta = F.col("rmse_b") - F.col("rmse_a")
    nothing = F.lit(0.0)
    return both.withColumns(
        {
            "ratio": F.col("rmse_a") / F.nullif(F.col("rmse_b"), nothing),
            "delta": delta,
            "pct_improvement": 100 * delta / F.nullif(F.col("rmse_b"), nothing),
        }
    )


def failure_long(report: DataFrame) -> DataFrame:
    """Group scores as one row per model, group and metric."""
    groups = report.where(F.col("group_kind") != "overall")
    return groups.unpivot(["model", "group_kind", "group"], ["rmse", "cv_rmse", "mae"], "metric", "value")


def failure_pivot(report: DataFrame, kind: str, models: Sequence[str]) -> DataFrame:
    """RMSE with one row per group and one column per model."""
    return report.where(F.col("group_kind") == kind).groupBy("group").pivot("model", list(models)).agg(F.avg("rmse"))


def worst_groups(report: DataFrame, k: int = 3) -> DataFrame:
    """The k groups with the largest RMSE for each model and grouping."""
    w = Window.partitionBy("model", "group_kind").orderBy(F.desc("rmse"), "group")
    ranked = report.where(F.col("group_kind") != "overall").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= k).select("model", "group_kind", "place", "group", "rmse")


def leaderboard(results: DataFrame, metric: str = "rmse") -> DataFrame:
    return results.orderBy(metric, "model")


def best_model(results: DataFrame, metric: str = "rmse", excluded: Sequence[str] = SUBSET_MODELS) -> DataFrame:
    """The model with the smallest error among those that predict every row."""
    rest = results.where(~F.col("model").isin(*excluded)) if excluded else results
    return rest.agg(F.min_by("model", metric).alias("model"), F.min(metric).alias(metric))


def pick_cases(df: DataFrame, condition, smallest_error: bool, among, k: int = 50) -> DataFrame:
    """Rows that meet the condition; where there are none, the k rows with the smallest (largest) error `among`
    the candidates.
    """
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    rows = df.withColumn("abs_err", error)
    hits = rows.where(condition)
    order = F.col("abs_err").asc() if smallest_error else F.col("abs_err").desc()
    rest = [c for c in df.columns if c not in ("y_true", "y_pred")]
    fallback = rows.where(among).orderBy(order, *rest).limit(k)
    found = hits.agg(F.count(F.lit(1)))
    return hits.unionByName(fallback.where(found.scalar() == 0))
