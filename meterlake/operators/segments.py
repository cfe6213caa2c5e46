"""Daily consumption profiles and their clusters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.lloyd import fit_all
from meterlake.session import durable

HOURS = [f"h{hour:02d}" for hour in range(24)]


def consumption_profiles(
    df: DataFrame, keys: Sequence[str] = ("building_id", "meter"), time: str = "timestamp", value: str = "meter_reading"
) -> DataFrame:
    """Mean reading per hour of the day for each meter, missing hours 0, scaled to sum 1 where the sum is positive."""
    means = df.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(F.hour(time) == hour, F.col(value))), F.lit(0.0)).alias(name) for hour, name in enumerate(HOURS)]
    )
    whole = sum((F.col(h) for h in HOURS), F.lit(0.0))
    scaled = means.withColumn("_sum", whole)
    divisor = F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.lit(1.0))
    return scaled.select(*keys, *[(F.col(h) / divisor).alias(h) for h in HOURS])


def as_vectors(profiles: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=HOURS, outputCol="profile").transform(profiles)


def fit_kmeans(profiles: DataFrame, k: int, seed: int = 42, max_iter: int = 300) -> KMeansModel:
    """k clusters, or one per distinct profile where these are fewer."""
    found = profiles.select(*HOURS).distinct().limit(k).count()
    if found < 2:
        raise ValueError("clustering needs at least two distinct profiles")
    means = KMeans(k=min(k, found), seed=seed, maxIter=max_iter, featuresCol="profile", predictionCol="cluster")
    return means.fit(as_vectors(profiles))


def assign_clusters(model: KMeansModel, profiles: DataFrame) -> DataFrame:
    """Label of the nearest centroid; works for profiles that were not in the fit."""
    return model.transform(as_vectors(profiles)).drop("profile", *HOURS)


def centroids(spark: SparkSession, model: KMeansModel) -> DataFrame:
    rows = [(i, *map(float, centre)) for i, centre in enumerate(model.clusterCenters())]  # k rows
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{h} double" for h in HOURS))


def elbow_curve(profiles: DataFrame, ks: Iterable[int]) -> DataFrame:
    """Inertia, which never rises with k, and iterations for each number of clusters."""
    _, cost, n_iter = fit_all(profiles, HOURS, ks)
    rows = [(k, float(cost[k]), n_iter[k]) for k in sorted(cost)]
    return profiles.sparkSession.createDataFrame(rows, "k int, inertia double, n_iter int")


def pick_elbow(curve: DataFrame) -> DataFrame:
    """The k farthest from the line between the first and the last point; the first k where points are fewer than 3."""
    curve = durable(curve)  # a few rows, read several times below
    first = F.struct("k", "inertia")
    ends = curve.agg(
        F.min_by(first, "k").alias("a"), F.max_by(first, "k").alias("b"), F.count(F.lit(1)).alias("n")
    )
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    run, rise = b["k"] - a["k"], b["inertia"] - a["inertia"]
    off = F.abs(rise * (F.col("k") - a["k"]) - run * (F.col("inertia") - a["inertia"]))
    distance = off / F.sqrt(run * run + rise * rise)
    judged = curve.withColumn("distance", F.when(ends.select("n").scalar() >= 3, distance).otherwise(-F.col("k").cast("double")))
    # the largest distance, the smallest k among equals
    return judged.agg(F.max_by("k", F.struct("distance", -F.col("k"))).alias("k"))


def cluster_composition(df: DataFrame, cluster: str = "cluster", category: str = "primary_use") -> DataFrame:
    """Share of each category in each cluster, in percent."""
    counts = df.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(cluster).agg(F.sum("n").alias("total"))
    return counts.join(totals, cluster).withColumn("pct", 100.0 * F.col("n") / F.col("total")).drop("total")


def cluster_means(profiles: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean profile of the members of each cluster."""
    return profiles.join(labels, list(keys)).groupBy("cluster").agg(*[F.avg(h).alias(h) for h in HOURS])
