"""Queries on values and groups that ordinary data rarely has: infinities, null keys, raw targets, long tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import clean, evaluate, explore
from meterlake.operators.quantiles import group_quantiles
from meterlake.plans import training
from meterlake.plans.queries.catalog import on, query, r, rounded_scores, scores, sr
from meterlake.session import durable
from meterlake.sources import frames


@query(
    "score_raw_target",
    on(
        "preds",
        f"SELECT {scores()} FROM (SELECT greatest(y_true, 0) AS y_true, greatest(y_pred - 100, 0) AS y_pred FROM preds)",
    ),
)
def score_raw_target(spark, d):
    """Predictions of the reading itself, some of them negative."""
    raw = frames.preds(spark, d).select(F.col("y_true").alias("label"), (F.col("y_pred") - 100).alias("prediction"))
    return evaluate.score_overall(training.real_scale(raw, log_target=False)).select(*rounded_scores())


_HOLED = """SELECT CASE WHEN l_linenumber < 7 THEN building_id END AS building_id, meter, meter_reading AS y, l_orderkey, l_linenumber, l_partkey
    FROM readings"""


@query(
    "cap_outliers_null_keys",
    on(
        "readings",
        f"""SELECT h.building_id, h.meter, l_orderkey, l_linenumber, l_partkey,
        {sr('CASE WHEN y > cap THEN cap ELSE y END', 4, 'y')} FROM holed h
        LEFT JOIN (SELECT building_id, meter, quantile_cont(y, 0.9) AS cap FROM holed GROUP BY ALL) c
        ON h.building_id = c.building_id AND h.meter = c.meter""",
        holed=_HOLED,
    ),
)
def cap_outliers_null_keys(spark, d):
    """Rows of no known building belong to no series and keep their value."""
    known = F.when(F.col("l_linenumber") < 7, F.col("building_id"))
    rows = frames.readings(spark, d).withColumn("building_id", known)
    out = clean.cap_outliers(rows, frames.READINGS, quantile=0.9)
    return out.select("building_id", "meter", "l_orderkey", "l_linenumber", "l_partkey", r("meter_reading", 4, "y"))


_ENDLESS = """SELECT l_returnflag, CASE WHEN l_tax = 0.08 THEN CAST('inf' AS DOUBLE) WHEN l_tax = 0 THEN CAST('-inf' AS DOUBLE)
    WHEN l_linenumber = 5 THEN 1.5e308 WHEN l_linenumber = 6 THEN -1.5e308 ELSE CAST(l_extendedprice AS DOUBLE) END AS v FROM lineitem"""


@query(
    "quantiles_infinite",
    f"""SELECT l_returnflag, {sr("quantile_disc(v, 0.001)::VARCHAR = '-inf'", 0, 'low').replace('round(CAST(', '(').replace(' AS DOUBLE) + 1e-9, 0)', ')')},
    round(quantile_cont(v, 0.4) + 1e-9, 2) AS q40, round(quantile_cont(v, 0.6) + 1e-9, 2) AS q60 FROM ({_ENDLESS}) GROUP BY l_returnflag""",
)
def quantiles_infinite(spark, d):
    """Groups of any size with infinite and huge values, by counting."""
    tax, line = F.col("l_tax"), F.col("l_linenumber")
    value = F.when(tax == 0.08, float("inf")).when(tax == 0, float("-inf")).when(line == 5, 1.5e308).when(line == 6, -1.5e308)
    rows = frames.table(spark, d, "lineitem").withColumn("v", value.otherwise(F.col("l_extendedprice").cast("double")))
    q = group_quantiles(durable(rows), ["l_returnflag"], "v", [0.001, 0.4, 0.6], large_rows=100)
    at = lambda i: F.col("q")[i]
    return q.select("l_returnflag", (at(0) == float("-inf")).alias("low"), r(at(1), 2, "q40"), r(at(2), 2, "q60"))


@query(
    "log_histogram_overflow",
    f"""SELECT bin, {sr('bin * 4.0 / 49', 6, 'low')}, count(*) AS n FROM (SELECT CAST(CASE WHEN log10(l_extendedprice) > 4 THEN 49
    ELSE least(floor(log10(l_extendedprice) / (4.0 / 49)), 48) END AS INTEGER) AS bin FROM lineitem WHERE l_extendedprice > 0) GROUP BY bin""",
)
def log_histogram_overflow(spark, d):
    """Values above the last decade are counted in a bin of their own."""
    out = explore.log_spaced_histogram(frames.table(spark, d, "lineitem"), "l_extendedprice")
    return out.select("bin", r("low", 6), "n")


def _segment_sql(source: str, name: str, pooled: bool) -> str:
    rows = f"(SELECT * FROM {source} WHERE model = '{name}') "
    label = {"lag": "own", "mean": "global"}[name]
    parts = scores().replace(" AS n,", f" AS n_{label},")
    for c in ("rmse", "mae", "cv_rmse", "rmsle"):
        parts = parts.replace(f" AS {c}", f" AS {c}_{label}")
    return f"SELECT {'CAST(NULL AS VARCHAR)' if pooled else 'event_type'} AS event_type, {parts} FROM {rows}" + ("" if pooled else "GROUP BY event_type")


@query(
    "segment_pooled",
    on(
        "model_preds",
        f"""SELECT g.event_type, FALSE AS pooled, o.* EXCLUDE (event_type), g.* EXCLUDE (event_type)
        FROM ({_segment_sql('model_preds', 'mean', False)}) g LEFT JOIN ({_segment_sql("(SELECT * FROM model_preds WHERE event_type <> 'view')", 'lag', False)}) o
        ON g.event_type = o.event_type
        UNION ALL SELECT NULL, TRUE, o.* EXCLUDE (event_type), g.* EXCLUDE (event_type)
        FROM ({_segment_sql("(SELECT * FROM model_preds WHERE event_type <> 'view')", 'mean', True)}) g,
        ({_segment_sql("(SELECT * FROM model_preds WHERE event_type <> 'view')", 'lag', True)}) o""",
    ),
)
def segment_pooled(spark, d):
    """Own (lag) against global (mean) models by event type and pooled; one type has no model of its own."""
    rows = frames.model_preds(spark, d).withColumn("model", F.when(F.col("model") == "lag", "own").otherwise("global"))
    out = training.compare_segments(rows.where("model = 'global' or event_type <> 'view'"), "event_type")
    columns = [f"{c}_{m}" for m in ("own", "global") for c in ("rmse", "mae", "cv_rmse", "rmsle")]
    return out.select("event_type", "pooled", "n_own", "n_global", *[r(c) for c in columns])
