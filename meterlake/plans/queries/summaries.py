"""Queries for scores, breakdowns, rankings and tables that describe the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import clean, evaluate, explore, features, segments
from meterlake.operators.joins import group_mean_lookup, join_context
from meterlake.operators.split import split_at, split_summary
from meterlake.plans.queries.catalog import on, query, r, rounded_scores, scores, sr, sstamp, stamp
from meterlake.plans.queries.tables import CUT, us_holiday
from meterlake.plans.training import GROUPS
from meterlake.session import durable
from meterlake.sources import frames

TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MODELS = ["lag", "mean"]
ERRORS = ["rmse", "mae", "cv_rmse", "rmsle"]


def building_preds(spark, d):
    """Orders predicted by nine tenths of the mean of their building."""
    daily = frames.daily(spark, d)
    rows = group_mean_lookup(daily, daily, ["building_id"], "y", "y_pred")
    return rows.withColumn("y_pred", F.col("y_pred") * 0.9).withColumnRenamed("y", "y_true")


# ---- scores


@query("score_overall", on("preds", f"SELECT {scores()} FROM preds"))
def score_overall(spark, d):
    return evaluate.score_overall(frames.preds(spark, d)).select(*rounded_scores())


def _score(column: str):
    return on("building_preds", f"SELECT {column}, {scores(places=3)} FROM building_preds GROUP BY {column}")


@query("score_by_use", _score("primary_use"))
def score_by_use(spark, d):
    return evaluate.score_by_use(building_preds(spark, d)).select("primary_use", *rounded_scores(3))


@query("score_by_site", _score("site_id"))
def score_by_site(spark, d):
    return evaluate.score_by_site(building_preds(spark, d)).select("site_id", *rounded_scores(3))


@query("score_by_building", _score("building_id"))
def score_by_building(spark, d):
    return evaluate.score_by_building(building_preds(spark, d)).select("building_id", *rounded_scores(3))


@query("score_by_meter", on("preds", f"SELECT event_type AS meter_name, {scores()} FROM preds GROUP BY event_type"))
def score_by_meter(spark, d):
    named = frames.preds(spark, d).withColumnRenamed("event_type", "meter_name")
    return evaluate.score_by_meter(named).select("meter_name", *rounded_scores())


@query(
    "score_by_use_floor",
    on(
        "building_preds",
        f"""SELECT primary_use, count(*) AS n, {sr('sqrt(avg(pow(y_true - y_pred, 2)))', 3, 'rmse')},
        {sr('sqrt(avg(pow(y_true - y_pred, 2))) / greatest(avg(y_true), 1e-6)', 4, 'cv_rmse')} FROM building_preds GROUP BY primary_use""",
    ),
)
def score_by_use_floor(spark, d):
    out = evaluate.score_by_floored(building_preds(spark, d), "primary_use")
    return out.select("primary_use", "n", r("rmse", 3), r("cv_rmse"))


@query(
    "evaluate_report",
    on(
        "building_preds",
        " UNION ALL ".join(
            f"SELECT '{g}' AS group_kind, CAST({g} AS VARCHAR) AS \"group\", {scores(places=3)} FROM building_preds GROUP BY {g}"
            for g in ("primary_use", "meter_name", "site_id")
        ).replace("meter_name AS", "meter AS").replace("CAST(meter_name", "CAST(meter").replace("GROUP BY meter_name", "GROUP BY meter")
        + f" UNION ALL SELECT 'overall', NULL, {scores(places=3)} FROM building_preds",
    ),
)
def evaluate_report(spark, d):
    named = building_preds(spark, d).withColumn("meter_name", F.col("meter"))
    return evaluate.evaluate_report(named, GROUPS).select("group_kind", "group", *rounded_scores(3))


_LONG_REPORT = """SELECT model, 'event_type' AS group_kind, event_type AS "group", sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
    avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) / avg(y_true) AS cv_rmse FROM model_preds GROUP BY model, event_type"""


def _model_report(spark, d):
    return evaluate.evaluate_report(frames.model_preds(spark, d), ["event_type"], ["model"])


@query(
    "failure_long",
    on(
        "model_preds",
        f"""SELECT model, group_kind, "group", metric, {sr('value')} FROM report UNPIVOT (value FOR metric IN (rmse, cv_rmse, mae))""",
        report=_LONG_REPORT,
    ),
)
def failure_long(spark, d):
    return evaluate.failure_long(_model_report(spark, d)).withColumn("value", r("value"))


@query(
    "failure_pivot",
    on(
        "model_preds",
        f"""SELECT "group", {sr("max(CASE WHEN model = 'lag' THEN rmse END)", 4, 'lag')},
        {sr("max(CASE WHEN model = 'mean' THEN rmse END)", 4, 'mean')} FROM report GROUP BY "group" """,
        report=_LONG_REPORT,
    ),
)
def failure_pivot(spark, d):
    return evaluate.failure_pivot(_model_report(spark, d), "event_type", MODELS).select("group", r("lag"), r("mean"))


@query(
    "failure_top3",
    on(
        "model_preds",
        f"""SELECT model, group_kind, CAST(place AS INTEGER) AS place, "group", {sr('rmse')} FROM (SELECT *,
        row_number() OVER (PARTITION BY model, group_kind ORDER BY rmse DESC, "group") AS place FROM report) WHERE place <= 3""",
        report=_LONG_REPORT,
    ),
)
def failure_top3(spark, d):
    return evaluate.worst_groups(_model_report(spark, d)).withColumn("rmse", r("rmse"))


@query(
    "model_ratio_by_group",
    on(
        "model_preds",
        f"""SELECT event_type, n, {sr('a', 4, 'rmse_a')}, {sr('b', 4, 'rmse_b')}, {sr('a / b', 4, 'ratio')}, {sr('b - a', 4, 'delta')},
        {sr('100 * (b - a) / b', 4, 'pct_improvement')} FROM (SELECT event_type, count(*) FILTER (model = 'lag') AS n,
        sqrt(avg(pow(y_true - y_pred, 2)) FILTER (model = 'lag')) AS a, sqrt(avg(pow(y_true - y_pred, 2)) FILTER (model = 'mean')) AS b
        FROM model_preds GROUP BY event_type)""",
    ),
)
def model_ratio_by_group(spark, d):
    out = evaluate.compare_models(frames.model_preds(spark, d), "event_type", "lag", "mean")
    return out.select("event_type", "n", *[r(c) for c in ("rmse_a", "rmse_b", "ratio", "delta", "pct_improvement")])


@query(
    "leaderboard",
    on(
        "model_preds",
        f"SELECT model, {scores()} FROM model_preds GROUP BY model",
    ),
)
def leaderboard(spark, d):
    overall = _model_report(spark, d).where(F.col("group_kind") == "overall")
    return evaluate.leaderboard(overall).select("model", *rounded_scores())


@query(
    "best_model",
    on(
        "model_preds",
        f"""SELECT model, {sr('rmse')} FROM (SELECT model, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM model_preds GROUP BY model)
        ORDER BY 2 LIMIT 1""",
    ),
)
def best_model(spark, d):
    overall = _model_report(spark, d).where(F.col("group_kind") == "overall")
    return evaluate.best_model(overall).withColumn("rmse", r("rmse"))


@query(
    "residuals_by_hour",
    on(
        "preds",
        f"""SELECT CAST(hour(ts) AS INTEGER) AS hour, {sr('avg(y_pred - y_true)', 4, 'mean')}, {sr('stddev_samp(y_pred - y_true)', 4, 'std')}
        FROM preds GROUP BY 1""",
    ),
)
def residuals_by_hour(spark, d):
    return evaluate.residuals_by_hour(frames.preds(spark, d), "ts").select("hour", r("mean"), r("std"))


@query(
    "residuals_by_meter",
    on(
        "preds",
        f"""SELECT event_type, count(*) AS n, {sr('avg(y_pred - y_true)', 4, 'bias')}, {sr('sqrt(avg(pow(y_true - y_pred, 2)))', 4, 'rmse')},
        {sr('quantile_cont(abs(y_pred - y_true), 0.99)', 4, 'p99_abs')} FROM preds GROUP BY event_type""",
    ),
)
def residuals_by_meter(spark, d):
    out = evaluate.residuals_by(frames.preds(spark, d), "event_type")
    return out.select("event_type", "n", r("bias"), r("rmse"), r("p99_abs"))


@query(
    "worst_meter_audit",
    on(
        "building_preds",
        f"""SELECT building_id, meter, any_value(primary_use) AS primary_use, any_value(site_id) AS site_id, count(*) AS n_rows,
        {sr('avg(y_true)', 3, 'mean_actual')}, {sr('sqrt(avg(pow(y_true - y_pred, 2)))', 3, 'rmse')}, {sr('avg(y_pred - y_true)', 3, 'bias')},
        {sr('stddev_pop(y_pred - y_true)', 3, 'variance_component')} FROM building_preds GROUP BY building_id, meter""",
    ),
)
def worst_meter_audit(spark, d):
    out = evaluate.worst_meters(building_preds(spark, d), ["building_id", "meter"], ["primary_use", "site_id"])
    errors = [r(c, 3) for c in ("mean_actual", "rmse", "bias", "variance_component")]
    return out.select("building_id", "meter", "primary_use", "site_id", "n_rows", *errors)


@query(
    "worst_buildings",
    on(
        "building_preds",
        f"""SELECT building_id, primary_use, {sr('e', 3, 'abs_err')} FROM (SELECT building_id, primary_use, avg(abs(y_pred - y_true)) AS e
        FROM building_preds GROUP BY building_id, primary_use ORDER BY e DESC, building_id LIMIT 20)""",
    ),
)
def worst_buildings(spark, d):
    return evaluate.worst_buildings(building_preds(spark, d)).withColumn("abs_err", r("abs_err", 3))


# ---- descriptions


@query(
    "split_summary",
    on(
        "hourly",
        f"""SELECT CASE WHEN ts < TIMESTAMP '{CUT}' THEN 'train' ELSE 'val' END AS fold, count(*) AS "rows",
        {sstamp('min(ts)', 'first')}, {sstamp('max(ts)', 'last')}, count(DISTINCT event_type) AS buildings FROM hourly GROUP BY 1""",
    ),
)
def summary_of_split(spark, d):
    out = split_summary(*split_at(frames.hourly(spark, d), CUT, "ts"), "ts", "event_type")
    return out.select("fold", "rows", stamp("first"), stamp("last"), "buildings")


@query(
    "site_summary",
    on(
        "daily",
        f"""SELECT site_id, count(*) AS "rows", count(DISTINCT building_id) AS buildings, count(DISTINCT meter) AS meters,
        {sr('avg(y)', 2, 'mean_reading')} FROM daily GROUP BY site_id""",
    ),
)
def site_summary(spark, d):
    return explore.site_summary(frames.daily(spark, d), "y").withColumn("mean_reading", r("mean_reading", 2))


@query(
    "category_breakdown",
    on(
        "daily",
        f"""SELECT primary_use, count(*) AS "rows", {sr('avg(y)', 2, 'mean')}, count(DISTINCT building_id) AS distinct_building_id
        FROM daily GROUP BY primary_use""",
    ),
)
def category_breakdown(spark, d):
    out = explore.category_breakdown(frames.daily(spark, d), "primary_use", "y", "building_id")
    return out.withColumn("mean", r("mean", 2))


_GAPS = ["air_temperature", "dew_temperature", "cloud_coverage", "precip_depth_1_hr"]


@query(
    "missingness",
    on(
        "weather",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {sr(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 6, 'missing')} FROM weather" for c in _GAPS
        ),
    ),
)
def missingness(spark, d):
    return explore.missingness(frames.weather(spark, d), _GAPS).withColumn("missing", r("missing", 6))


@query(
    "missingness_by_site",
    on(
        "weather",
        "SELECT site_id, " + ", ".join(sr(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", 6, c) for c in _GAPS) + " FROM weather GROUP BY site_id",
    ),
)
def missingness_by_site(spark, d):
    out = explore.missingness_by(frames.weather(spark, d), "site_id", _GAPS)
    return out.select("site_id", *[r(c, 6) for c in _GAPS])


@query(
    "calendar_means",
    on(
        "daily",
        f"""SELECT 'weekday' AS part, CAST(isodow(ts) - 1 AS INTEGER) AS value, {sr('avg(y)', 2, 'mean')} FROM daily GROUP BY 2
        UNION ALL SELECT 'month', CAST(month(ts) AS INTEGER), {sr('avg(y)', 2, 'mean')} FROM daily GROUP BY 2""",
    ),
)
def calendar_means(spark, d):
    return explore.calendar_means(frames.daily(spark, d), "ts", "y").withColumn("mean", r("mean", 2))


@query(
    "holiday_weekend_means",
    on(
        "daily",
        f"""SELECT is_weekend, is_holiday, (CASE is_weekend WHEN 1 THEN 'Weekend ' ELSE 'Weekday ' END)
        || (CASE is_holiday WHEN 1 THEN 'holiday' ELSE 'non-holiday' END) AS bucket, {sr('avg(y)', 2, 'mean')} FROM flagged GROUP BY ALL""",
        flagged=f"""SELECT y, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
        CAST(CASE WHEN {us_holiday('ts')} THEN 1 ELSE 0 END AS INTEGER) AS is_holiday FROM daily""",
    ),
)
def holiday_weekend_means(spark, d):
    flagged = features.add_time_features(frames.daily(spark, d).drop("site_id"), "ts")
    return explore.holiday_weekend_means(flagged, "y").withColumn("mean", r("mean", 2))


@query(
    "pivot_use_meter",
    on(
        "daily",
        "SELECT primary_use, " + ", ".join(sr(f"coalesce(avg(y) FILTER (meter = '{p}'), 0)", 1, f'"{p}"') for p in PRIORITIES) + " FROM daily GROUP BY primary_use",
    ),
)
def pivot_use_meter(spark, d):
    out = explore.mean_pivot(frames.daily(spark, d), "primary_use", "meter", PRIORITIES, "y", 0.0)
    return out.select("primary_use", *[r(F.col(f"`{p}`"), 1, p) for p in PRIORITIES])


@query(
    "hourly_profile",
    on(
        "hourly",
        "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(sr(f"avg(y) FILTER (event_type = '{t}')", 4, t) for t in TYPES) + " FROM hourly GROUP BY 1",
    ),
)
def hourly_profile(spark, d):
    return explore.hourly_profile(frames.hourly(spark, d), "event_type", TYPES, "ts", "y").select("hour", *[r(t) for t in TYPES])


@query(
    "weekly_profile",
    """WITH top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 4)
    SELECT user_id, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS bucket, round(avg(value) + 1e-9, 4) AS mean
    FROM events WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""",
)
def weekly_profile(spark, d):
    return explore.weekly_profile(frames.table(spark, d, "events"), "user_id", 4, "ts", "value").withColumn("mean", r("mean"))


@query(
    "top_hourly_profile",
    """WITH top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 5)
    SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value) + 1e-9, 4) AS mean
    FROM events WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""",
)
def top_hourly_profile(spark, d):
    return explore.top_hourly_profile(frames.table(spark, d, "events"), "user_id", 5, "ts", "value").withColumn("mean", r("mean"))


_MEASURES = ["y", "square_feet", "year_built", "air_temperature"]


@query(
    "correlation_matrix",
    on(
        "daily weather",
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, "
            + (sr("1.0", 5, "corr") if a == b else sr(f"corr({a}, {b})", 5, "corr"))
            + " FROM joined"
            + (" GROUP BY 1" if a == b else "")
            for a in _MEASURES
            for b in _MEASURES
        ),
        joined='SELECT d.*, w.air_temperature FROM daily d LEFT JOIN weather w ON d.site_id = w.site_id AND d.ts = w."timestamp"',
    ),
)
def correlation_matrix(spark, d):
    daily = frames.daily(spark, d).withColumnRenamed("ts", "timestamp")
    joined = daily.join(durable(frames.weather(spark, d)), ["site_id", "timestamp"], "left")
    return explore.correlation_matrix(joined, _MEASURES).withColumn("corr", r("corr", 5))


def _bins(value: str, table: str, bins: int, low: str, high: str) -> str:
    width = f"(({high}) - ({low})) / {bins}"
    return f"""SELECT bin, round(lo + bin * w + 1e-9, 4) AS low, count(*) AS n FROM (SELECT
        CAST(least(floor((x - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM (SELECT {value} AS x, {low} AS lo, {high} AS hi, {width} AS w
        FROM {table}) WHERE x BETWEEN lo AND hi) GROUP BY bin, lo, w"""


@query("histogram", _bins("l_extendedprice", "lineitem", 80, "(SELECT min(l_extendedprice) FROM lineitem)", "(SELECT max(l_extendedprice) FROM lineitem)"))
def histogram(spark, d):
    return explore.target_histogram(frames.table(spark, d, "lineitem"), "l_extendedprice").withColumn("low", r("low"))


@query(
    "histogram_log",
    "WITH pos AS (SELECT ln(1 + c_acctbal) AS v FROM customer WHERE c_acctbal > 0) "
    + _bins("v", "pos", 80, "(SELECT min(v) FROM pos)", "(SELECT max(v) FROM pos)"),
)
def histogram_log(spark, d):
    return explore.log_target_histogram(frames.table(spark, d, "customer"), "c_acctbal").withColumn("low", r("low"))


@query(
    "box_stats",
    on(
        "meta",
        f"""SELECT primary_use, {sr('q1')}, {sr('median')}, {sr('q3')},
        min(square_feet) FILTER (square_feet BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
        max(square_feet) FILTER (square_feet BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high
        FROM meta JOIN (SELECT primary_use, quantile_cont(square_feet, 0.25) AS q1, quantile_cont(square_feet, 0.5) AS median,
        quantile_cont(square_feet, 0.75) AS q3 FROM meta GROUP BY primary_use) USING (primary_use) GROUP BY primary_use, q1, median, q3""",
    ),
)
def box_stats(spark, d):
    out = explore.box_stats(frames.meta(spark, d), "primary_use", "square_feet")
    return out.select("primary_use", r("q1"), r("median"), r("q3"), "low", "high")


@query(
    "density_by_site",
    on(
        "weather",
        f"""SELECT site_id, CAST(point AS INTEGER) AS point, {sr('lo + point * (hi - lo) / 63', 6, 'x')},
        {sr("sum(c / n * exp(-0.5 * pow((lo + point * (hi - lo) / 63 - (lo + (cell + 0.5) * (hi - lo) / 256)) / bw, 2)) / (bw * sqrt(2 * pi())))", 6, 'density')}
        FROM cells JOIN widths USING (site_id), ends, unnest(generate_series(0, 63)) AS g(point) GROUP BY site_id, point, lo, hi""",
        known="SELECT site_id, air_temperature AS v FROM weather WHERE air_temperature IS NOT NULL",
        ends="SELECT min(v) AS lo, max(v) AS hi FROM known",
        cells="SELECT site_id, least(floor((v - lo) / ((hi - lo) / 256)), 255) AS cell, count(*) AS c FROM known, ends GROUP BY ALL",
        widths="SELECT site_id, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM known GROUP BY site_id",
    ),
)
def density_by_site(spark, d):
    out = explore.density_by(frames.weather(spark, d), "site_id", "air_temperature")
    return out.select("site_id", "point", r("x", 6), r("density", 6))


@query(
    "temperature_response",
    on(
        "readings meta weather",
        f"""SELECT meter, CAST(floor(air_temperature) AS INTEGER) AS degree, {sr('avg(ln(1 + greatest(meter_reading, 0)))', 5, 'mean_log')}, count(*) AS n
        FROM readings r JOIN meta m USING (building_id) JOIN weather w ON m.site_id = w.site_id AND r."timestamp" = w."timestamp"
        WHERE air_temperature IS NOT NULL GROUP BY 1, 2""",
    ),
)
def temperature_response(spark, d):
    joined = join_context(frames.readings(spark, d), frames.meta(spark, d), durable(frames.weather(spark, d)))
    return explore.temperature_response(joined).withColumn("mean_log", r("mean_log", 5))


@query(
    "distinct_series",
    on(
        "readings",
        """SELECT count(DISTINCT building_id) AS n_building_id, count(DISTINCT meter) AS n_meter, count(DISTINCT (building_id, meter)) AS n_series
        FROM readings""",
    ),
)
def distinct_series(spark, d):
    return explore.distinct_series(frames.readings(spark, d))


@query(
    "topk_series",
    on("readings", 'SELECT building_id, meter, count(*) AS "rows" FROM readings GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 3'),
)
def topk_series(spark, d):
    return explore.top_series(frames.readings(spark, d), ["building_id", "meter"])


@query(
    "first_last_per_group",
    """WITH first AS (SELECT c_mktsegment, min(c_custkey) AS first_building FROM customer GROUP BY c_mktsegment),
    last AS (SELECT * FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k
    FROM events) WHERE k <= 168)
    SELECT c_mktsegment AS name, 'first' AS kind, first_building AS id FROM first
    UNION ALL SELECT event_type, 'last', event_id FROM last""",
)
def first_last_per_group(spark, d):
    first = explore.first_by_group(frames.meta(spark, d), "primary_use", "building_id", "building_id")
    last = explore.last_rows(frames.table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 168)
    head = first.select(F.col("primary_use").alias("name"), F.lit("first").alias("kind"), F.col("building_id").alias("id"))
    return head.unionAll(last.select("event_type", F.lit("last"), "event_id"))


# ---- profiles


PROFILE_MEANS = (
    "SELECT user_id, " + ", ".join(f"coalesce(avg(value) FILTER (hour(ts) = {h}), 0) AS h{h:02d}" for h in range(24)) + " FROM events GROUP BY user_id"
)
PROFILE_TOTAL = "(" + " + ".join(segments.HOURS) + ")"
_SHARES = ", ".join(sr(f"{h} / CASE WHEN {PROFILE_TOTAL} > 0 THEN {PROFILE_TOTAL} ELSE 1 END", 6, h) for h in segments.HOURS)


@query("consumption_profile", f"WITH means AS ({PROFILE_MEANS}) SELECT user_id, {_SHARES} FROM means")
def consumption_profile(spark, d):
    out = segments.consumption_profiles(frames.table(spark, d, "events"), ["user_id"], "ts", "value")
    return out.select("user_id", *[r(h, 6) for h in segments.HOURS])


@query(
    "elbow_pick",
    """WITH curve AS (SELECT l_linenumber AS k, sum(l_extendedprice) / pow(l_linenumber, 2) AS inertia FROM lineitem GROUP BY l_linenumber),
    ends AS (SELECT min(k) AS k0, max(k) AS k1, arg_min(inertia, k) AS i0, arg_max(inertia, k) AS i1 FROM curve)
    SELECT CAST(k AS INTEGER) AS k FROM curve, ends
    ORDER BY abs((i1 - i0) * (k - k0) - (k1 - k0) * (inertia - i0)) DESC, k LIMIT 1""",
)
def elbow_pick(spark, d):
    lines = frames.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k"))
    curve = lines.agg(F.sum("l_extendedprice").alias("_s")).withColumn("inertia", F.col("_s") / F.pow("k", F.lit(2)))
    return segments.pick_elbow(curve.select("k", "inertia"))


# ---- caps


@query(
    "cap_outliers",
    on(
        "readings",
        f"""SELECT building_id, meter, l_orderkey, {sr('least(meter_reading, cap)', 4, 'meter_reading')} FROM readings
        JOIN (SELECT building_id, meter, quantile_cont(meter_reading, 0.95) AS cap FROM readings GROUP BY ALL) USING (building_id, meter)""",
    ),
)
def cap_outliers(spark, d):
    out = clean.cap_outliers(frames.readings(spark, d), frames.READINGS, quantile=0.95)
    return out.select("building_id", "meter", "l_orderkey", r("meter_reading"))
