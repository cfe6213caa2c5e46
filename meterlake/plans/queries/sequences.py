"""Queries for ordered series: history, runs, gaps, windows, folds, forecasts, and the prepare job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import clean, evaluate, explore, features, forecast, seasonal, split, windows
from meterlake.plans.prepare import prepare
from meterlake.plans.queries.catalog import SQL, on, query, r, rounded_scores, scores, sr, sstamp, stamp
from meterlake.plans.queries.tables import EASTER, site_holiday
from meterlake.plans.queries.tables import CUT, KEYS
from meterlake.plans.training import baseline_lag
from meterlake.session import durable
from meterlake.sources import frames, tables

# ---- lags and rolling frames


@query(
    "lag_features",
    on(
        "hourly",
        f"""SELECT event_type, {sstamp('ts')}, y, lag(y, 24) OVER w AS lag_24h, lag(y, 168) OVER w AS lag_168h,
        {sr('lag(y, 24) OVER w - lag(y, 168) OVER w', 4, 'lag_diff_24h')} FROM hourly WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
    ),
)
def lag_features(spark, d):
    out = features.add_lag_features(frames.hourly(spark, d), frames.HOURLY, "y")
    return out.select("event_type", stamp("ts"), "y", "lag_24h", "lag_168h", r("lag_diff_24h"))


def _rolling_sql(n: int) -> str:
    frame = f"OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return ", ".join(
        sr(f"CASE WHEN count(y) {frame} >= {n // 4} THEN {f}(y) {frame} END", 4, f"rolling_{name}_{n}h")
        for f, name in (("avg", "mean"), ("stddev_samp", "std"))
    )


@query("rolling_features", on("hourly", f"SELECT event_type, {sstamp('ts')}, {_rolling_sql(24)}, {_rolling_sql(168)} FROM hourly"))
def rolling_features(spark, d):
    out = features.add_rolling_features(frames.hourly(spark, d), frames.HOURLY, "y")
    names = [f"rolling_{s}_{n}h" for n in (24, 168) for s in ("mean", "std")]
    return out.select("event_type", stamp("ts"), *[r(c) for c in names])


@query(
    "baseline_lag",
    on("preds", f"SELECT event_type AS meter_name, {scores()} FROM preds WHERE ts >= TIMESTAMP '{CUT}' GROUP BY event_type"),
)
def baseline_lag_scores(spark, d):
    """How good is yesterday's value as a forecast, by meter type?"""
    lagged = features.add_lag_features(frames.hourly(spark, d), frames.HOURLY, "y", (24,))
    _, val = split.split_at(lagged, CUT, "ts")
    scored = evaluate.score_by(baseline_lag(val, "y").withColumn("meter_name", F.col("event_type")), "meter_name")
    return scored.select("meter_name", *rounded_scores())


# ---- runs of zeros

_ZERO = dict(
    flagged="""SELECT *, CASE WHEN y = 0 THEN 1 ELSE 0 END AS z,
        CASE WHEN y = 0 AND lag(y) OVER w = 0 THEN 0 ELSE 1 END AS starts FROM zeros
        WINDOW w AS (PARTITION BY building_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey)""",
    islands="""SELECT *, sum(starts) OVER (PARTITION BY building_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey
        ROWS UNBOUNDED PRECEDING) AS island FROM flagged""",
    runs="SELECT *, CASE WHEN z = 1 THEN count(*) OVER (PARTITION BY building_id, island) ELSE 0 END AS run FROM islands",
)
_ZKEYS = ["building_id", "l_orderkey", "l_linenumber", "l_partkey"]


@query("drop_zero_streaks", on("zeros", "SELECT building_id, l_orderkey, l_linenumber, l_partkey, y FROM runs WHERE run < 2", **_ZERO))
def drop_zero_streaks(spark, d):
    return clean.drop_zero_streaks(frames.zeros(spark, d), frames.ZEROS, "y", 2).select(*_ZKEYS, "y")


@query(
    "zero_streak_lengths",
    on(
        "zeros",
        "SELECT run AS length, count(*) AS runs FROM (SELECT DISTINCT building_id, island, run FROM runs WHERE run > 0) GROUP BY run",
        **_ZERO,
    ),
)
def zero_streak_lengths(spark, d):
    runs = clean.zero_run_starts(frames.zeros(spark, d), frames.ZEROS, "y")
    return runs.groupBy(F.col("zero_run").alias("length")).agg(F.count(F.lit(1)).alias("runs"))


@query(
    "zero_streak_histogram",
    on(
        "zeros",
        """SELECT CAST(least(floor(log10(run) / (4.0 / 49)), 48) AS INTEGER) AS bin, count(*) AS n
        FROM (SELECT DISTINCT building_id, island, run FROM runs WHERE run > 0) GROUP BY 1""",
        **_ZERO,
    ),
)
def zero_streak_histogram(spark, d):
    runs = clean.zero_run_starts(frames.zeros(spark, d), frames.ZEROS, "y")
    return explore.log_spaced_histogram(runs, "zero_run").select("bin", "n")


_FILL = "OVER (PARTITION BY building_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN {} AND {})"
_FFILL = (
    f"coalesce(last_value(kept IGNORE NULLS) {_FILL.format('UNBOUNDED PRECEDING', 'CURRENT ROW')}, "
    f"first_value(kept IGNORE NULLS) {_FILL.format('CURRENT ROW', 'UNBOUNDED FOLLOWING')})"
)
_BLANKED = "SELECT *, CASE WHEN run < 2 THEN y END AS kept FROM runs"


@query(
    "impute_ffill",
    on("zeros", f"SELECT building_id, l_orderkey, l_linenumber, l_partkey, {_FFILL} AS y FROM blanked", **_ZERO, blanked=_BLANKED),
)
def impute_ffill(spark, d):
    return clean.fill_streaks_forward(frames.zeros(spark, d), frames.ZEROS, "y", 2).select(*_ZKEYS, "y")


_MEAN = "CASE WHEN run < 2 THEN y ELSE coalesce(avg(kept) OVER (PARTITION BY building_id), 0) END"


@query(
    "impute_meter_mean",
    on("zeros", f"SELECT building_id, l_orderkey, l_linenumber, l_partkey, {sr(_MEAN, 6, 'y')} FROM blanked", **_ZERO, blanked=_BLANKED),
)
def impute_meter_mean(spark, d):
    return clean.fill_streaks_with_mean(frames.zeros(spark, d), frames.ZEROS, "y", 2).select(*_ZKEYS, r("y", 6))


_CAPPED = """SELECT least(s.v, cap) AS v FROM (SELECT building_id, {v} AS v FROM blanked {w}) s
    JOIN (SELECT building_id, quantile_cont(v, 0.999) AS cap FROM (SELECT building_id, {v} AS v FROM blanked {w}) GROUP BY building_id) USING (building_id)"""


@query(
    "imputation_strategies",
    on(
        "zeros",
        " UNION ALL ".join(
            f"SELECT '{name}' AS strategy, count(*) AS n, {sr('sum(v)', 3, 'total')} FROM ({_CAPPED.format(v=v, w=w)})"
            for name, v, w in (
                ("drop", "y", "WHERE run < 2"), ("ffill", _FFILL, ""), ("meter_mean", _MEAN, ""), ("keep_zeros", "y", ""),
            )
        ),
        **_ZERO,
        blanked=_BLANKED,
    ),
)
def imputation_strategies(spark, d):
    rows = durable(frames.zeros(spark, d))  # four treatments read it
    series = frames.ZEROS.measured(rows)

    def summed(strategy: str) -> DataFrame:
        out = clean.apply_streak_strategy(rows, series, strategy, "y", 2)
        return out.agg(F.lit(strategy).alias("strategy"), F.count(F.lit(1)).alias("n"), r(F.sum("y"), 3, "total"))

    return reduce(DataFrame.unionByName, map(summed, clean.STRATEGIES))


@query("imputation_columns", SQL["imputation_strategies"])
def imputation_columns(spark, d):
    """The same four treatments from one pass over the series."""
    treated = clean.all_treatments(frames.zeros(spark, d), frames.ZEROS, "y", 2)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("v"), (F.col("kept") | F.lit(s != "drop")).alias("here")) for s in clean.STRATEGIES]))
    rows = treated.select(each.alias("t")).select("t.*").where("here")
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 3, "total"))


# ---- gaps


def _interpolated(c: str) -> str:
    """SQL of a column filled on the line between its neighbours by row number."""
    before = 'OVER (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
    after = 'OVER (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)'
    at = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    v0, v1 = f"last_value({c} IGNORE NULLS) {before}", f"first_value({c} IGNORE NULLS) {after}"
    p0, p1 = f"last_value({at} IGNORE NULLS) {before}", f"first_value({at} IGNORE NULLS) {after}"
    return f"coalesce({c}, {v0} + ({v1} - {v0}) * (rn - {p0}) / nullif({p1} - {p0}, 0), {v0}, {v1})"


_IMPUTED = dict(
    numbered='SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp") AS rn FROM weather',
    imputed=f"""SELECT site_id, "timestamp", {_interpolated('air_temperature')} AS air_temperature, {_interpolated('dew_temperature')} AS dew_temperature,
        coalesce(cloud_coverage, cloud) AS cloud_coverage,
        coalesce(precip_depth_1_hr, 0) AS precip_depth_1_hr FROM numbered, (SELECT quantile_cont(cloud_coverage, 0.5) AS cloud FROM weather)""",
)


@query(
    "impute_weather",
    on(
        "weather",
        f"""SELECT site_id, {sstamp('"timestamp"', 'ts')}, {sr('air_temperature')}, {sr('dew_temperature')}, cloud_coverage, precip_depth_1_hr
        FROM imputed""",
        **_IMPUTED,
    ),
)
def impute_weather(spark, d):
    out = clean.impute_weather(durable(frames.weather(spark, d)), frames.WEATHER)
    return out.select("site_id", stamp("timestamp", "ts"), r("air_temperature"), r("dew_temperature"), "cloud_coverage", "precip_depth_1_hr")


@query(
    "fill_group_median",
    on(
        "daily",
        """SELECT o_orderkey, site_id, coalesce(age, (SELECT quantile_cont(s.age, 0.5) FROM aged s WHERE s.site_id = aged.site_id),
        (SELECT quantile_cont(age, 0.5) FROM aged)) AS building_age FROM aged""",
        aged="SELECT *, CASE WHEN site_id <> 3 THEN 2017 - year_built END AS age FROM daily",
    ),
)
def fill_group_median(spark, d):
    daily = frames.daily(spark, d)
    aged = daily.withColumn("building_age", F.when(F.col("site_id") != 3, 2017 - F.col("year_built")))
    return features.fill_age(aged).select("o_orderkey", "site_id", "building_age")


@query(
    "regularize_hourly",
    on(
        "hourly",
        f"""SELECT event_type, {sstamp('ts')}, {sr('coalesce(y, v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / nullif(epoch(t1) - epoch(t0), 0))', 4, 'y')}
        FROM (SELECT event_type, ts, y, last_value(y IGNORE NULLS) OVER b AS v0, first_value(y IGNORE NULLS) OVER f AS v1,
        last_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0,
        first_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS t1 FROM grid LEFT JOIN hourly USING (event_type, ts)
        WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        grid="""SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts
        FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY event_type)""",
    ),
)
def regularize_hourly(spark, d):
    out = forecast.regularize_hourly(frames.hourly(spark, d), frames.HOURLY, "y")
    return out.select("event_type", stamp("ts"), r("y"))


# ---- windows and folds


@query(
    "lookback_windows",
    on(
        "hourly",
        f"""SELECT event_type, {sstamp('ts')}, y AS target, CAST(168 AS INTEGER) AS size, {sr('ys', 3, 'total')}, y1 AS first_value,
        CAST(ns AS BIGINT) AS events, {sr('hs', 3, 'hours')} FROM (
        SELECT *, row_number() OVER w AS rn, sum(y) OVER back AS ys, first_value(y) OVER back AS y1, sum(n) OVER back AS ns,
        sum(hour(ts)) OVER back AS hs FROM hourly
        WINDOW w AS (PARTITION BY event_type ORDER BY ts), back AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))
        WHERE rn > 168 AND (rn - 1 - 168) % 6 = 0""",
    ),
)
def lookback_windows(spark, d):
    """Every sixth target with its week of readings, counts and hours."""
    hours = frames.hourly(spark, d).withColumn("hour", F.hour("ts"))
    out = forecast.lookback_windows(hours, frames.HOURLY, ["y", "n", "hour"], "y", 168, 6)
    total = lambda c: F.aggregate("window", F.lit(0.0), lambda acc, row: acc + row[c])
    return out.select(
        "event_type", stamp("ts"), "target", F.size("window").alias("size"), r(total("y"), 3, "total"),
        F.element_at("window", 1)["y"].alias("first_value"), total("n").cast("long").alias("events"), r(total("hour"), 3, "hours"),
    )


def _window_numbers(views, y):
    """What `lookback_windows` reports, from the windows of a block as one array of (windows, rows, features)."""
    totals = views.sum(axis=1)
    return {"target": y, "total": totals[:, 0], "first_value": views[:, 0, 0], "events": totals[:, 1].astype("int64"), "hours": totals[:, 2]}


@query("window_blocks", SQL["lookback_windows"])
def window_blocks(spark, d):
    """The same windows, cut from blocks in which every row is written once."""
    hours = frames.hourly(spark, d).withColumn("hour", F.hour("ts"))
    blocks = windows.write_blocks(hours, frames.HOURLY, ["y", "n", "hour"], "y", 168)
    out = windows.over_windows(blocks, _window_numbers, "target double, total double, first_value double, events long, hours double", stride=6)
    return out.select("event_type", stamp("ts"), "target", F.lit(168).alias("size"), r("total", 3), "first_value", "events", r("hours", 3))


@query(
    "cv_folds",
    on(
        "hourly",
        """SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (epoch(ts) < c[fold]) AS n_train,
        count(*) FILTER (epoch(ts) >= c[fold] AND (fold = 3 OR epoch(ts) < c[fold + 1])) AS n_test
        FROM hourly, cuts, unnest([1, 2, 3]) AS f(fold) GROUP BY fold""",
        cuts="SELECT quantile_cont(epoch(ts), [0.25, 0.5, 0.75]) AS c FROM hourly",
    ),
)
def cv_folds(spark, d):
    folds = split.expanding_folds(durable(frames.hourly(spark, d)), 3, "ts")
    sizes = [
        train.agg(F.lit(i).alias("fold"), F.count(F.lit(1)).alias("n_train")).join(
            test.agg(F.lit(i).alias("fold"), F.count(F.lit(1)).alias("n_test")), "fold"
        )
        for i, (train, test) in enumerate(folds, 1)
    ]
    return reduce(DataFrame.unionByName, sizes)


@query(
    "chrono_prefix",
    on(
        "hourly",
        " UNION ALL ".join(
            f"""SELECT {share} AS share, count(*) AS n, {sstamp('max(ts)', 'last')} FROM hourly WHERE ts <= (SELECT max(ts) FROM
            (SELECT ts FROM hourly ORDER BY ts LIMIT (SELECT CAST(greatest(1, floor(count(*) * {share})) AS BIGINT) FROM hourly)))"""
            for share in (0.25, 0.5, 0.75)
        ).replace("SELECT 0.", "SELECT CAST(0.").replace(" AS share", " AS DOUBLE) AS share"),
    ),
)
def chrono_prefix(spark, d):
    rows = durable(frames.hourly(spark, d))
    parts = [
        split.chrono_prefix(rows, share, "ts")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        .select(F.lit(share).alias("share"), "n", stamp("last"))
        for share in (0.25, 0.5, 0.75)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "time_split",
    on(
        "daily",
        f"""SELECT CASE WHEN month(ts) <= 9 THEN 'train' ELSE 'val' END AS fold, count(*) AS "rows", {sstamp('min(ts)', 'first')},
        {sstamp('max(ts)', 'last')}, count(DISTINCT building_id) AS buildings
        FROM (SELECT * REPLACE (make_timestamp(1996, month(ts), day(ts), 0, 0, 0.0) AS ts) FROM daily) GROUP BY 1""",
    ),
)
def time_split(spark, d):
    """All orders, their days moved into one leap year, as months of several years cannot be split by time."""
    year = frames.daily(spark, d).withColumn("ts", F.expr("make_timestamp_ntz(1996, month(ts), day(ts), 0, 0, 0)"))
    out = split.split_summary(*split.time_split(year, range(1, 10), (10, 11, 12), "ts"), "ts")
    return out.select("fold", "rows", stamp("first"), stamp("last"), "buildings")


# ---- forecasts

_FOLDS = dict(
    train=f"SELECT * FROM hourly WHERE ts < TIMESTAMP '{CUT}'",
    val=f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS step FROM hourly WHERE ts >= TIMESTAMP '{CUT}'",
    tail="SELECT event_type, y, 24 - row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS slot FROM train",
)


@query(
    "forecast_seasonal_naive",
    on(
        "hourly",
        f"""SELECT v.event_type, {sstamp('v.ts', 'ts')}, t.y AS y_pred FROM val v
        JOIN tail t ON v.event_type = t.event_type AND (v.step - 1) % 24 = t.slot""",
        **_FOLDS,
    ),
)
def forecast_seasonal_naive(spark, d):
    train, val = split.split_at(frames.hourly(spark, d), CUT, "ts")
    out = forecast.seasonal_naive(train, val, frames.HOURLY, "y")
    return out.select("event_type", stamp("ts"), "y_pred")


_AR = dict(
    z="SELECT event_type, ts, ln(1 + greatest(y, 0)) AS z0 FROM train",
    lags="SELECT *, lag(z0, 1) OVER w AS z1, lag(z0, 2) OVER w AS z2 FROM z WINDOW w AS (PARTITION BY event_type ORDER BY ts)",
    s="""SELECT event_type, count(*) AS n, avg(z0) AS m0, avg(z1) AS m1, avg(z2) AS m2, var_pop(z0) AS v0, var_pop(z1) AS v1, var_pop(z2) AS v2,
        covar_pop(z0, z1) AS c01, covar_pop(z0, z2) AS c02, covar_pop(z1, z2) AS c12, arg_max(z0, ts) AS x0, arg_max(z1, ts) AS x1
        FROM lags WHERE z2 IS NOT NULL GROUP BY event_type""",
    k="""SELECT *, c01 / v1 AS p1, (c01 * v2 - c02 * c12) / (v1 * v2 - c12 * c12) AS a1, (c02 * v1 - c01 * c12) / (v1 * v2 - c12 * c12) AS a2 FROM s""",
    aic="""SELECT *, n * ln(v0) + 2 AS i0, CASE WHEN abs(p1) < 1 THEN n * ln(v0 - p1 * c01) + 4 END AS i1,
        CASE WHEN abs(a2) < 1 AND a1 + a2 < 1 AND a2 - a1 < 1 THEN n * ln(v0 - a1 * c01 - a2 * c02) + 6 END AS i2 FROM k""",
    pick="""SELECT *, CASE WHEN i0 <= coalesce(i1, i0) AND i0 <= coalesce(i2, i0) THEN 0
        WHEN i1 IS NOT NULL AND i1 <= coalesce(i2, i1) THEN 1 ELSE 2 END AS o FROM aic""",
    fit="""SELECT event_type, o, f1, f2, (m0 - f1 * m1 - f2 * m2) / (1 - f1 - f2) AS mu, x0, x1 FROM (SELECT *,
        CASE o WHEN 0 THEN 0.0 WHEN 1 THEN p1 ELSE a1 END AS f1, CASE o WHEN 2 THEN a2 ELSE 0.0 END AS f2 FROM pick)""",
)


@query(
    "forecast_ar",
    # the recurrence itself, step by step
    on("hourly", "", **_FOLDS, **_AR).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", path AS (SELECT event_type, CAST(0 AS BIGINT) AS step, x0 - mu AS now, x1 - mu AS before, f1, f2, mu FROM fit
        UNION ALL SELECT p.event_type, step + 1, f1 * now + f2 * before, now, f1, f2, mu FROM path p
        WHERE step < (SELECT max(step) FROM val))
    SELECT v.event_type, {sstamp('v.ts', 'ts')}, {sr('exp(least(greatest(mu + now, 0), 14)) - 1', 3, 'y_pred')}
    FROM val v JOIN path p ON v.event_type = p.event_type AND v.step = p.step""",
)
def forecast_ar(spark, d):
    train, val = split.split_at(frames.hourly(spark, d), CUT, "ts")
    out = forecast.forecast_ar(train, val, frames.HOURLY, "y")
    return out.select("event_type", stamp("ts"), r("y_pred", 3))


_GRID_TRAIN = f"""SELECT event_type, ts, coalesce(y, v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / nullif(epoch(t1) - epoch(t0), 0)) AS y
    FROM (SELECT event_type, ts, y, last_value(y IGNORE NULLS) OVER b AS v0, first_value(y IGNORE NULLS) OVER f AS v1,
    last_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0,
    first_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS t1 FROM grid LEFT JOIN hourly USING (event_type, ts)
    WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_GRID = f"""SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts
    FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hourly WHERE ts < TIMESTAMP '{CUT}' GROUP BY event_type)"""


@query(
    "forecast_ar_grid",
    on("hourly", "", grid=_GRID, train=_GRID_TRAIN, val=_FOLDS["val"], **_AR).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + SQL["forecast_ar"][SQL["forecast_ar"].index(", path AS (") :],
)
def forecast_ar_grid(spark, d):
    """The autoregression fitted on the hourly grid, gaps filled."""
    train, val = split.split_at(frames.hourly(spark, d), CUT, "ts")
    out = forecast.forecast_ar(train, val, frames.HOURLY, "y", grid=True)
    return out.select("event_type", stamp("ts"), r("y_pred", 3))


_SEASONAL = dict(
    **{k: _FOLDS[k] for k in ("train", "val")},
    z="SELECT event_type, ts, ln(1 + greatest(y, 0)) AS z0 FROM train",
    lags="SELECT *, lag(z0, 1) OVER w AS z1, lag(z0, 24) OVER w AS z24, lag(z0, 25) OVER w AS z25 FROM z WINDOW w AS (PARTITION BY event_type ORDER BY ts)",
    s="""SELECT event_type, count(*) AS n, avg(z0) AS m0, avg(z1) AS m1, avg(z24) AS m24, var_pop(z0) AS v0, var_pop(z1) AS v1,
        var_pop(z24) AS v24, covar_pop(z0, z1) AS c1, covar_pop(z0, z24) AS c24, covar_pop(z1, z24) AS c124 FROM lags
        WHERE z24 IS NOT NULL GROUP BY event_type""",
    fit="""SELECT event_type, n, m0 - p1 * m1 - p24 * m24 AS level, p1, p24,
        v0 - 2 * (p1 * c1 + p24 * c24) + p1 * p1 * v1 + p24 * p24 * v24 + 2 * p1 * p24 * c124 AS error FROM (SELECT *,
        (c1 * v24 - c24 * c124) / (v1 * v24 - c124 * c124) AS p1, (c24 * v1 - c1 * c124) / (v1 * v24 - c124 * c124) AS p24 FROM s)""",
)
YESTERDAY = seasonal.Order(ar=(1, 24))


@query(
    "seasonal_coefficients",
    on(
        "hourly",
        f"""SELECT event_type, n AS "rows", {sr('p1', 6, 'phi1')}, {sr('p24', 6, 'phi24')}, {sr('level', 6)}, {sr('error', 6)},
        {sr('n * ln(error) + 8', 3, 'aic')} FROM fit""",
        **_SEASONAL,
    ),
)
def seasonal_coefficients(spark, d):
    """A fixed order by least squares: the hour before and the same hour of the day before."""
    train, _ = split.split_at(frames.hourly(spark, d), CUT, "ts")
    fitted = seasonal.fit_seasonal(train, frames.HOURLY, "y", orders=[YESTERDAY])
    phi = lambda k, name: r(F.element_at("phi", k), 6, name)
    return fitted.select("event_type", "rows", phi(1, "phi1"), phi(2, "phi24"), r("level", 6), r("error", 6), r("aic", 3))


@query(
    "seasonal_differenced",
    on(
        "hourly",
        f"""SELECT event_type, count(*) AS "rows", {sr('sum(w0 * w1) / sum(w1 * w1)', 6, 'phi1')} FROM (
        SELECT event_type, z0 - z24 AS w0, z1 - z25 AS w1 FROM lags WHERE z25 IS NOT NULL) GROUP BY event_type""",
        **{k: _SEASONAL[k] for k in ("train", "z", "lags")},
    ),
)
def seasonal_differenced(spark, d):
    """The change from the day before, and how much of it lasts for an hour."""
    train, _ = split.split_at(frames.hourly(spark, d), CUT, "ts")
    fitted = seasonal.fit_seasonal(train, frames.HOURLY, "y", orders=[seasonal.Order(ar=(1,), seasonal=True)])
    return fitted.select("event_type", "rows", r(F.element_at("phi", 1), 6, "phi1"))


@query(
    "forecast_seasonal_order",
    # the recurrence itself, step by step, with the last day as its state
    on(
        "hourly", "", **_SEASONAL,
        tails="SELECT event_type, list(z0 ORDER BY ts) AS day FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS b FROM z) WHERE b <= 24 GROUP BY event_type",
    ).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", path AS (SELECT event_type, CAST(0 AS BIGINT) AS step, day, p1, p24, level FROM fit JOIN tails USING (event_type)
        UNION ALL SELECT event_type, step + 1, list_append(day[2:], level + p1 * day[24] + p24 * day[1]), p1, p24, level FROM path
        WHERE step < (SELECT max(step) FROM val))
    SELECT v.event_type, {sstamp('v.ts', 'ts')}, {sr('exp(least(greatest(p.day[24], 0), 14)) - 1', 3, 'y_pred')}
    FROM val v JOIN path p ON v.event_type = p.event_type AND v.step = p.step""",
)
def forecast_seasonal_order(spark, d):
    """The path of the fixed order."""
    train, val = split.split_at(frames.hourly(spark, d), CUT, "ts")
    out = seasonal.forecast_seasonal(train, val, frames.HOURLY, "y", orders=[YESTERDAY], grid=False)
    return out.select("event_type", stamp("ts"), r("y_pred", 3))


@query("forecast_seasonal")
def forecast_seasonal(spark, d):
    """Every series with the best of all orders, fitted on the hourly grid."""
    train, val = split.split_at(frames.hourly(spark, d), CUT, "ts")
    out = seasonal.forecast_seasonal(train, val, frames.HOURLY, "y")
    return out.select("event_type", stamp("ts"), r("y_pred", 3))


# ---- the prepare job

CUTOFF = "2000-01-01"
_ORDER = '"timestamp", l_orderkey, l_linenumber, l_partkey'
_FRAME = f"(PARTITION BY building_id, meter ORDER BY {_ORDER} ROWS BETWEEN {{}} PRECEDING AND 1 PRECEDING)"
_CONT = ["air_temperature", "dew_temperature", "cloud_coverage", "precip_depth_1_hr"]
_FEATURES = [c for c in features.FEATURE_COLUMNS if c != "wind_speed"]


def _rolls() -> str:
    out = []
    for n in (24, 168):
        frame = "OVER " + _FRAME.format(n)
        for f, name in (("avg", "mean"), ("stddev_samp", "std")):
            out.append(f"CASE WHEN count(meter_reading) {frame} >= {n // 4} THEN {f}(meter_reading) {frame} END AS rolling_{name}_{n}h")
    return ", ".join(out)


_PREPARED = dict(
    **_IMPUTED,
    joined=f"""SELECT r.building_id, r.meter, r."timestamp", l_orderkey, l_linenumber, l_partkey, m.site_id, primary_use,
        CASE WHEN m.site_id = 0 AND meter = 0 THEN meter_reading * 0.293071 ELSE meter_reading END AS meter_reading,
        2017 - year_built AS age, ln(1 + square_feet) AS log_square_feet, {', '.join(_CONT)}
        FROM readings r LEFT JOIN meta m USING (building_id) LEFT JOIN imputed w ON m.site_id = w.site_id AND r."timestamp" = w."timestamp"
        WHERE meter_reading >= 0""",
    flagged=f"""SELECT *, CASE WHEN meter_reading = 0 AND lag(meter_reading) OVER (PARTITION BY building_id, meter ORDER BY {_ORDER}) = 0
        THEN 0 ELSE 1 END AS starts FROM joined""",
    islands=f"""SELECT *, sum(starts) OVER (PARTITION BY building_id, meter ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS island FROM flagged""",
    kept="""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY building_id, meter, island) AS run FROM islands) WHERE meter_reading <> 0 OR run < 2""",
    capped="""SELECT * REPLACE (least(meter_reading, (cap)) AS meter_reading) FROM kept JOIN
        (SELECT building_id, meter, quantile_cont(meter_reading, 0.99) AS cap FROM kept GROUP BY ALL) USING (building_id, meter)""",
    history=f"""SELECT *, lag(meter_reading, 24) OVER w AS lag_24h, lag(meter_reading, 168) OVER w AS lag_168h, {_rolls()}
        FROM capped WINDOW w AS (PARTITION BY building_id, meter ORDER BY {_ORDER})""",
    site_ages="SELECT site_id, quantile_cont(age, 0.5) AS site_age FROM history GROUP BY site_id",
    any_ages="SELECT quantile_cont(age, 0.5) AS any_age FROM history",
    use_codes="""SELECT primary_use, CAST(row_number() OVER (ORDER BY primary_use) - 1 AS BIGINT) AS code
        FROM (SELECT DISTINCT primary_use FROM meta WHERE primary_use IS NOT NULL)""",
    easter=EASTER,
    featured=f"""SELECT *, lag_24h - lag_168h AS lag_diff_24h, CAST(hour("timestamp") AS INTEGER) AS hour,
        {', '.join(f"{f}(2 * pi() * {x} / {p}) AS {n}_{f}" for n, x, p in (('hour', 'hour("timestamp")', 24), ('dayofweek', '(isodow("timestamp") - 1)', 7), ('month', 'month("timestamp")', 12)) for f in ('sin', 'cos'))},
        CASE WHEN isodow("timestamp") >= 6 THEN 1 ELSE 0 END AS is_weekend, air_temperature * air_temperature AS temp_squared,
        coalesce(age, site_age, any_age) AS building_age, code AS primary_use_code, CAST({site_holiday('"timestamp"')} AS INTEGER) AS is_holiday,
        hour("timestamp") * CASE WHEN isodow("timestamp") >= 6 THEN 1 ELSE 0 END AS hour_x_weekend,
        log_square_feet * coalesce(air_temperature, 0) AS sqft_x_temp, "timestamp" < TIMESTAMP '{CUTOFF}' AS is_train
        FROM history LEFT JOIN site_ages USING (site_id) LEFT JOIN use_codes USING (primary_use), any_ages""",
    overall="SELECT avg(ln(1 + meter_reading)) AS m FROM featured WHERE is_train",
    te="""SELECT primary_use, hour, (count(*) * avg(ln(1 + meter_reading)) + 30 * any_value(m)) / (count(*) + 30) AS te
        FROM featured, overall WHERE is_train GROUP BY primary_use, hour""",
)
_OUT = [c for c in _FEATURES if c != "te_primary_use_x_hour"]


@query(
    "prepare_features",
    on(
        "readings meta weather",
        f"""SELECT CASE WHEN is_train THEN 'train' ELSE 'val' END AS fold, building_id, meter, l_orderkey, l_linenumber, l_partkey,
        {sr('meter_reading')}, {', '.join(sr(c, 3) for c in _OUT)}, {sr('coalesce(te, m)', 5, 'te_primary_use_x_hour')},
        {sr('ln(1 + meter_reading)', 5, 'label')} FROM featured f LEFT JOIN te USING (primary_use, hour), overall
        WHERE lag_168h IS NOT NULL AND lag_24h IS NOT NULL AND air_temperature IS NOT NULL AND dew_temperature IS NOT NULL
        AND rolling_std_24h IS NOT NULL AND rolling_std_168h IS NOT NULL""",
        **_PREPARED,
    ),
)
def prepare_features(spark, d):
    done = prepare_lines(spark, d)
    both = done.train.withColumn("fold", F.lit("train")).unionByName(done.val.withColumn("fold", F.lit("val")))
    return both.select(
        "fold", *KEYS, "l_orderkey", "l_linenumber", "l_partkey", r("meter_reading"), *[r(c, 3) for c in _OUT],
        r("te_primary_use_x_hour", 5), r("label", 5),
    )


def prepare_lines(spark, d, readings=None, **settings):
    """The prepare job on the line items, runs of two zeros counting as an outage."""
    chosen = {"min_hours": 2, "quantile": 0.99, **settings}
    return prepare(
        frames.readings(spark, d) if readings is None else readings, tables.derive_meta(frames.meta(spark, d)), durable(frames.weather(spark, d)),
        lambda frame: split.split_at(frame, CUTOFF), frames.READINGS, frames.WEATHER, **chosen,
    )
