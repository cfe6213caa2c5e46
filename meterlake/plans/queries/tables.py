"""Queries for scans, projections, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scalars import from_log, to_log
from meterlake.operators import clean, evaluate, explore, features, joins
from meterlake.operators.encoding import TargetEncoder
from meterlake.operators.split import split_at
from meterlake.plans.queries.catalog import on, query, r, sr, sstamp, stamp
from meterlake.plans.training import baseline_group_mean
from meterlake.session import durable, scratch_path
from meterlake.sources import frames, tables
from meterlake.sources.versions import VersionedTable

CUT = "2024-01-22"
KEYS = ["building_id", "meter"]

# ---- scans and sinks


@query("scan_readings", on("readings", f'SELECT building_id, meter, {sstamp(chr(34) + "timestamp" + chr(34), "ts")}, meter_reading FROM readings'))
def scan_readings(spark, d):
    return frames.readings(spark, d).select("building_id", "meter", stamp("timestamp", "ts"), "meter_reading")


@query(
    "scan_meta",
    on("meta", f"SELECT *, 2017 - year_built AS building_age, {sr('ln(1 + square_feet)', 6, 'log_square_feet')} FROM meta"),
)
def scan_meta(spark, d):
    return tables.derive_meta(frames.meta(spark, d)).withColumn("log_square_feet", r("log_square_feet", 6))


@query(
    "scan_weather",
    on("weather", f'SELECT site_id, {sstamp(chr(34) + "timestamp" + chr(34), "ts")}, {sr("air_temperature")} FROM weather'),
)
def scan_weather(spark, d):
    return frames.weather(spark, d).select("site_id", stamp("timestamp", "ts"), r("air_temperature"))


@query(
    "scan_subset",
    on(
        "readings meta",
        f"""SELECT meter, count(*) AS n, {sr('sum(meter_reading)', 2, 'total')} FROM readings
        WHERE building_id IN (SELECT building_id FROM meta WHERE site_id IN (2, 4, 13, 14)) GROUP BY meter""",
    ),
)
def scan_subset(spark, d):
    kept = tables.keep_sites(frames.readings(spark, d), frames.meta(spark, d), [2, 4, 13, 14])
    return kept.groupBy("meter").agg(F.count(F.lit(1)).alias("n"), r(F.sum("meter_reading"), 2, "total"))


@query("parquet_roundtrip", f"SELECT o_orderkey, {sstamp('o_orderdate', 'ts')}, o_totalprice FROM orders")
def parquet_roundtrip(spark, d):
    path = scratch_path(spark, "roundtrip")
    tables.write_by_month(frames.table(spark, d, "orders"), path, "o_orderdate")
    return tables.read_by_month(spark, path).select("o_orderkey", stamp("o_orderdate", "ts"), "o_totalprice")


@query(
    "parquet_range",
    f"""SELECT o_orderkey, {sstamp('o_orderdate', 'ts')} FROM orders WHERE o_orderdate >= '1996-02-10' AND o_orderdate < '1997-05-01'""",
)
def parquet_range(spark, d):
    """A range of days from a table by month; other months are not opened."""
    path = scratch_path(spark, "by_month")
    tables.write_by_month(frames.table(spark, d, "orders"), path, "o_orderdate")
    return tables.read_by_month(spark, path, "1996-02-10", "1997-05-01", "o_orderdate").select("o_orderkey", stamp("o_orderdate", "ts"))


@query(
    "upsert_published",
    """SELECT c_mktsegment AS model, round(CASE WHEN c_mktsegment < 'C' THEN 2 ELSE 1 END * avg(c_acctbal) + 1e-9, 4) AS rmse FROM customer GROUP BY c_mktsegment""",
)
def upsert_published(spark, d):
    """Results published, and some of them replaced by a second version."""
    scores = frames.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.avg("c_acctbal").alias("rmse"))
    table = VersionedTable(spark, scratch_path(spark, "results"))
    tables.upsert_published(table, scores)
    tables.upsert_published(table, scores.where("model < 'C'").withColumn("rmse", 2 * F.col("rmse")))
    return table.read().select("model", r("rmse"))


@query(
    "metrics_nested",
    on(
        "model_preds",
        f"""SELECT model, event_type AS "group", count(*) AS n, {sr('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 4, 'rmse')}
        FROM model_preds GROUP BY model, event_type""",
    ),
)
def metrics_nested(spark, d):
    report = evaluate.evaluate_report(frames.model_preds(spark, d), ["event_type"], ["model"])
    nested = evaluate.nested_report(report)
    path = scratch_path(spark, "metrics")
    tables.write_nested(nested, path)
    back = tables.read_nested(spark, path, nested.schema)
    return back.select("model", F.explode("groups").alias("g")).select("model", "g.group", "g.n", r("g.rmse", 4, "rmse"))


# ---- projections and filters


@query(
    "derive_meta",
    on(
        "meta",
        f"""SELECT primary_use, count(building_age) AS n, sum(building_age) AS total_age, {sr('avg(log_square_feet)', 6, 'mean_log')}
        FROM (SELECT *, 2017 - year_built AS building_age, ln(1 + square_feet) AS log_square_feet FROM meta) GROUP BY primary_use""",
    ),
)
def derive_meta(spark, d):
    derived = tables.derive_meta(frames.meta(spark, d))
    return derived.groupBy("primary_use").agg(
        F.count("building_age").alias("n"), F.sum("building_age").alias("total_age"), r(F.avg("log_square_feet"), 6, "mean_log")
    )


@query("drop_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal >= 0")
def drop_negative(spark, d):
    return clean.drop_negative(frames.table(spark, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query(
    "unit_convert",
    on(
        "readings meta",
        f"""SELECT site_id, meter, count(*) AS n, {sr('sum(CASE WHEN site_id = 0 AND meter = 0 THEN meter_reading * 0.293071 ELSE meter_reading END)', 3, 'total')}
        FROM readings LEFT JOIN meta USING (building_id) GROUP BY site_id, meter""",
    ),
)
def unit_convert(spark, d):
    rows = clean.convert_units(joins.join_meta(frames.readings(spark, d), frames.meta(spark, d)))
    return rows.groupBy("site_id", "meter").agg(F.count(F.lit(1)).alias("n"), r(F.sum("meter_reading"), 3, "total"))


@query("filter_sites", on("meta", "SELECT building_id, site_id, primary_use FROM meta WHERE site_id IN (2, 4, 13, 14)"))
def filter_sites(spark, d):
    return frames.meta(spark, d).where(F.col("site_id").isin(2, 4, 13, 14)).select("building_id", "site_id", "primary_use")


@query(
    "time_slice",
    f"""SELECT event_id, {sstamp('ts')}, value FROM events
    WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'""",
)
def time_slice(spark, d):
    rows = frames.table(spark, d, "events").where(
        (F.col("event_type") == "click") & (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-17")
    )
    return rows.select("event_id", stamp("ts"), "value")


@query(
    "drop_incomplete",
    on(
        "daily weather",
        """SELECT o_orderkey, d.site_id, year_built, y FROM daily d
        JOIN weather w ON d.site_id = w.site_id AND d.ts = w."timestamp"
        WHERE air_temperature IS NOT NULL AND year_built IS NOT NULL""",
    ),
)
def drop_incomplete(spark, d):
    daily = frames.daily(spark, d).withColumnRenamed("ts", "timestamp")
    joined = daily.join(durable(frames.weather(spark, d)), ["site_id", "timestamp"], "left")
    return joined.na.drop(subset=["air_temperature", "year_built", "y"]).select("o_orderkey", "site_id", "year_built", "y")


@query(
    "fill_const_median",
    on(
        "weather",
        f"""SELECT site_id, {sstamp('"timestamp"', 'ts')},
        coalesce(cloud_coverage, (SELECT quantile_cont(cloud_coverage, 0.5) FROM weather)) AS cloud_coverage,
        coalesce(precip_depth_1_hr, 0.0) AS precip_depth_1_hr FROM weather""",
    ),
)
def fill_const_median(spark, d):
    filled = clean.fill_with(clean.fill_with_median(frames.weather(spark, d), "cloud_coverage"), "precip_depth_1_hr", 0.0)
    return filled.select("site_id", stamp("timestamp", "ts"), "cloud_coverage", "precip_depth_1_hr")


@query(
    "feature_matrix",
    on(
        "daily weather",
        f"""SELECT CAST(hour(d.ts) AS INTEGER) AS hour, {sr('air_temperature')}, {sr('ln(1 + square_feet)', 6, 'log_square_feet')},
        CAST((SELECT count(DISTINCT primary_use) FROM meta m WHERE m.primary_use < d.primary_use) AS INTEGER) AS primary_use_code,
        meter FROM daily d LEFT JOIN weather w ON d.site_id = w.site_id AND d.ts = w."timestamp" """,
    ),
)
def feature_matrix(spark, d):
    daily = frames.daily(spark, d).withColumnRenamed("ts", "timestamp")
    rows = tables.derive_meta(daily.join(durable(frames.weather(spark, d)), ["site_id", "timestamp"], "left"))
    rows = rows.withColumns(
        {"hour": F.hour("timestamp"), "primary_use_code": features.category_codes(frames.meta(spark, d), "primary_use")}
    )
    chosen = rows.select(*features.feature_set(rows, "raw"))
    return chosen.withColumns({"air_temperature": r("air_temperature"), "log_square_feet": r("log_square_feet", 6)})


@query(
    "target_transform",
    f"""SELECT c_custkey, {sr('ln(1 + greatest(c_acctbal, 0))', 6, 'y_log')},
    {sr('exp(least(greatest(ln(1 + greatest(c_acctbal, 0)) * 2, 0), 14)) - 1', 2, 'y_back')} FROM customer""",
)
def target_transform(spark, d):
    customer = frames.table(spark, d, "customer")
    logs = customer.withColumn("_log", to_log("c_acctbal"))
    return logs.select("c_custkey", r("_log", 6, "y_log"), r(from_log(F.col("_log") * 2), 2, "y_back"))


def _case_sql(kind: str, among: str, condition: str, order: str) -> str:
    hits = f"SELECT * FROM errors WHERE {among} AND {condition}"
    rest = f"SELECT * FROM (SELECT * FROM errors WHERE {among} ORDER BY e {order}, event_type, ts LIMIT 50) WHERE NOT EXISTS ({hits})"
    return f"""SELECT event_type, {sstamp('ts')}, {sr('y_true')}, {sr('y_pred')}, {sr('e', 4, 'abs_err')}, '{kind}' AS kind
        FROM ({hits} UNION ALL {rest})"""


_CASES = on(
    "preds",
    _case_sql("easy", "event_type = 'click'", "y_true > 20 AND y_true < 300 AND e < 5", "ASC")
    + " UNION ALL "
    + _case_sql("hard", "event_type = 'view'", "y_true > 500000 AND e > 1000", "DESC"),
    errors="SELECT *, abs(y_pred - y_true) AS e FROM preds",
)


@query("case_selection", _CASES)
def case_selection(spark, d):
    preds = frames.preds(spark, d)
    click, view, error = F.col("event_type") == "click", F.col("event_type") == "view", F.col("abs_err")
    easy = evaluate.pick_cases(preds, click & (F.col("y_true") > 20) & (F.col("y_true") < 300) & (error < 5), True, click)
    hard = evaluate.pick_cases(preds, view & (F.col("y_true") > 500000) & (error > 1000), False, view)
    both = easy.withColumn("kind", F.lit("easy")).unionByName(hard.withColumn("kind", F.lit("hard")))
    return both.select("event_type", stamp("ts"), r("y_true"), r("y_pred"), r("abs_err"), "kind")


@query(
    "categorical_code",
    on(
        "meta",
        """SELECT building_id, CAST(CASE WHEN use IS NULL THEN -1 ELSE (SELECT count(DISTINCT use) FROM gaps g WHERE g.use < gaps.use) END AS INTEGER)
        AS primary_use_code FROM gaps""",
        gaps="SELECT building_id, CASE WHEN year_built IS NOT NULL THEN primary_use END AS use FROM meta",
    ),
)
def categorical_code(spark, d):
    gaps = frames.meta(spark, d).withColumn("primary_use", F.when(F.col("year_built").isNotNull(), F.col("primary_use")))
    return gaps.select("building_id", features.category_codes(gaps, "primary_use").alias("primary_use_code"))


@query(
    "interactions",
    on(
        "hourly",
        f"""SELECT event_type, {sstamp('ts')}, {sr('n * n', 4, 'temp_squared')},
        CAST(hour(ts) * CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS hour_x_weekend,
        {sr('ln(1 + y) * n', 4, 'sqft_x_temp')} FROM hourly""",
    ),
)
def interactions(spark, d):
    rows = frames.hourly(spark, d).withColumns(
        {"air_temperature": F.col("n"), "log_square_feet": F.log1p("y"), "hour": F.hour("ts"),
         "is_weekend": (F.weekday("ts") >= 5).cast("int")}
    )
    out = features.add_interaction_features(features.add_weather_features(rows))
    return out.select("event_type", stamp("ts"), r("temp_squared"), "hour_x_weekend", r("sqft_x_temp"))


# the rules of US federal holidays on one date column
US_HOLIDAY = """(
    (month(x) = 1 AND day(x) = 1) OR (month(x) = 1 AND day(x) = 2 AND isodow(x) = 1) OR (month(x) = 12 AND day(x) = 31 AND isodow(x) = 5)
    OR (month(x) = 1 AND isodow(x) = 1 AND day(x) BETWEEN 15 AND 21) OR (month(x) = 2 AND isodow(x) = 1 AND day(x) BETWEEN 15 AND 21)
    OR (month(x) = 5 AND isodow(x) = 1 AND day(x) >= 25)
    OR (month(x) = 7 AND (day(x) = 4 OR (day(x) = 3 AND isodow(x) = 5) OR (day(x) = 5 AND isodow(x) = 1)))
    OR (month(x) = 9 AND isodow(x) = 1 AND day(x) <= 7) OR (month(x) = 10 AND isodow(x) = 1 AND day(x) BETWEEN 8 AND 14)
    OR (month(x) = 11 AND (day(x) = 11 OR (day(x) = 10 AND isodow(x) = 5) OR (day(x) = 12 AND isodow(x) = 1)))
    OR (month(x) = 11 AND isodow(x) = 4 AND day(x) BETWEEN 22 AND 28)
    OR (month(x) = 12 AND (day(x) = 25 OR (day(x) = 24 AND isodow(x) = 5) OR (day(x) = 26 AND isodow(x) = 1)))
    OR (year(x) >= 2021 AND month(x) = 6 AND (day(x) = 19 OR (day(x) = 18 AND isodow(x) = 5) OR (day(x) = 20 AND isodow(x) = 1))))"""


def us_holiday(column: str) -> str:
    return US_HOLIDAY.replace("(x)", f"({column})")


@query(
    "time_features",
    on(
        "hourly",
        "SELECT event_type, "
        + sstamp("ts")
        + """, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(month(ts) AS INTEGER) AS month,
        CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend, CAST(CASE WHEN """
        + us_holiday("ts")
        + " THEN 1 ELSE 0 END AS INTEGER) AS is_holiday, "
        + ", ".join(
            sr(f"{f}(2 * pi() * {x} / {p})", 6, f"{n}_{f}")
            for n, x, p in (("hour", "hour(ts)", 24), ("dayofweek", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12))
            for f in ("sin", "cos")
        )
        + " FROM hourly",
    ),
)
def time_features(spark, d):
    out = features.add_time_features(frames.hourly(spark, d), "ts")
    waves = [r(f"{n}_{f}", 6) for n in ("hour", "dayofweek", "month") for f in ("sin", "cos")]
    return out.select("event_type", stamp("ts"), "hour", "dayofweek", "month", "is_weekend", "is_holiday", *waves)


EASTER = """WITH a AS (SELECT y, y % 19 AS g, y // 100 AS c, y % 100 AS q FROM (SELECT unnest(generate_series(1990, 2030)) AS y)),
    b AS (SELECT *, (19 * g + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
    e AS (SELECT *, (32 + 2 * (c % 4) + 2 * (q // 4) - h - q % 4) % 7 AS l FROM b),
    f AS (SELECT *, h + l - 7 * ((g + 11 * h + 22 * l) // 451) + 114 AS k FROM e)
    SELECT make_date(y, k // 31, k % 31 + 1) AS sunday FROM f"""


def site_holiday(time: str = "ts", site: str = "site_id") -> str:
    """Whether a day is a public holiday at a site, over the frame `easter`."""
    easter = f"{time} IN (SELECT sunday {{}} FROM easter)"
    full, short = f"strftime({time}, '%Y-%m-%d')", f"strftime({time}, '%m-%d')"
    month, day, weekday = f"month({time})", f"day({time})", f"isodow({time})"
    return f"""CASE
        WHEN {site} IN (1, 5) THEN ({easter.format('- 2')}
            OR ({month} = 5 AND {weekday} = 1 AND ({day} <= 7 OR {day} >= 25) AND {full} NOT IN ('1995-05-01', '2002-05-27'))
            OR {full} IN ('1995-05-08', '1999-12-31', '2002-06-03', '2002-06-04') OR {short} IN ('01-01', '12-25', '12-26')
            OR ({month} = 1 AND {weekday} = 1 AND {day} IN (2, 3))
            OR ({month} = 12 AND {weekday} = 1 AND {day} IN (27, 28)) OR ({month} = 12 AND {weekday} = 2 AND {day} IN (27, 28)))
        WHEN {site} IN (7, 11) THEN ({easter.format('- 2')} OR {short} IN ('01-01', '07-01', '12-25')
            OR ({month} = 9 AND {weekday} = 1 AND {day} <= 7))
        WHEN {site} = 12 THEN ({easter.format('+ 1')} OR {short} IN ('01-01', '03-17', '12-25', '12-26')
            OR ({weekday} = 1 AND (({month} IN (5, 6, 8) AND {day} <= 7) OR ({month} = 10 AND {day} >= 25))) OR {full} = '1999-12-31')
        ELSE {us_holiday(time)} END"""


@query(
    "holiday_flag",
    on("daily", f"SELECT o_orderkey, site_id, CAST({site_holiday()} AS INTEGER) AS is_holiday FROM daily", easter=EASTER),
)
def holiday_flag(spark, d):
    return features.with_holiday_flag(frames.daily(spark, d), "ts").select("o_orderkey", "site_id", "is_holiday")


# ---- joins


@query("join_meta", on("readings meta", f"""SELECT building_id, meter, {sstamp('"timestamp"', 'ts')}, meter_reading, site_id, primary_use
    FROM readings LEFT JOIN meta USING (building_id)"""))
def join_meta(spark, d):
    joined = joins.join_meta(frames.readings(spark, d), frames.meta(spark, d))
    return joined.select("building_id", "meter", stamp("timestamp", "ts"), "meter_reading", "site_id", "primary_use")


@query(
    "join_context",
    on(
        "readings meta weather",
        f"""SELECT building_id, meter, {sstamp('r."timestamp"', 'ts')}, meter_reading, m.site_id, {sr('air_temperature')}
        FROM readings r LEFT JOIN meta m USING (building_id)
        LEFT JOIN weather w ON m.site_id = w.site_id AND r."timestamp" = w."timestamp" """,
    ),
)
def join_context(spark, d):
    joined = joins.join_context(frames.readings(spark, d), frames.meta(spark, d), durable(frames.weather(spark, d)))
    return joined.select("building_id", "meter", stamp("timestamp", "ts"), "meter_reading", "site_id", r("air_temperature"))


@query(
    "semi_join_sites",
    on(
        "readings meta",
        """SELECT building_id, l_orderkey, meter_reading FROM readings
        WHERE building_id IN (SELECT building_id FROM meta WHERE site_id IN (7, 11))""",
    ),
)
def semi_join_sites(spark, d):
    kept = tables.keep_sites(frames.readings(spark, d), frames.meta(spark, d), [7, 11])
    return kept.select("building_id", "l_orderkey", "meter_reading")


@query(
    "semi_join_keys",
    on(
        "readings",
        """SELECT building_id, meter, count(*) AS n FROM readings r
        WHERE EXISTS (SELECT 1 FROM readings s WHERE s.building_id = r.building_id AND s.meter = r.meter AND s.meter_reading >= 50)
        GROUP BY building_id, meter""",
    ),
)
def semi_join_keys(spark, d):
    rows = frames.readings(spark, d)
    return joins.keep_keys(rows, rows.where(F.col("meter_reading") >= 50), KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


_TE = dict(
    fold="SELECT *, CAST(hour(ts) AS INTEGER) AS hour, ts < TIMESTAMP '2024-01-22' AS is_train FROM hourly",
    overall="SELECT avg(ln(1 + greatest(y, 0))) AS m FROM fold WHERE is_train",
    te="""SELECT event_type, hour, (count(*) * avg(ln(1 + greatest(y, 0))) + 30 * any_value(m)) / (count(*) + 30) AS te
        FROM fold, overall WHERE is_train GROUP BY event_type, hour""",
)


def _encoder(spark, d):
    rows = frames.hourly(spark, d).withColumn("hour", F.hour("ts"))
    train, val = split_at(rows, CUT, "ts")
    return TargetEncoder(["event_type", "hour"], "y").fit(train), val


@query("te_fit", on("hourly", f"SELECT event_type, hour, {sr('te', 6, 'te_event_type_x_hour')} FROM te", **_TE))
def te_fit(spark, d):
    encoder, _ = _encoder(spark, d)
    return encoder.encoding.select("event_type", "hour", r(encoder.column, 6))


@query(
    "te_transform",
    on(
        "hourly",
        f"""SELECT f.event_type, {sstamp('ts')}, {sr('coalesce(te, m)', 6, 'te_event_type_x_hour')}
        FROM fold f LEFT JOIN te ON f.event_type = te.event_type AND f.hour = te.hour, overall WHERE NOT is_train""",
        **_TE,
    ),
)
def te_transform(spark, d):
    encoder, val = _encoder(spark, d)
    return encoder.transform(val).select("event_type", stamp("ts"), r(encoder.column, 6))


@query("te_deviation", on("hourly", f"SELECT event_type, hour, {sr('te - m', 6, 'deviation')} FROM te, overall", **_TE))
def te_deviation(spark, d):
    encoder, _ = _encoder(spark, d)
    return encoder.deviation().select("event_type", "hour", r("deviation", 6))


@query(
    "baseline_group_mean",
    on(
        "readings",
        f"""SELECT r.building_id, r.meter, r.l_orderkey, {sr('least(greatest(meter_reading, 0), exp(14) - 1)', 4, 'y_true')},
        {sr('least(greatest(coalesce(m, (SELECT avg(meter_reading) FROM readings WHERE "timestamp" < TIMESTAMP ' + chr(39) + '1996-01-01' + chr(39) + ')), 0), exp(14) - 1)', 4, 'y_pred')}
        FROM readings r LEFT JOIN means USING (building_id, meter) WHERE "timestamp" >= TIMESTAMP '1996-01-01'""",
        means="""SELECT building_id, meter, avg(meter_reading) AS m FROM readings WHERE "timestamp" < TIMESTAMP '1996-01-01' GROUP BY ALL""",
    ),
)
def baseline_mean(spark, d):
    train, val = split_at(frames.readings(spark, d), "1996-01-01")
    return baseline_group_mean(train, val, KEYS).select("building_id", "meter", "l_orderkey", r("y_true"), r("y_pred"))


@query(
    "map_lookup",
    on(
        "readings",
        """SELECT CASE meter WHEN 0 THEN 'electricity' WHEN 1 THEN 'chilledwater' WHEN 2 THEN 'steam' ELSE 'hotwater' END AS meter_name,
        count(*) AS n FROM readings GROUP BY meter""",
    ),
)
def map_lookup(spark, d):
    return evaluate.with_meter_name(frames.readings(spark, d)).groupBy("meter_name").agg(F.count(F.lit(1)).alias("n"))


_LABELS = dict(
    first="SELECT o_custkey AS building_id, CAST(min(o_orderkey) % 5 AS INTEGER) AS cluster FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey",
    second="SELECT o_custkey AS building_id, CAST(max(o_orderkey) % 5 AS INTEGER) AS cluster FROM orders GROUP BY o_custkey",
)


def _labels(spark, d):
    orders = frames.table(spark, d, "orders").withColumn("building_id", F.col("o_custkey"))
    first = orders.where(F.col("o_orderstatus") == "F").groupBy("building_id").agg((F.min("o_orderkey") % 5).cast("int").alias("cluster"))
    return first, orders.groupBy("building_id").agg((F.max("o_orderkey") % 5).cast("int").alias("cluster"))


@query(
    "label_join_fallback",
    on(
        "meta",
        """SELECT m.building_id, coalesce(f.cluster, s.cluster) AS cluster FROM meta m
        LEFT JOIN first f USING (building_id) LEFT JOIN second s ON m.building_id = s.building_id""",
        **_LABELS,
    ),
)
def label_join_fallback(spark, d):
    first, second = _labels(spark, d)
    return joins.join_labels(frames.meta(spark, d), first, second, ["building_id"]).select("building_id", "cluster")


@query(
    "union_first_wins",
    on(
        "meta",
        """SELECT building_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY p) AS k FROM
        (SELECT *, 0 AS p FROM first UNION ALL SELECT *, 1 AS p FROM second)) WHERE k = 1""",
        **_LABELS,
    ),
)
def union_first_wins(spark, d):
    first, second = _labels(spark, d)
    return joins.first_label(first, second, ["building_id"]).select("building_id", "cluster")


@query(
    "pred_context_join",
    on(
        "preds",
        f"""SELECT p.event_type, {sstamp('p.ts', 'ts')}, {sr('y_true')}, {sr('y_pred')}, n FROM preds p
        JOIN hourly h ON p.event_type = h.event_type AND p.ts = h.ts""",
    ),
)
def pred_context_join(spark, d):
    context = frames.hourly(spark, d).select("event_type", "ts", "n")
    joined = joins.join_predictions(frames.preds(spark, d), context, ["event_type", "ts"])
    return joined.select("event_type", stamp("ts"), r("y_true"), r("y_pred"), "n")


@query(
    "prediction_coverage",
    on(
        "preds",
        f"""SELECT (SELECT count(*) FROM preds) AS matched, count(*) AS total,
        {sr('100.0 * (SELECT count(*) FROM preds) / count(*)', 4, 'coverage_pct')} FROM hourly""",
    ),
)
def prediction_coverage(spark, d):
    out = joins.coverage(frames.preds(spark, d), frames.hourly(spark, d), ["event_type", "ts"])
    return out.withColumn("coverage_pct", r("coverage_pct"))


@query(
    "top_outliers",
    on(
        "daily",
        """SELECT m.building_id, primary_use, square_feet, meter_reading FROM meta m JOIN
        (SELECT building_id, max(y) AS meter_reading FROM daily GROUP BY building_id ORDER BY 2 DESC, 1 LIMIT 15) USING (building_id)""",
    ),
)
def top_outliers(spark, d):
    rows = frames.daily(spark, d).withColumnRenamed("y", "meter_reading")
    return explore.top_outliers(rows, frames.meta(spark, d), 15)


def _run(spark, d, share: float):
    """Scores by event type of the lagged value, scaled."""
    scaled = frames.preds(spark, d).withColumn("y_pred", F.col("y_pred") * share)
    return evaluate.score_by(scaled, "event_type").withColumnRenamed("event_type", "model")


_RUN = "SELECT event_type AS model, sqrt(avg(pow(y_true - {k} * y_pred, 2))) AS rmse FROM preds {w} GROUP BY event_type"


@query(
    "ablation_delta",
    on(
        "preds",
        f"""SELECT model, {sr('a.rmse', 4, 'engineered')}, {sr('b.rmse', 4, 'raw')}, {sr('b.rmse - a.rmse', 4, 'delta')},
        {sr('100 * (b.rmse - a.rmse) / b.rmse', 4, 'pct_improvement')} FROM a JOIN b USING (model)""",
        a=_RUN.format(k=0.8, w=""),
        b=_RUN.format(k=1.0, w="WHERE event_type <> 'error'"),
    ),
)
def ablation_delta(spark, d):
    first, second = _run(spark, d, 0.8), _run(spark, d, 1.0).where(F.col("model") != "error")
    out = joins.compare_runs(first, second)
    return out.select("model", *[r(c) for c in ("engineered", "raw", "delta", "pct_improvement")])


@query(
    "common_models",
    on("preds", "SELECT DISTINCT event_type AS model FROM preds WHERE event_type <> 'error'"),
)
def common_models(spark, d):
    return joins.common_values(_run(spark, d, 0.8), _run(spark, d, 1.0).where(F.col("model") != "error"), "model")


@query(
    "upsert_results",
    on(
        "preds",
        f"SELECT model, {sr('rmse')} FROM a WHERE model NOT IN (SELECT model FROM b) UNION ALL SELECT model, {sr('rmse')} FROM b",
        a=_RUN.format(k=1.0, w=""),
        b=_RUN.format(k=0.8, w="WHERE event_type IN ('error', 'view')"),
    ),
)
def upsert_results(spark, d):
    new = _run(spark, d, 0.8).where(F.col("model").isin("error", "view"))
    return tables.upsert_results(_run(spark, d, 1.0), new).select("model", r("rmse"))


@query("union_folds", on("hourly", f"SELECT event_type, {sstamp('ts')}, y FROM hourly"))
def union_folds(spark, d):
    train, val = split_at(frames.hourly(spark, d), CUT, "ts")
    return train.unionByName(val).select("event_type", stamp("ts"), "y")
