"""Registry of queries, and the frames of `meterlake.sources.frames` as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is what an independent engine runs on the same tables."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(c: str | Column, places: int = 4, name: str | None = None) -> Column:
    """A double rounded for comparison; the nudge moves means off rounding ties."""
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column.cast("double") + F.lit(1e-9), places)
    return out.alias(name or c) if name or isinstance(c, str) else out


def stamp(c: str, name: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def sr(expr: str, places: int = 4, name: str | None = None) -> str:
    """The SQL form of `r`."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, {places}) AS {name or expr}"


def sstamp(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


FRAMES = {
    "hourly": """SELECT event_type, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS y, count(*) AS n
        FROM events GROUP BY ALL""",
    "meta": """SELECT c_custkey AS building_id, c_nationkey AS site_id, c_mktsegment AS primary_use,
        greatest(c_acctbal, 0.0) AS square_feet,
        CASE WHEN c_acctbal >= 0 THEN CAST(1900 + c_custkey % 110 AS DOUBLE) END AS year_built FROM customer""",
    "daily": """SELECT m.*, o_orderpriority AS meter, o_orderdate AS ts, o_totalprice AS y, o_orderkey
        FROM orders JOIN meta m ON o_custkey = building_id""",
    "weather": """SELECT s_nationkey AS site_id, l_shipdate AS "timestamp",
        CASE WHEN day(l_shipdate) NOT IN (5, 6, 7) THEN avg(l_quantity) END AS air_temperature,
        CASE WHEN day(l_shipdate) NOT IN (5, 6, 7) THEN avg(l_quantity) / 2 - 3 END AS dew_temperature,
        CASE WHEN min(l_linenumber) <> 2 THEN CAST(min(l_linenumber) AS DOUBLE) END AS cloud_coverage,
        CASE WHEN max(l_linenumber) <> 3 THEN CAST(max(l_linenumber) AS DOUBLE) END AS precip_depth_1_hr
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_shipdate""",
    "zeros": """SELECT l_suppkey AS building_id, l_shipdate AS ts, l_discount AS y, l_orderkey, l_linenumber, l_partkey
        FROM lineitem""",
    "readings": """SELECT l_suppkey AS building_id,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS meter, l_shipdate AS "timestamp",
        CASE WHEN l_tax = 0.08 AND l_linenumber = 7 THEN -l_quantity WHEN l_discount = 0 THEN 0.0
        ELSE l_quantity END AS meter_reading, l_orderkey, l_linenumber, l_partkey FROM lineitem""",
    "preds": """SELECT event_type, ts, y AS y_true, lag_y AS y_pred FROM (
        SELECT *, lag(y, 24) OVER (PARTITION BY event_type ORDER BY ts) AS lag_y FROM hourly) WHERE lag_y IS NOT NULL""",
    "model_preds": """SELECT *, 'lag' AS model FROM preds UNION ALL
        SELECT p.event_type, p.ts, p.y_true, m.y_pred, 'mean' AS model FROM preds p
        JOIN (SELECT event_type, avg(y) AS y_pred FROM hourly GROUP BY event_type) m ON p.event_type = m.event_type""",
    "building_preds": """SELECT building_id, site_id, primary_use, meter, ts, o_orderkey, y AS y_true,
        avg(y) OVER (PARTITION BY building_id) * 0.9 AS y_pred FROM daily""",
}
NEEDS = {
    "daily": ["meta"],
    "preds": ["hourly"],
    "model_preds": ["hourly", "preds"],
    "building_preds": ["meta", "daily"],
}


def on(frames: str, body: str, **more: str) -> str:
    """`body` over the named frames and further common table expressions."""
    parts: dict[str, str] = {}
    for name in frames.split():
        for f in [*NEEDS.get(name, []), name]:
            parts[f] = FRAMES[f]
    parts.update(more)
    uses = " ".join([*parts.values(), body])
    often = {n for n in parts if len(re.findall(rf"\b{n}\b", uses)) > 1}  # worked out once
    return "WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' * (n in often)}({q})" for n, q in parts.items()) + " " + body


def scores(true: str = "y_true", pred: str = "y_pred", places: int = 4) -> str:
    """The SQL of one score row."""
    gap = f"({true} - {pred})"
    rmse = f"sqrt(avg({gap} * {gap}))"
    log_gap = f"(ln(1 + greatest({pred}, 0)) - ln(1 + greatest({true}, 0)))"
    return ", ".join(
        [
            "count(*) AS n",
            sr(rmse, places, "rmse"),
            sr(f"avg(abs({gap}))", places, "mae"),
            sr(f"{rmse} / nullif(avg({true}), 0)", places, "cv_rmse"),
            sr(f"sqrt(avg({log_gap} * {log_gap}))", places, "rmsle"),
        ]
    )


def rounded_scores(places: int = 4) -> list[Column]:
    return [F.col("n"), *[r(c, places) for c in ("rmse", "mae", "cv_rmse", "rmsle")]]
