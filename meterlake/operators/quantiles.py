"""Exact quantiles by group, for groups of any size.

`percentile` keeps one value-to-count map per group in a single task. Groups above `large_rows` take two passes: one
builds a mergeable sketch per group, whose quantiles bracket the wanted ranks, and one counts what lies in the brackets,
about 8 / SKETCH of the rows. The result is exact whatever the sketch says, and the number of passes does not depend on
the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.series import same_keys
from meterlake.session import durable

SKETCH = 32_768  # parameter of the sketches; their ranks are off by about 2 / SKETCH of the rows


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], large_rows: int = 5_000_000
) -> DataFrame:
    """One row per group with `q`, the array of linearly interpolated quantiles; nulls and NaN are skipped.

    Without keys the whole table is one group.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    probs_array = F.array(*[F.lit(float(p)) for p in probs])
    exact = F.percentile("_v", probs_array).alias("q")
    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    large = sizes.where(F.col("_n") > large_rows)
    if large.isEmpty():
        # a global aggregate over no rows still gives its one (null) row
        return rows.groupBy(*keys).agg(exact) if keys else rows.agg(exact)
    large = durable(large)  # Spark knows its size then
    small = rows.join(large, same_keys(rows, large, by), "left_anti").groupBy(*by).agg(exact)
    out = small.unionByName(_by_sketch(rows, large, by, probs))
    return out.select(*keys, "q")


def global_quantiles(df: DataFrame, value: str, probs: Sequence[float], large_rows: int = 5_000_000) -> DataFrame:
    """The one-row form of `group_quantiles`."""
    return group_quantiles(df, [], value, probs, large_rows)


def _by_sketch(rows: DataFrame, groups: DataFrame, by: list[str], probs, k: int = SKETCH) -> DataFrame:
    """Sketches, merged from those of the tasks, bracket every wanted quantile. One more pass counts the values inside the
    brackets and the rows below, and so reads the ranks exactly. A bracket that turns out to miss a rank is widened."""
    wanted = groups.select(*by, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"))
    wanted = wanted.withColumn("at", F.col("p") * (F.col("_n") - 1))
    mine = rows.join(groups.select(*by), same_keys(rows, groups, by), "left_semi")
    sketches = durable(mine.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("_sketch")))
    bounds = _matched(sketches, groups.select(*by, "lo", "hi"), by)
    missed = durable(wanted.select(*by, "i", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct())
    found = None
    for wide in (4, 64, None):
        open_still = missed.select(*by, "i").distinct()
        brackets = durable(_matched(open_still, _brackets(bounds, by, probs, wide and wide / k), [*by, "i"]))
        values = durable(_holding_ranks(_counted(mine, brackets, by), missed, by))
        found = values if found is None else found.unionByName(values)
        missed = missed.join(values, same_keys(missed, values, [*by, "i", "rank"]), "left_anti")
        if missed.isEmpty():
            return _interpolate(wanted, found, by)
    raise AssertionError("the whole range of a group holds all its ranks")


def _matched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    more = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in right.columns if c not in by])
    match = F.lit(True)
    for i, k in enumerate(by):
        match = match & left[k].eqNullSafe(more[f"_k{i}"])
    return left.join(more, match).drop(*[f"_k{i}" for i in range(len(by))])


def _brackets(bounds: DataFrame, by: list[str], probs, margin: float | None) -> DataFrame:
    """For each probability the values of the sketch at `margin` (a share of the rows) before and after it."""

    def at(p: float) -> Column:
        return F.kll_sketch_get_quantile_double("_sketch", F.lit(p))

    sides = []
    for i, p in enumerate(probs):
        low = F.col("lo") if margin is None or p - margin <= 0 else at(p - margin)
        high = F.col("hi") if margin is None or p + margin >= 1 else at(p + margin)
        sides.append(F.struct(F.lit(i).alias("i"), low.alias("lo"), high.alias("hi")))
    return bounds.select(*by, F.explode(F.array(*sides)).alias("s")).select(*by, "s.*")


def _counted(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Per bracket, how often each value inside occurs; the rows below are one more count, of null."""
    marks = brackets.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], "i", "lo", "hi")
    match = rows["_v"] <= marks["hi"]
    for i, k in enumerate(by):
        match = match & rows[k].eqNullSafe(marks[f"_b{i}"])
    inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("v")
    return rows.join(marks, match).groupBy(*by, "i", inside).agg(F.count(F.lit(1)).alias("held"))


def _holding_ranks(counted: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """The counted value that holds each rank; none if the rank lies outside its bracket."""
    order = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first())
    end = F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("held")).where(F.col("v").isNotNull())
    pairs = _matched(placed, ranks, [*by, "i"])
    return pairs.where((F.col("_start") <= F.col("rank")) & (F.col("rank") < F.col("_end"))).select(*by, "i", "rank", "v")


def _interpolate(wanted: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    def read(frame: DataFrame, side: Column, name: str) -> DataFrame:
        picked = values.select(*[F.col(k).alias(f"_{name}{i}") for i, k in enumerate(by)], F.col("i").alias(f"_{name}p"), F.col("rank").alias(f"_{name}r"), F.col("v").alias(name))
        match = (side == picked[f"_{name}r"]) & (frame["i"] == picked[f"_{name}p"])
        for i, k in enumerate(by):
            match = match & frame[k].eqNullSafe(picked[f"_{name}{i}"])
        return frame.join(picked, match)

    both = read(wanted, F.floor(wanted["at"]), "v0")
    both = read(both, F.ceil(both["at"]), "v1")
    # as `percentile` does, so that the size of a group makes no difference
    between = (F.ceil("at") - F.col("at")) * F.col("v0") + (F.col("at") - F.floor("at")) * F.col("v1")
    value = F.when((F.ceil("at") == F.floor("at")) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise(between)
    # one entry per requested probability
    pairs = F.array_sort(F.collect_list(F.struct("i", value.alias("x"))))
    return both.groupBy(*by).agg(F.transform(pairs, lambda s: s["x"]).alias("q"))
