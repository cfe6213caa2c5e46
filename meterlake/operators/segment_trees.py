"""Boosted trees of all segments at once.

Every segment has trees of its own. Segments of at most `LOCAL_ROWS` rows are dealt out to tasks, each of which grows all rounds
of some of them together, so that they take one shuffle whatever the rounds and depth. The others grow together in rounds of
jobs: their rows of equal bins are one weighted cell, and one pass over the cells per level adds up histograms keyed by
(segment, node, feature, bin), from which the best cut of every node of every segment follows. Nothing of a segment comes to
the driver, so that there may be as many segments as there are keys, and a segment that holds much of the data meets only as
histograms. Both ways give the same trees, up to rounding.

Features are binned once, by edges common to all segments; nulls fall into the lowest bin. Each segment keeps its own best round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.session import durable

MOST_BINS = 255
LOCAL_ROWS = 1 << 16  # a segment of at most so many rows is grown by one task
BUCKET_ROWS = 200_000  # rows of such segments that one task grows at a time, about
SEGMENT, BINS = "_segment", "_bins"
SUMS = ("n", "s", "q", "held_n", "held_s", "held_q")  # of a cell: rows, sum and sum of squares of the label, learned and held


@dataclass
class SegmentTrees:
    """`trees`: _segment, round, feature, cut (nodes in level order; -1 where a node is not cut) and value (leaves).
    `starts`: _segment, start, best (the round kept), n (training rows). `losses`: _segment, round, loss."""

    features: list[str]
    edges: list[list[float]]
    step: float
    depth: int
    trees: DataFrame
    starts: DataFrame
    losses: DataFrame


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = 32, error: float = 0.001) -> list[list[float]]:
    """Inner edges of about `bins` bins of equal counts for each feature; fewer where values repeat."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins are from 2 to {MOST_BINS}")
    numbers = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = numbers.approxQuantile(list(features), [k / bins for k in range(1, bins)], error)
    return [sorted(set(e)) for e in found]


def _binned(features: Sequence[str], edges: Sequence[Sequence[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f"_f{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))]
            # a value on an edge lies below it, as x <= cut says; no value counts as the lowest
            bins = [np.searchsorted(e, np.where(np.isnan(x), -np.inf, x), side="left") for e, x in zip(edges, columns)]
            packed = np.column_stack(bins).astype(np.uint8) if len(batch) else np.zeros((0, len(features)), np.uint8)
            kept = [batch.column(c) for c in batch.schema.names if not c.startswith("_f")]
            names = [c for c in batch.schema.names if not c.startswith("_f")]
            ends = np.arange(len(packed) + 1, dtype=np.int32) * len(features)
            codes = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([*kept, codes], names=[*names, BINS])

    return run


def _with_bins(rows: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], kept: Sequence[Column]) -> DataFrame:
    wide = rows.select(*kept, *[F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(features)])
    fields = [f for f in wide.schema if not f.name.startswith("_f")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {BINS} binary"
    return wide.mapInArrow(_binned(features, edges), schema)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node each row reaches after so many levels, as its number in level order from 1."""
    node, each = np.ones(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = feature[each, node - 1]
        node = 2 * node + ((f >= 0) & (x[each, np.maximum(f, 0)] > cut[each, node - 1]))
    return node


def _histograms(width: int, level: int):
    """Rows and sums of what is left of the label, by segment, node, feature and bin of a batch of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, n, left = _unpacked(batch.column(BINS), width), batch.column("_n").to_numpy(), batch.column("_left").to_numpy()
            node = np.ones(len(x), np.int64)
            if level:
                node = _walk(x, _matrix(batch.column("feature"), np.int64, 2**level - 1), _matrix(batch.column("cut"), np.int64, 2**level - 1), level)
            segments = batch.column(SEGMENT).dictionary_encode(null_encoding="encode")
            here = segments.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = here * 2 ** (level + 1) + node
            keys = ((group[:, None] * width + np.arange(width)) * 256 + x).ravel()
            found, at = np.unique(keys, return_inverse=True)
            rest, bins = np.divmod(found, 256)
            rest, features = np.divmod(rest, width)
            code, nodes = np.divmod(rest, 2 ** (level + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    segments.dictionary.take(pa.array(code)),
                    *(pa.array(a.astype(np.int32)) for a in (nodes, features, bins)),
                    pa.array(np.bincount(at, np.repeat(n, width), minlength=len(found)).astype(np.int64)),
                    pa.array(np.bincount(at, np.repeat(left, width), minlength=len(found))),
                ],
                names=[SEGMENT, "node", "f", "b", "n", "s"],
            )

    return run


def _best_cuts(histograms: DataFrame, min_rows: int) -> DataFrame:
    """One row per segment and node: f and b of the best cut (-1 where none gains), and rows and sums of both sides."""
    line = Window.partitionBy(SEGMENT, "node", "f")
    upto = line.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = histograms.groupBy(SEGMENT, "node", "f", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cuts = sums.select(
        SEGMENT, "node", "f", "b", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(line).alias("n"), F.sum("s").over(line).alias("s")
    )
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / F.col("nl") + F.when(nr > 0, sr * sr / F.nullif(nr, F.lit(0))) - F.col("s") * F.col("s") / F.col("n")
    allowed = (F.col("nl") >= min_rows) & (nr >= min_rows) & (gain > 1e-12)
    # the largest gain; among equals the first feature, then the lowest cut
    order = F.struct(F.coalesce(F.when(allowed, gain), F.lit(0.0)), -F.col("f"), -F.col("b"))
    picked = cuts.withColumn("ok", F.coalesce(allowed, F.lit(False))).groupBy(SEGMENT, "node").agg(F.max_by(F.struct("ok", "f", "b", "nl", "sl", "n", "s"), order).alias("t"))
    cut = lambda a, b: F.when(F.col("t.ok"), F.col(f"t.{a}")).otherwise(b)
    sides = [cut("nl", F.col("t.n")).alias("nl"), cut("sl", F.col("t.s")).alias("sl"), F.col("t.n").alias("n"), F.col("t.s").alias("s")]
    return picked.select(SEGMENT, "node", cut("f", -1).alias("f"), cut("b", 0).alias("b"), *sides)


def _as_arrays(cuts: DataFrame, levels: int) -> DataFrame:
    """One row per segment: feature and cut of all nodes of the first levels; nodes no row reached are not cut."""
    nodes = F.sequence(F.lit(1), F.lit(2**levels - 1))
    one = cuts.groupBy(SEGMENT).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("f", "b")))).alias("at"))
    get = lambda name, none: F.transform(nodes, lambda i: F.coalesce(F.try_element_at("at", i)[name], F.lit(none)))
    return one.select(SEGMENT, get("f", -1).alias("feature"), get("b", 0).alias("cut"))


def _with_leaves(cuts: DataFrame, depth: int) -> DataFrame:
    """The arrays of `_as_arrays` and the mean of what is left in every leaf, as array value."""
    last = cuts.where(F.col("node") >= 2 ** (depth - 1))
    mean = lambda s, n: F.coalesce(s / F.nullif(n, F.lit(0)), F.lit(0.0))
    right = mean(F.col("s") - F.col("sl"), F.col("n") - F.col("nl"))
    two = F.array(F.struct((2 * F.col("node")).alias("node"), mean(F.col("sl"), F.col("nl")).alias("v")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("v")))
    leaves = last.select(SEGMENT, F.explode(two).alias("l")).groupBy(SEGMENT).agg(F.map_from_entries(F.collect_list("l")).alias("at"))
    value = F.transform(F.sequence(F.lit(2**depth), F.lit(2 ** (depth + 1) - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))
    values = leaves.select(F.col(SEGMENT).alias("_s"), value.alias("value"))
    arrays = _as_arrays(cuts, depth)
    return arrays.join(values, F.col(SEGMENT).eqNullSafe(F.col("_s"))).drop("_s")


def _joined(rows: DataFrame, one_per_segment: DataFrame, how: str = "inner") -> DataFrame:
    side = one_per_segment.withColumnRenamed(SEGMENT, "_s")
    return rows.join(side, F.col(SEGMENT).eqNullSafe(F.col("_s")), how).drop("_s")


def _added(width: int, depth: int, step: float):
    """Cells with the score after one more tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("score").to_numpy()
            if len(batch):
                feature, cut = (_matrix(batch.column(c), np.int64, 2**depth - 1) for c in ("feature", "cut"))
                leaf = _walk(_unpacked(batch.column(BINS), width), feature, cut, depth) - 2**depth
                score = score + step * _matrix(batch.column("value"), float, 2**depth)[np.arange(len(batch)), leaf]
            kept = [SEGMENT, BINS, *SUMS]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(score)], names=[*kept, "score"])

    return run


def fit(
    rows: DataFrame, features: Sequence[str], segment: str, label: str = "label", held: Column | None = None, rounds: int = 50,
    patience: int = 5, step: float = 0.1, depth: int = 3, min_rows: int = 20, edges: Sequence[Sequence[float]] | None = None, bins: int = 32,
) -> SegmentTrees:
    """Trees for every value of `segment` that has training rows, null included.

    Rows where `held` holds are not learned from: they give the loss of each segment after each round, and the segment's
    round of the least loss is kept, the earliest among equals. A segment without held rows uses its training rows. Fitting
    ends after `rounds`, or when no segment had a new best round for `patience` rounds. Rows without a label are left out. A
    cut leaves at least `min_rows` rows on each side. No rows give a model without segments.
    """
    if rounds < 0 or patience < 1 or depth < 1 or min_rows < 1:
        raise ValueError("rounds is at least 0; patience, depth and min_rows at least 1")
    features = list(features)
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    known = rows.where(F.col(label).isNotNull())
    edges = [sorted(float(v) for v in e) for e in edges or bin_edges(known.where(~held), features, bins)]
    if len(edges) != len(features) or any(len(e) > MOST_BINS for e in edges):
        raise ValueError(f"edges are a list per feature, of at most {MOST_BINS}")
    width, kind = len(features), rows.schema[segment].dataType.simpleString()
    kept = [F.col(segment).alias(SEGMENT), F.col(label).cast("double").alias("y"), held.alias("held")]
    binned = durable(_with_bins(known, features, edges, kept))
    learned = F.when(~F.col("held"), F.col("y"))
    starts = durable(binned.groupBy(SEGMENT).agg(F.avg(learned).alias("start"), F.count(learned).alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0"))
    small = F.col("rows") <= LOCAL_ROWS
    n_small, n_large, n_rows = starts.agg(F.count_if(small), F.count_if(~small), F.sum(F.when(small, F.col("rows")))).first()
    many = lambda which: starts.where(which).select(SEGMENT, "start")
    losses, trees, gained = [], [], set()
    if n_small:
        some = _joined(binned, many(small)).select(SEGMENT, "y", "held", BINS)
        bucket = F.pmod(F.xxhash64(SEGMENT), F.lit(-(-n_rows // BUCKET_ROWS)))
        made = f"{SEGMENT} {kind}, round int, loss double, gained boolean, feature array<int>, cut array<int>, value array<double>"
        bins = [len(e) + 1 for e in edges]
        grown = durable(some.groupBy(bucket.alias("bucket")).applyInArrow(_grown(bins, rounds, step, depth, min_rows), made))
        losses.append(grown.select(SEGMENT, "round", "loss"))
        trees.append(grown.where("round > 0").select(SEGMENT, "feature", "cut", "value", "round"))
        gained = {r["round"] for r in grown.where("gained").select("round").distinct().collect()}  # one row per round at most
    done = rounds
    if n_large:
        cells = durable(_cells(_joined(binned, many(~small))))
        done = _in_rounds(cells, kind, width, losses, trees, gained, rounds, patience, step, depth, min_rows)
    else:
        done = next((k for k in range(patience, rounds) if _ended(k, gained, patience)), rounds)
    none = lambda fields: rows.sparkSession.createDataFrame([], f"{SEGMENT} {kind}, {fields}")
    union = lambda frames, fields: reduce(DataFrame.unionByName, frames) if frames else none(fields)
    all_losses = durable(union(losses, "round int, loss double").where(F.col("round") <= done))
    best = all_losses.groupBy(SEGMENT).agg(F.min_by("round", F.struct("loss", "round")).alias("best"))
    kept_starts = durable(_joined(starts.drop("rows"), best))
    every = union(trees, "feature array<int>, cut array<int>, value array<double>, round int")
    cut_back = _joined(every, kept_starts.select(SEGMENT, "best")).where(F.col("round") <= F.col("best")).drop("best")
    return SegmentTrees(features, edges, step, depth, durable(cut_back), kept_starts, all_losses)


def _ended(done: int, gained: set[int], patience: int) -> bool:
    """Whether no segment had a new best round for so long."""
    return done - max((k for k in gained if k <= done), default=0) >= patience


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of a segment with equal bins as one, with labels less the `start` of the segment. Cells of a segment lie
    together: batches then hold few segments, and histograms leave the tasks small."""
    y, held = F.col("y") - F.col("start"), F.col("held")
    total = lambda which, c: F.coalesce(F.sum(F.when(which, c)), F.lit(0.0))
    sums = [F.count_if(~held), total(~held, y), total(~held, y * y), F.count_if(held), total(held, y), total(held, y * y)]
    made = rows.groupBy(SEGMENT, BINS).agg(*[c.alias(name) for c, name in zip(sums, SUMS)])
    return made.repartitionByRange(SEGMENT, BINS).sortWithinPartitions(SEGMENT).withColumn("score", F.lit(0.0))


def _in_rounds(
    cells: DataFrame, kind: str, width: int, losses: list[DataFrame], trees: list[DataFrame], gained: set[int], rounds: int, patience: int,
    step: float, depth: int, min_rows: int,
) -> int:
    """Grow the trees of all segments of `cells`, a round of jobs at a time, and add them and their losses to the lists; `gained`
    are the rounds in which other segments had a new best one. The number of rounds done comes back."""
    fields = f"{SEGMENT} {kind}, {BINS} binary, {', '.join(f'{c} long' if c.endswith('n') else f'{c} double' for c in SUMS)}, score double"

    def loss(df: DataFrame, done: int) -> DataFrame:
        error = lambda n, s, q: F.sum(F.col(q) - 2 * F.col("score") * F.col(s) + F.col(n) * F.col("score") * F.col("score"))
        mean = lambda n, s, q: F.greatest(F.lit(0.0), error(n, s, q) / F.nullif(F.sum(n), F.lit(0)))
        each = F.when(F.sum("held_n") > 0, mean("held_n", "held_s", "held_q")).otherwise(mean("n", "s", "q"))
        return durable(df.groupBy(SEGMENT).agg(each.alias("loss")).select(SEGMENT, F.lit(done).alias("round"), "loss"))

    state, own = cells, [loss(cells, 0)]
    done = 0
    for done in range(1, rounds + 1):
        cuts, train = [], state.where("n > 0").select(SEGMENT, BINS, F.col("n").alias("_n"), (F.col("s") - F.col("n") * F.col("score")).alias("_left"))
        for level in range(depth):
            seen = _joined(train, _as_arrays(reduce(DataFrame.unionByName, cuts), level)) if level else train
            found = seen.mapInArrow(_histograms(width, level), f"{SEGMENT} {kind}, node int, f int, b int, n long, s double")
            cuts.append(durable(_best_cuts(found, min_rows)))
        tree = durable(_with_leaves(reduce(DataFrame.unionByName, cuts), depth))
        trees.append(tree.withColumn("round", F.lit(done)))
        state = durable(_joined(state, tree).mapInArrow(_added(width, depth, step), fields))
        own.append(loss(state, done))
        if patience <= done < rounds:
            best = reduce(DataFrame.unionByName, own).groupBy(SEGMENT).agg(F.min_by("round", F.struct("loss", "round")).alias("best"))
            latest = best.agg(F.max("best")).first()[0] or 0
            if _ended(done, gained | {latest}, patience):
                break
    losses += own
    return done


def _grown(bins: Sequence[int], rounds: int, step: float, depth: int, min_rows: int):
    """All rounds of the segments of a group of rows: per segment and round the loss, whether it is the least so far, and the
    tree (null in round 0)."""

    def cuts(x, left, at, m):
        """By place (segment and node) the feature and bin of the best cut, as `_best_cuts` has it."""
        best, f, b = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        n, s = np.bincount(at, minlength=m)[:, None], np.bincount(at, left, m)[:, None]
        for j, k in enumerate(bins):
            cell = at * k + x[:, j]
            nl = np.bincount(cell, minlength=m * k).reshape(m, k).cumsum(axis=1)
            sl = np.bincount(cell, left, m * k).reshape(m, k).cumsum(axis=1)
            nr, sr = n - nl, s - sl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sl * sl / nl + sr * sr / nr - s * s / n
                gain = np.where((nl >= min_rows) & (nr >= min_rows) & (gain > 1e-12), gain, 0.0)
            cut = gain.argmax(axis=1)
            top = gain[np.arange(m), cut]
            more = top > best
            best, f, b = np.where(more, top, best), np.where(more, j, f), np.where(more, cut, b)
        return f, b

    def run(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).combine_chunks()
        coded = column(SEGMENT).dictionary_encode(null_encoding="encode")
        code, g = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        y, held = column("y").to_numpy(zero_copy_only=False), column("held").to_numpy(zero_copy_only=False)
        x, train = _unpacked(column(BINS), len(bins)), ~held
        per = lambda which, v=None: np.bincount(code[which], None if v is None else v[which], g)
        score = (per(train, y) / per(train))[code]
        judged = np.where((per(held) > 0)[code], held, train)
        all_f, all_b, all_v, losses = [], [], [], []
        for k in range(rounds + 1):
            if k:
                left, node = y - score, np.ones(len(x), np.int64)
                f, b = np.full((g, 2**depth), -1), np.zeros((g, 2**depth), np.int64)  # by node
                for level in range(depth):
                    m = 2**level
                    found = cuts(x[train], left[train], (code * m + node - m)[train], g * m)
                    f[:, m : 2 * m], b[:, m : 2 * m] = (a.reshape(g, m) for a in found)
                    here = f[code, node]
                    node = 2 * node + ((here >= 0) & (x[np.arange(len(x)), np.maximum(here, 0)] > b[code, node]))
                leaf, m = code * 2**depth + node - 2**depth, g * 2**depth
                value = np.bincount(leaf[train], left[train], m) / np.maximum(np.bincount(leaf[train], minlength=m), 1)
                score = score + step * value[leaf]
                all_f.append(f[:, 1:]), all_b.append(b[:, 1:]), all_v.append(value.reshape(g, -1))
            losses.append(per(judged, (y - score) ** 2) / per(judged))
        losses = np.array(losses)
        least = np.minimum.accumulate(losses, axis=0)
        gained = np.concatenate([np.zeros((1, g), bool), losses[1:] < least[:-1]])

        def lists(parts, kind):  # none in round 0
            ends = np.concatenate([np.zeros(g, np.int32), np.arange(g * rounds + 1, dtype=np.int32) * parts.shape[-1]])
            nulls = pa.array(np.arange(len(ends)) < g)
            return pa.ListArray.from_arrays(pa.array(ends, mask=nulls.to_numpy(zero_copy_only=False)), pa.array(parts.ravel(), kind))

        shape = lambda parts, w: np.array(parts).reshape(rounds * g, w)
        columns = [
            coded.dictionary.take(pa.array(np.tile(np.arange(g), rounds + 1))), pa.array(np.repeat(np.arange(rounds + 1), g), pa.int32()), pa.array(losses.ravel()),
            pa.array(gained.ravel()), lists(shape(all_f, 2**depth - 1), pa.int32()), lists(shape(all_b, 2**depth - 1), pa.int32()), lists(shape(all_v, 2**depth), pa.float64()),
        ]
        return pa.Table.from_arrays(columns, names=[SEGMENT, "round", "loss", "gained", "feature", "cut", "value"])

    return run


def _scored(width: int, depth: int, step: float):
    nodes = 2**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, score = _unpacked(batch.column(BINS), width), batch.column("start").to_numpy().copy()
            codes = batch.column(SEGMENT).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            _, firsts = np.unique(codes, return_index=True)
            # trees of a segment are the same on all of its rows; those of the segments of a batch are one table by segment and round
            lists = {c: batch.column(c).take(pa.array(firsts)) for c in ("feature", "cut", "value")}
            per = {"feature": nodes - 1, "cut": nodes - 1, "value": nodes}
            grown = lists["value"].value_lengths().to_numpy(zero_copy_only=False) // nodes if len(batch) else np.zeros(0, np.int64)
            first = np.cumsum(grown) - grown
            tables = {c: v.flatten().to_numpy(zero_copy_only=False).reshape(-1, per[c]) for c, v in lists.items()}
            for k in range(max(grown, default=0)):
                here = np.flatnonzero(grown[codes] > k)
                at = first[codes[here]] + k
                leaf = _walk(x[here], tables["feature"][at].astype(np.int64), tables["cut"][at], depth) - nodes
                score[here] += step * tables["value"][at, leaf]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "prediction"])

    return run


def predict(model: SegmentTrees, rows: DataFrame, segment: str, prediction: str = "prediction") -> DataFrame:
    """`rows` of the segments the model knows, with the prediction of their segment's trees in its best round."""
    kept = [c for c in rows.columns if c != prediction]
    columns = [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(segment).alias(SEGMENT)]
    grown = model.trees.groupBy(SEGMENT).agg(F.array_sort(F.collect_list(F.struct("round", "feature", "cut", "value"))).alias("trees"))
    known = _joined(model.starts.select(SEGMENT, "start"), grown, "left")
    none = {"feature": "array<int>", "cut": "array<int>", "value": "array<double>"}
    flat = [F.coalesce(F.flatten(F.col("trees")[c]), F.array().cast(kind)).alias(c) for c, kind in none.items()]
    known = durable(known.select(SEGMENT, "start", *flat))
    binned = _joined(_with_bins(rows, model.features, model.edges, columns), known)
    out = binned.mapInArrow(_scored(len(model.features), model.depth, model.step), f"row {binned.schema['row'].dataType.simpleString()}, prediction double")
    return out.select("row.*", F.col("prediction").alias(prediction))


def importances(model: SegmentTrees) -> DataFrame:
    """How often each segment's trees cut each feature: segment, feature and n_cuts, cut features only."""
    names = F.array(*[F.lit(f) for f in model.features])
    cuts = model.trees.select(SEGMENT, F.explode("feature").alias("f")).where(F.col("f") >= 0)
    return cuts.groupBy(SEGMENT, names[F.col("f")].alias("feature")).agg(F.count(F.lit(1)).alias("n_cuts"))
