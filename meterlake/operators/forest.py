"""Random forests on binned features, all trees grown together.

Features are cut into bins once, and rows of the same bins are kept together as a cell, with the label of every row, since
each row is drawn on its own for each tree. The cells are written in chunks; the draw of a tree in a chunk depends on the
seed, the tree and the chunk alone, so that every job sees the same draw. The upper levels of a tree come from histograms
summed over all tasks, one job a level for all trees; a node of at most `LOCAL_CELLS` cells is sent to one task, which
grows what is below it; where there are no more cells than that, whole trees are. Values are looked up once per cell. The fitted trees, whose size the depth bounds, are arrays that
the driver holds and broadcasts.

Forests of nested groups of rows, such as growing prefixes, read one table of chunks (`Nested`), in which the rows of the smallest
group come first. Each group keeps its own bins: the common ones end wherever those of a group do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import durable

CHUNK_ROWS = 1 << 18  # rows of a written chunk
FILE_ROWS = 1 << 19  # rows of a written file
LOCAL_CELLS = 1 << 19  # a node of at most so many cells is grown by one task
KEPT_SUMS = 1 << 22  # sums of a level that a task keeps for the next one
TASK_BYTES = 1 << 26  # histograms a task holds at once
SENT_CELLS = 1 << 27  # cells, over all trees, sent to tasks by one job
MAP_ROWS = 1 << 20  # rows that a task deals out to buckets at a time
NODES = 64  # nodes of one row of histograms
CODE = "_code"


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> tuple[list[np.ndarray], int]:
    """Inner edges by feature, and the number of rows. All places between different values where there are at most `bins`
    of them, else about `bins` quantiles; a value on an edge lies below it."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * len(features)
        n = 0
        for batch in batches:
            n += len(batch)
            for k, x in enumerate(_numbers(batch.columns)):
                if seen[k] is not None:
                    both = np.union1d(seen[k], x)
                    seen[k] = both if len(both) <= bins else None
        found = [pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))]
        place = pa.array(range(len(features)), pa.int32())
        yield pa.RecordBatch.from_arrays([place, *found, pa.array([n] * len(features), pa.int64())], names=["k", "seen", "n"])

    wide = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    seen: list[set | None] = [set() for _ in features]
    n = 0
    for r in wide.mapInArrow(values, "k int, seen array<double>, n long").collect():  # a row per task and feature
        n += r["n"] if r["k"] == 0 else 0
        seen[r["k"]] = None if seen[r["k"]] is None or r["seen"] is None else seen[r["k"]] | set(r["seen"])
    many = [k for k, s in enumerate(seen) if s is None or len(s) > bins]
    cuts = wide.approxQuantile([features[k] for k in many], [q / bins for q in range(1, bins)], 0.001) if many else []
    edges = [np.zeros(0) if k in many else _between(s) for k, s in enumerate(seen)]
    for k, cut in zip(many, cuts):
        edges[k] = np.array(sorted(set(cut)))
    return edges, n


def _between(values) -> np.ndarray:
    v = np.array(sorted(values))
    return (v[:-1] + v[1:]) / 2


def _numbers(columns) -> list[np.ndarray]:
    out = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
    if any(np.isnan(x).any() for x in out):
        raise ValueError("a feature or the label is null")
    return out


def _kind(edges: Sequence[np.ndarray]) -> type:
    """What holds the number of a bin: a byte, or two where a feature has more than 256 bins."""
    return np.uint8 if max(map(len, edges)) < 256 else np.uint16


def _bins(columns, edges: Sequence[np.ndarray]) -> np.ndarray:
    """By row and feature the number of edges below the value."""
    x, kind = _numbers(columns), _kind(edges)
    return np.column_stack([np.searchsorted(e, v, side="left").astype(kind) for e, v in zip(edges, x)])


def _codes(columns, edges: Sequence[np.ndarray]) -> pa.Array:
    packed = _bins(columns, edges)
    ends = np.arange(len(packed) + 1, dtype=np.int32) * packed.itemsize * len(edges)
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])


def _matrix(codes: pa.Array, width: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), kind).reshape(-1, width)


def with_code(df: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray]) -> DataFrame:
    code = F.arrow_udf(lambda *columns: _codes(columns, edges), "binary")
    return df.withColumn(CODE, code(*[F.col(f).cast("double") for f in features]))


def chunks(rows: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray], n: int, seed: int) -> DataFrame:
    """The rows, sorted by cell and written in chunks: the bins of the cells, rows by cell, and the label of every row."""
    width = len(features)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk():
            table = np.concatenate([_matrix(b.column(0), width) for b in held])
            y = np.concatenate([_numbers([b.column(1)])[0] for b in held])
            first = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1))))
            counts = np.diff(np.append(first, len(y))).astype(np.int32)
            blobs = [table[first].tobytes(), counts.tobytes(), y.tobytes()]
            columns = [pa.array([(part << 32) + made], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "cells", "counts", "y"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK_ROWS:
                yield chunk()
                made, held, size = made + 1, [], 0
        if size:
            yield chunk()

    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // FILE_ROWS))
    coded = with_code(rows, features, edges).select(CODE, F.col(label).cast("double").alias("_y"), F.rand(seed).alias("_salt"))
    # a cell of very many rows is spread over several files
    laid = coded.repartitionByRange(parts, CODE, "_y", "_salt").sortWithinPartitions(CODE).select(CODE, "_y")
    return durable(laid.mapInArrow(packed, "chunk long, cells binary, counts binary, y binary"))


@dataclass
class Settings:
    trees: int
    depth: int
    rate: float | None  # mean of the Poisson draws of a row; None takes every row once
    min_rows: int
    seed: int
    bins: list[int]  # by feature
    group: int = 0  # of nested rows: the group that is fitted,
    places: list[np.ndarray] | None = None  # and by feature the bin of each common bin


def _poisson(rate: float) -> np.ndarray:
    """The draw for each of 65,536 equally likely numbers."""
    at, term, total = [], np.exp(-rate), 0.0
    for k in range(1, 200):
        total += term
        at.append(total)
        term *= rate / k
    return np.searchsorted(np.array(at), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


class _Chunk:
    """The cells of a chunk, and what a tree draws of them."""

    def __init__(self, number: int, cells: bytes, counts: bytes, y: bytes, s: Settings):
        self.number, self.s = number, s
        self.cells = np.frombuffer(cells, np.uint8).reshape(-1, len(s.bins))
        self.y, self.counts = np.frombuffer(y), np.frombuffer(counts, np.int32)
        self.cell = np.repeat(np.arange(len(self.counts)), self.counts)  # of each row

    def draw(self, tree: int, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows drawn by cell, and the sum of their labels."""
        if table is None:
            return self.counts.astype(float), np.bincount(self.cell, self.y, len(self.counts))
        numbers = np.random.SFC64([self.s.seed, tree, self.number]).random_raw(-(-len(self.y) // 4)).view(np.uint16)[: len(self.y)]
        drawn = np.zeros(len(self.y), np.uint8)
        for least in np.searchsorted(table, np.arange(1, int(table[-1]) + 1)).astype(np.uint16):  # the first number that draws a row so often
            drawn += numbers >= least
        taken = np.flatnonzero(drawn > 0)
        cell, w = self.cell[taken], drawn[taken].astype(float)
        return np.bincount(cell, w, len(self.counts)), np.bincount(cell, w * self.y[taken], len(self.counts))


class _NestedChunk(_Chunk):
    """A chunk of nested rows as one group sees it; cells of which it has no row are never drawn."""

    def __init__(self, number: int, cells: bytes, at: bytes, y: bytes, ends: list[int], s: Settings):
        self.number, self.s, n = number, s, ends[s.group]
        common = np.frombuffer(cells, np.uint8 if max(map(len, s.places)) <= 256 else np.uint16).reshape(-1, len(s.bins))
        self.cells = np.column_stack([place[common[:, j]] for j, place in enumerate(s.places)])
        self.cell, self.y = np.frombuffer(at, np.int32)[:n].astype(np.int64), np.frombuffer(y)[:n]
        self.counts = np.bincount(self.cell, minlength=len(common))


def _read(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[_Chunk]:
    for batch in batches:
        if s.places is not None:
            for number, cells, at, y, ends in zip(*[batch.column(c) for c in ("chunk", "cells", "at", "y", "ends")]):
                yield _NestedChunk(number.as_py(), cells.as_py(), at.as_py(), y.as_py(), ends.as_py(), s)
            continue
        for number, cells, counts, y in zip(*[batch.column(c) for c in ("chunk", "cells", "counts", "y")]):
            yield _Chunk(number.as_py(), cells.as_py(), counts.as_py(), y.as_py(), s)


def _descend(cells: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, most: int = -1) -> np.ndarray:
    """The node without a split that each cell falls into, or the node after `most` splits."""
    at = np.zeros(len(cells), np.int32)
    going = np.arange(len(cells)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(going) and most:
        most -= 1
        node = at[going]
        node = left[node] + (cells[going, feature[node]] > cut[node])
        at[going] = node
        going = going[feature[node] >= 0]
    return at


def _best(w: np.ndarray, y: np.ndarray, total_w: np.ndarray, total_y: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By node the largest gain of one feature and the bin it cuts after; `w` and `y` are sums by node and bin."""
    if w.shape[1] < 2:
        return np.full(len(w), -np.inf), np.zeros(len(w), np.int64)
    lw, ly = w[:, :-1].cumsum(axis=1), y[:, :-1].cumsum(axis=1)
    rw, ry = total_w[:, None] - lw, total_y[:, None] - ly
    fits = (lw >= max(min_rows, 1)) & (rw >= max(min_rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, ly * ly / lw + ry * ry / rw - (total_y**2 / total_w)[:, None], -np.inf)
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


def _worth(gain: np.ndarray, w: np.ndarray, scale: float) -> np.ndarray:
    """Whether a gain is more than what rounding leaves of equal labels."""
    return gain > w * (1e-12 * (1 + abs(scale))) ** 2


def _best_by_node(sums: np.ndarray, total_w: np.ndarray, total_y: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """`_best` of sums by bin and node. Bin after bin, so that what is worked on stays in the cache however many nodes there are."""
    best, cut = np.full(len(total_w), -np.inf), np.zeros(len(total_w), np.int64)
    whole, least = total_y**2 / total_w, max(min_rows, 1)
    lw, ly = np.zeros_like(whole), np.zeros_like(whole)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(len(sums) - 1):
            lw += sums[k].real
            ly += sums[k].imag
            rw, ry = total_w - lw, total_y - ly
            fits = (lw >= least) & (rw >= least)
            gain = ly * ly
            gain /= lw
            ry *= ry
            ry /= rw
            gain += ry
            gain -= whole
            more = fits & (gain > best)
            np.copyto(best, gain, where=more)
            cut[more] = k
    return best, cut


def _sums(at: np.ndarray, wy: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Sums by bin and node; of rows in the real part and of their labels in the other, which are added up at once."""
    out = np.zeros(nodes * bins, np.complex128)
    np.add.at(out, at, wy)
    return out.reshape(bins, nodes)


class _Siblings:
    """Sums by bin and node of one level: only the child of fewer cells is added up, the other is what is left of its parent."""

    def __init__(self, cells: np.ndarray, node: np.ndarray, wy: np.ndarray, nodes: int):
        sizes = np.bincount(node, minlength=nodes).reshape(-1, 2)
        self.pairs, self.right = len(sizes), sizes[:, 1] < sizes[:, 0]
        taken = np.flatnonzero(np.column_stack([~self.right, self.right]).ravel()[node])
        self.cells, self.pair, self.wy = cells.take(taken, axis=0), node[taken] >> 1, wy[taken]

    def sums(self, j: int, bins: int, whole: np.ndarray) -> np.ndarray:
        part = _sums(self.cells[:, j] * np.int64(self.pairs) + self.pair, self.wy, self.pairs, bins)
        level, rest = np.empty((bins, self.pairs, 2), np.complex128), whole - part
        level[:, :, 0], level[:, :, 1] = np.where(self.right, rest, part), np.where(self.right, part, rest)
        return level.reshape(bins, -1)


def grow(cells: np.ndarray, w: np.ndarray, y: np.ndarray, depth: int, s: Settings):
    """The tree of these cells: feature (-1 at a leaf), cut, left child (the right one follows), value, and gain by feature.
    The cells are kept in the order of their nodes."""
    mean = y.sum() / w.sum()
    wy = np.empty(len(w), np.complex128)
    wy.real, wy.imag = w, y - w * mean
    feature, cut, left, value = [], [], [], []
    gains = np.zeros(len(s.bins))
    node, m, made = np.zeros(len(w), np.int64), 1, 1
    above: list[np.ndarray] = []  # by feature the sums of the nodes that were split, where they are kept
    while m:
        total = _sums(node, wy, m, 1)[0]
        tw, ty = total.real.copy(), total.imag.copy()
        best, f, c = np.full(m, -np.inf), np.full(m, -1, np.int8), np.zeros(m, np.uint8)
        level = []
        if depth > 0:
            siblings = _Siblings(cells, node, wy, m) if above else None
            for j, b in enumerate(s.bins):
                sums = siblings.sums(j, b, above[j]) if siblings else _sums(cells[:, j] * np.int64(m) + node, wy, m, b)
                gain, bin_ = _best_by_node(sums, tw, ty, s.min_rows)
                more = gain > best
                best[more], f[more], c[more] = gain[more], j, bin_[more]
                if m * sum(s.bins) <= KEPT_SUMS:
                    level.append(sums)
        split = _worth(best, tw, mean)
        f[~split] = -1
        np.add.at(gains, f[split], best[split])
        rank = np.cumsum(split) - 1
        feature.append(f), cut.append(c), value.append(mean + ty / tw)
        left.append(np.where(split, made + 2 * rank, -1).astype(np.int32))
        above = [sums[:, split] for sums in level]
        kept = np.flatnonzero(split[node])
        node = node[kept]
        child = 2 * rank[node] + (cells.take(kept * len(s.bins) + f[node]) > c[node])
        m, depth = 2 * int(split.sum()), depth - 1
        order = np.argsort(child.astype(np.uint16) if m <= 1 << 16 else child, kind="stable")
        kept, node = kept[order], child[order]
        cells, wy = cells.take(kept, axis=0), wy[kept]
        made += m
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(value), gains


class _Growing:
    """One tree while its upper levels grow: `open` are the nodes still to be decided."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value = np.full(1, -1, np.int8), np.zeros(1, np.uint8), np.full(1, -1, np.int32), np.zeros(1)
        self.open, self.local = np.zeros(1, np.int32), np.zeros(0, np.int32)
        self.gains: np.ndarray | float = 0.0

    def shape(self):
        return self.feature, self.cut, self.left

    def attach(self, nodes, feature, cut, left, value):
        """The trees `nodes` stand for take their place; each is a tuple of arrays whose first entry is the root."""
        sizes = [len(f) - 1 for f in feature]
        base = len(self.feature) + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        shifted = [np.where(le >= 0, le + b - 1, -1).astype(np.int32) for le, b in zip(left, base)]
        for name, parts in (("feature", feature), ("cut", cut), ("left", shifted), ("value", value)):
            whole = getattr(self, name).copy()
            whole[nodes] = [p[0] for p in parts]
            setattr(self, name, np.concatenate([whole, *[p[1:] for p in parts]]))


def _upper_level(cells: DataFrame, growing: dict[int, _Growing], s: Settings) -> None:
    """One level of these trees: their open nodes split, end, or become small enough for one task."""
    share = cells.sparkSession.sparkContext.broadcast({t: (g.shape(), g.open) for t, g in growing.items()})
    offsets = np.concatenate(([0], np.cumsum(s.bins)))
    width, table = int(offsets[-1]), _poisson(s.rate) if s.rate is not None else None

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for chunk in _read(batches, s):
            for t, (shape, open_) in share.value.items():
                w, y = chunk.draw(t, table)
                place = np.full(len(shape[0]), -1, np.int64)
                place[open_] = np.arange(len(open_))
                node = place[_descend(chunk.cells, *shape)]
                kept = np.flatnonzero((node >= 0) & (w > 0))
                node, w, y, m = node[kept], w[kept], y[kept], len(open_)
                out = total.setdefault(t, np.zeros((m, 2 * width + 1)))
                for j, b in enumerate(s.bins):
                    at = node * b + chunk.cells[kept, j]
                    out[:, offsets[j] : offsets[j + 1]] += np.bincount(at, w, m * b).reshape(m, b)
                    out[:, width + offsets[j] : width + offsets[j + 1]] += np.bincount(at, y, m * b).reshape(m, b)
                out[:, -1] += np.bincount(node, minlength=m)
        for t, sums in total.items():
            blocks = range(0, len(sums), NODES)
            columns = [pa.array([t] * len(blocks), pa.int32()), pa.array(list(blocks), pa.int32()), pa.array([sums[b : b + NODES].tobytes() for b in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "sums"])

    def splits(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b.as_py()) for b in group.column("sums")).reshape(-1, 2 * width + 1)
        w, y = sums[:, :width], sums[:, width : 2 * width]
        tw, ty = w[:, : s.bins[0]].sum(axis=1), y[:, : s.bins[0]].sum(axis=1)
        mean = ty.sum() / max(tw.sum(), 1.0)
        y, ty = y - w * mean, ty - tw * mean
        best, f, c = np.full(len(w), -np.inf), np.full(len(w), -1), np.zeros(len(w), np.int64)
        for j in range(len(s.bins)):
            at = slice(offsets[j], offsets[j + 1])
            gain, bin_ = _best(w[:, at], y[:, at], tw, ty, s.min_rows)
            more = gain > best
            best, f, c = np.where(more, gain, best), np.where(more, j, f), np.where(more, bin_, c)
        f = np.where(_worth(best, tw, mean), f, -1)
        columns = {"f": f.astype(float), "c": c.astype(float), "gain": best, "value": mean + ty / np.maximum(tw, 1.0), "n": sums[:, -1]}
        ends = {k: pa.array([v.tolist()], pa.list_(pa.float64())) for k, v in columns.items()}
        return pa.table({"tree": group.column("tree")[:1].cast(pa.int32()), "block": group.column("block")[:1].cast(pa.int32()), **ends})

    schema = "tree int, block int, f array<double>, c array<double>, gain array<double>, value array<double>, n array<double>"
    sums = cells.mapInArrow(histograms, "tree int, block int, sums binary")
    found = sums.groupBy("tree", "block").applyInArrow(splits, schema).collect()  # five numbers per node
    share.unpersist()
    by_tree: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r["block"]):
        by_tree.setdefault(r["tree"], []).append(r)
    for t, g in growing.items():
        if t not in by_tree:  # nothing drawn
            g.open = np.zeros(0, np.int32)
            continue
        f, c, gain, value, n = (np.concatenate([r[k] for r in by_tree[t]]) for k in ("f", "c", "gain", "value", "n"))
        g.value[g.open] = value
        small = n <= LOCAL_CELLS
        split = (f >= 0) & ~small
        g.local = np.concatenate([g.local, g.open[small & (f >= 0)]])
        gains = np.zeros(len(s.bins))
        np.add.at(gains, f[split].astype(int), gain[split])
        g.gains = g.gains + gains
        nodes, k = g.open[split], int(split.sum())
        g.feature[nodes], g.cut[nodes] = f[split].astype(np.int8), c[split].astype(np.uint8)
        g.left[nodes] = len(g.feature) + 2 * np.arange(k, dtype=np.int32)
        g.open = np.arange(len(g.feature), len(g.feature) + 2 * k, dtype=np.int32)
        g.feature, g.left = (np.concatenate([a, np.full(2 * k, -1, a.dtype)]) for a in (g.feature, g.left))
        g.cut, g.value = (np.concatenate([a, np.zeros(2 * k, a.dtype)]) for a in (g.cut, g.value))


def _depths(g: _Growing) -> np.ndarray:
    depth = np.zeros(len(g.feature), np.int64)
    for node in np.flatnonzero(g.feature >= 0):  # children come after their parent
        depth[g.left[node] : g.left[node] + 2] = depth[node] + 1
    return depth


def _lower(cells: DataFrame, growing: dict[int, _Growing], s: Settings) -> None:
    """All that is below the local nodes of these trees."""
    context = cells.sparkSession.sparkContext
    share = context.broadcast({t: (g.shape(), g.local, s.depth - _depths(g)[g.local]) for t, g in growing.items() if len(g.local)})
    table, width = _poisson(s.rate) if s.rate is not None else None, len(s.bins)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _read(batches, s):
            for t, (shape, local, _) in share.value.items():
                w, y = chunk.draw(t, table)
                place = np.full(len(shape[0]), -1, np.int64)
                place[local] = np.arange(len(local))
                node = place[_descend(chunk.cells, *shape)]
                kept = np.flatnonzero((node >= 0) & (w > 0))
                kept = kept[np.argsort(node[kept], kind="stable")]
                which, first = np.unique(node[kept], return_index=True)
                parts = np.split(kept, first[1:]) if len(kept) else []
                columns = [pa.array([t] * len(which), pa.int32()), pa.array(which, pa.int32())]
                columns += [pa.array([a[p].tobytes() for p in parts], pa.binary()) for a in (chunk.cells, w, y)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "cells", "w", "y"])

    def grown(group: pa.Table) -> pa.Table:
        t, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        joined = [b"".join(group.column(c).to_pylist()) for c in ("cells", "w", "y")]
        tree = grow(np.frombuffer(joined[0], np.uint8).reshape(-1, width), np.frombuffer(joined[1]), np.frombuffer(joined[2]), int(share.value[t][2][node]), s)
        blobs = {n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("feature", "cut", "left", "value", "gains"), tree)}
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), **blobs})

    parts = cells.mapInArrow(sent, "tree int, node int, cells binary, w binary, y binary")
    nodes = sum(len(g.local) for g in growing.values())
    spread = parts.repartition(min(max(nodes, 1), 16 * context.defaultParallelism), "tree", "node")
    schema = "tree int, node int, feature binary, cut binary, left binary, value binary, gains binary"
    found = spread.groupBy("tree", "node").applyInArrow(grown, schema).collect()  # the trees, whose size their depth bounds
    share.unpersist()
    kinds = {"feature": np.int8, "cut": np.uint8, "left": np.int32, "value": np.float64}
    by_tree: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
        by_tree.setdefault(r["tree"], []).append(r)
    for t, rows in by_tree.items():
        g = growing[t]
        g.attach(g.local[[r["node"] for r in rows]], *[[np.frombuffer(r[n], kind) for r in rows] for n, kind in kinds.items()])
        g.gains = g.gains + sum(np.frombuffer(r["gains"]) for r in rows)


class Forest:
    """The mean of trees, each as arrays of its nodes."""

    def __init__(self, features: Sequence[str], edges: list[np.ndarray], trees: list[tuple[np.ndarray, ...]], importances: np.ndarray):
        self.features, self.edges, self.trees, self.featureImportances = list(features), edges, trees, importances
        self.places: list[np.ndarray] | None = None  # by feature the bin for each common bin of nested rows

    def transform(self, df: DataFrame, out: str = "_prediction") -> DataFrame:
        """`df` with the prediction; every cell is looked up once and joined to its rows."""
        return self.at_depths(df, [-1], out).withColumn(out, F.col(out)[0])

    def at_depths(self, df: DataFrame, depths: Sequence[int], out: str = "_prediction") -> DataFrame:
        """`df` with an array of what the trees predict if they end at each of `depths` (-1: at their leaves)."""
        coded = with_code(df, self.features, self.edges)
        return self._looked_up(coded, coded.select(CODE).distinct(), depths, out, None)

    def of_coded(self, rows: DataFrame, different: DataFrame, out: str = "_prediction") -> DataFrame:
        """`transform` of rows with the common bins, as `Nested.coded` gives them."""
        return self._looked_up(rows, different, [-1], out, self.places).withColumn(out, F.col(out)[0])

    def _looked_up(self, coded: DataFrame, different: DataFrame, depths: Sequence[int], out: str, places: list[np.ndarray] | None) -> DataFrame:
        share, width = coded.sparkSession.sparkContext.broadcast(self.trees), len(self.features)
        kind = np.uint8 if places is None or max(map(len, places)) <= 256 else np.uint16

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = _matrix(batch.column(0), width, kind)
                if places is not None:
                    cells = np.column_stack([place[cells[:, j]] for j, place in enumerate(places)])
                total = np.zeros((len(cells), len(depths)))
                for feature, cut, left, value in share.value:
                    for k, most in enumerate(depths):
                        total[:, k] += value[_descend(cells, feature, cut, left, most)]
                means = pa.array((total / len(share.value)).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), means], names=["_cell", out])

        spread = different.repartition(4 * coded.sparkSession.sparkContext.defaultParallelism)
        scored = durable(spread.mapInArrow(scores, f"_cell binary, {out} array<double>"))
        return coded.join(scored, F.col(CODE) == F.col("_cell")).drop(CODE, "_cell")


def fit(
    rows: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 16, rate: float | None = 0.5,
    min_rows: int = 50, bins: int = 64, seed: int = 42,
) -> Forest:
    """A forest of `trees` trees, each on Poisson draws of the rows with mean `rate` (None: all rows once)."""
    if not 2 <= bins <= 256:
        raise ValueError("bins are from 2 to 256")
    edges, n = cut_points(rows, features, bins)
    if not n:
        raise ValueError("no rows to fit")
    s = Settings(trees, depth, rate, min_rows, seed, [len(e) + 1 for e in edges])
    cells = chunks(rows, features, label, edges, n, seed)
    n_cells = cells.agg(F.sum(F.length("cells"))).first()[0] // len(features)
    return Forest(features, edges, *_grown(cells, n_cells, n, s))


def _grown(cells: DataFrame, n_cells: int, n: int, s: Settings) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """The trees on `cells`, which stand for `n` rows, and the importances of the features."""
    growing = {t: _Growing() for t in range(s.trees)}
    if n_cells <= LOCAL_CELLS:
        for g in growing.values():
            g.open, g.local = g.local, g.open
    width = 16 * (sum(s.bins) + 1)
    for level in range(s.depth + 1):
        going = {t: g for t, g in growing.items() if len(g.open)}
        while going:
            some, size = {}, 0
            while going and (not some or size + width * len(next(iter(going.values())).open) <= TASK_BYTES):
                t, g = next(iter(going.items()))
                some[t], size = going.pop(t), size + width * len(g.open)
            _upper_level(cells, some, s if level < s.depth else Settings(**{**s.__dict__, "min_rows": n + 1}))
    at_once = max(1, SENT_CELLS // max(1, n_cells))
    numbers = [t for t, g in growing.items() if len(g.local)]
    for k in range(0, len(numbers), at_once):
        _lower(cells, {t: growing[t] for t in numbers[k : k + at_once]}, s)
    each = [g.gains / g.gains.sum() for g in growing.values() if np.sum(g.gains) > 0]
    importances = sum(each) / len(each) if each else np.zeros(len(s.bins))
    return [(g.feature, g.cut, g.left, g.value) for g in growing.values()], importances


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bins."""
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):  # the mixing steps of splitmix64
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[:, j] + np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(27))
    return out


class Nested:
    """Rows of nested groups, binned and written once for the forests of all of them.

    `group` is the number of the smallest group that has the row, from 0 to `groups` - 1; the larger ones have it too. Rows of a
    cell meet in one bucket and are put in order there, so that the draws do not depend on the order of the rows; a cell of very
    many rows is spread over several buckets.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str], label: str, group: str, groups: int, bins: int = 64):
        if not 2 <= bins <= 256:
            raise ValueError("bins are from 2 to 256")
        self.features, self.groups = list(features), groups
        wide = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), F.col(group).cast("int").alias("_group"))
        self.edges, self.rows = self._cut_points(wide, bins)
        if not self.rows[0]:
            raise ValueError("no rows to fit")
        self.common = [np.unique(np.concatenate(each)) for each in zip(*self.edges)]
        self.chunks = self._chunks(wide)
        found = self.chunks.select(F.posexplode("sizes").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # a row per group
        self.cells = {r["k"]: r["n"] for r in found}

    def _cut_points(self, wide: DataFrame, bins: int) -> tuple[list[list[np.ndarray]], list[int]]:
        """`cut_points` of every group, from one pass."""
        width, groups = len(self.features), self.groups

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[np.ndarray | None] = [np.zeros(0)] * (width * groups)
            n = np.zeros(groups, np.int64)
            for batch in batches:
                group = batch.column(width + 1).to_numpy(zero_copy_only=False)
                x = _numbers(batch.columns[:width])
                for k in np.unique(group):
                    here = np.flatnonzero(group == k)
                    n[k] += len(here)
                    for j in range(width):
                        known = seen[j * groups + k]
                        if known is not None:
                            v = x[j][here]
                            new = v[known[np.minimum(known.searchsorted(v), len(known) - 1)] != v] if len(known) else v
                            both = np.union1d(known, new) if len(new) else known
                            seen[j * groups + k] = both if len(both) <= bins else None
            sets = pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(width * groups), pa.int32()), sets, pa.array(n.tolist() * width, pa.int64())], names=["k", "seen", "n"])

        seen: list[set | None] = [set() for _ in range(width * groups)]
        n = [0] * groups
        for r in wide.mapInArrow(values, "k int, seen array<double>, n long").collect():  # a row per task, feature and group
            k = r["k"]
            seen[k] = None if seen[k] is None or r["seen"] is None else seen[k] | set(r["seen"])
            if k < groups:
                n[k] += r["n"]
        edges = []
        for k in range(groups):
            parts = [[seen[j * groups + i] for i in range(k + 1)] for j in range(width)]
            whole = [None if None in part else set().union(*part) for part in parts]
            many = [j for j, s in enumerate(whole) if s is None or len(s) > bins]
            own = [np.zeros(0) if j in many else _between(s) for j, s in enumerate(whole)]
            names = [self.features[j] for j in many]
            cuts = wide.where(F.col("_group") <= k).approxQuantile(names, [q / bins for q in range(1, bins)], 0.001) if many else []
            for j, cut in zip(many, cuts):
                own[j] = np.array(sorted(set(cut)))
            edges.append(own)
        return edges, np.cumsum(n).tolist()

    def _chunks(self, wide: DataFrame) -> DataFrame:
        width, groups, common, kind = len(self.features), self.groups, self.common, _kind(self.common)
        buckets = max(2 * wide.sparkSession.sparkContext.defaultParallelism, -(-self.rows[-1] // FILE_ROWS))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def deal():
                codes, y, group = (np.concatenate(part) for part in zip(*held))
                mixed = _mixed(codes)
                order = np.argsort(mixed, kind="stable")
                mixed = mixed[order]
                first = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
                place = np.arange(len(mixed)) - np.repeat(first, np.diff(np.append(first, len(mixed))))
                bucket = ((mixed % np.uint64(buckets)).astype(np.int64) + place // max(1, MAP_ROWS // buckets)) % buckets
                by = np.argsort(bucket, kind="stable")
                which, start = np.unique(bucket[by], return_index=True)
                parts = np.split(order[by], start[1:])
                blobs = [pa.array([a.take(p, axis=0).tobytes() for p in parts], pa.binary()) for a in (codes, y, group)]
                return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *blobs], names=["bucket", "cells", "y", "group"])

            for batch in batches:
                y, group = _numbers([batch.column(width)])[0], batch.column(width + 1).to_numpy(zero_copy_only=False)
                held.append((_bins(batch.columns[:width], common), y, group.astype(np.int16)))
                size += len(batch)
                if size >= MAP_ROWS:
                    yield deal()
                    held, size = [], 0
            if size:
                yield deal()

        def packed(bucket: pa.Table) -> pa.Table:
            cells, y, group = (b"".join(bucket.column(c).to_pylist()) for c in ("cells", "y", "group"))
            cells, y, group = np.frombuffer(cells, kind).reshape(-1, width), np.frombuffer(y), np.frombuffer(group, np.int16)
            mixed = _mixed(cells)
            order = np.lexsort((y, group, mixed))
            rows = []
            for made, at in enumerate(range(0, len(order), CHUNK_ROWS)):
                part = order[at : at + CHUNK_ROWS]
                table = cells.take(part, axis=0)
                new = np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1)))
                place = (np.cumsum(new) - 1).astype(np.int32)
                by = np.argsort(group[part], kind="stable")
                ends = group[part][by].searchsorted(np.arange(groups), "right")
                place, labels = place[by], y[part][by]
                sizes = [int(np.count_nonzero(np.bincount(place[:e]))) for e in ends]
                rows.append(((bucket.column("bucket")[0].as_py() << 32) + made, table[new].tobytes(), place.tobytes(), labels.tobytes(), ends.tolist(), sizes))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ("chunk", "cells", "at", "y", "ends", "sizes")
            return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})

        parts = wide.mapInArrow(dealt, "bucket int, cells binary, y binary, group binary")
        return durable(parts.groupBy("bucket").applyInArrow(packed, "chunk long, cells binary, at binary, y binary, ends array<long>, sizes array<long>"))

    def _places(self, k: int) -> list[np.ndarray]:
        """By feature the bin of group k for each common bin."""
        return [np.concatenate(([0], own.searchsorted(all_, "right"))).astype(np.uint8) for own, all_ in zip(self.edges[k], self.common)]

    def fit(self, k: int, trees: int = 200, depth: int = 16, rate: float | None = 0.5, min_rows: int = 50, seed: int = 42) -> Forest:
        """The forest of group k, as `fit` would make it of the rows of that group."""
        s = Settings(trees, depth, rate, min_rows, seed, [len(e) + 1 for e in self.edges[k]], k, self._places(k))
        made = Forest(self.features, self.edges[k], *_grown(self.chunks, self.cells[k], self.rows[k], s))
        made.places = s.places
        return made

    def coded(self, df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """`columns` of `df` with the common bins of each row, and the different ones, both written once for all forests."""
        rows = durable(with_code(df, self.features, self.common).select(*columns, CODE))
        return rows, durable(rows.select(CODE).distinct())
