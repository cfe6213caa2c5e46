"""K-means for several numbers of clusters at once.

Every iteration is one pass over the profiles that carries the centres of all k which still move: tasks add up members and
costs by (k, cluster), and a few rows per k come to the driver. All k start from the first k of one sequence of seeds, far from
each other. Where more clusters end up costing more than fewer, they start again from the fewer ones and the profile that is
farthest from them, so that the cost never rises with k.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Centres = dict[int, np.ndarray]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, from every row to every centre."""
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def lloyd_pass(profiles: DataFrame, columns: Sequence[str], centres: Centres) -> DataFrame:
    """One row per k and cluster with members: k, cluster, n, cost (squared distances of the members) and the sum of each
    column. A profile belongs to its nearest centre, the first among equals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(c), 2 + len(columns))) for k, c in centres.items()}
        for batch in batches:
            x = _matrix(batch)
            for k, c in centres.items():
                d = _distances(x, c)
                nearest = d.argmin(axis=1)
                np.add.at(total[k], nearest, np.column_stack([np.ones(len(x)), d.min(axis=1), x]))
        at = [(k, j) for k, t in total.items() for j in np.flatnonzero(t[:, 0])]
        sums = np.array([total[k][j] for k, j in at]).reshape(len(at), 2 + len(columns))
        keys = [pa.array([k for k, _ in at], pa.int32()), pa.array([int(j) for _, j in at], pa.int32())]
        yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums.T)], names=["k", "cluster", "n", "cost", *columns])

    fields = "k int, cluster int, n double, cost double, " + ", ".join(f"`{c}` double" for c in columns)
    found = profiles.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(add, fields)
    return found.groupBy("k", "cluster").agg(F.sum("n").cast("long").alias("n"), F.sum("cost").alias("cost"), *[F.sum(c).alias(c) for c in columns])


def _farthest(profiles: DataFrame, columns: Sequence[str], centres: np.ndarray) -> np.ndarray | None:
    """The profile farthest from its nearest centre; None where all lie on one."""
    gaps = [F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    rows = profiles.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    best = rows.agg(F.max(F.struct((F.array_min(F.array(*gaps))).alias("d"), "_x"))).first()[0]
    return None if best is None or best["d"] <= 1e-18 else np.array(best["_x"])


def seeds(profiles: DataFrame, columns: Sequence[str], most: int) -> np.ndarray:
    """Up to `most` profiles: the one farthest from the mean, then always the one farthest from those before."""
    mean = profiles.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    if mean[0] is None:
        raise ValueError("no profiles")
    found: list[np.ndarray] = []
    while len(found) < most:
        more = _farthest(profiles, columns, np.array(found) if found else np.array([mean]))
        if more is None:
            break
        found.append(more)
    return np.array(found).reshape(len(found), len(columns))


def settle(profiles: DataFrame, columns: Sequence[str], centres: Centres, max_iter: int = 300, tol: float = 1e-9) -> tuple[Centres, dict[int, float], dict[int, int]]:
    """Centres, costs and iterations of every k, once no centre moves by more than `tol`."""
    centres, cost, done, open_still = dict(centres), {}, {k: 0 for k in centres}, set(centres)
    while open_still:
        moved: dict[int, float] = {k: 0.0 for k in open_still}
        cost |= {k: 0.0 for k in open_still}
        after = {k: centres[k].copy() for k in open_still}
        for row in lloyd_pass(profiles, columns, {k: centres[k] for k in open_still}).collect():
            mean = np.array([row[c] for c in columns]) / row["n"]
            cost[row["k"]] += row["cost"]
            moved[row["k"]] = max(moved[row["k"]], float(np.abs(mean - centres[row["k"]][row["cluster"]]).max()))
            after[row["k"]][row["cluster"]] = mean
        for k in list(open_still):
            done[k] += 1
            if moved[k] <= tol or done[k] >= max_iter:
                open_still.discard(k)  # the cost is that of these centres
            else:
                centres[k] = after[k]
    return centres, cost, done


def fit_all(profiles: DataFrame, columns: Sequence[str], ks: Iterable[int], max_iter: int = 300) -> tuple[Centres, dict[int, float], dict[int, int]]:
    """Centres, cost and iterations for every k of `ks`; a k beyond the distinct profiles has a centre for each of these."""
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("a number of clusters is at least 1")
    cached = profiles.select(*columns).persist()
    try:
        first = seeds(cached, columns, max(2, ks[-1]))
        if len(first) < 2:
            raise ValueError("clustering needs at least two distinct profiles")
        centres, cost, n_iter = settle(cached, columns, {k: first[:k] for k in ks}, max_iter)
        for before, k in zip(ks, ks[1:]):
            if cost[k] > cost[before]:
                again = centres[before]
                while len(again) < k and (more := _farthest(cached, columns, again)) is not None:
                    again = np.vstack([again, more])
                fixed = settle(cached, columns, {k: again}, max_iter)
                centres[k], cost[k], n_iter[k] = fixed[0][k], fixed[1][k], n_iter[k] + fixed[2][k]
    finally:
        cached.unpersist()
    return centres, cost, n_iter
