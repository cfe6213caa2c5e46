"""Linear models on growing prefixes of time, all from one scan.

The moments of every block of time between two cuts are added up once. Sums of the blocks up to a cut are the moments of that
prefix, and sums of the blocks between the cuts of its folds are those of the folds, so that every prefix, fold, penalty and
model is solved without reading a row again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.metrics import scores_of_sums
from meterlake.functions.scalars import LOG_CEILING, seconds
from meterlake.operators.models import LINEAR, Regressor, Standardizer, moments
from meterlake.operators.quantiles import global_quantiles


def _cuts(at: DataFrame, shares: Sequence[float], at_least: int, splits: int) -> list[tuple[float, int, list[float]]]:
    """Of every prefix: its last time, its rows, and the times that cut it into splits + 1 folds of equal shares."""
    n = at.count()
    wanted = [min(n, max(at_least, int(n * s))) for s in shares]
    # halfway between the last row taken and the next one
    ends = global_quantiles(at, "_s", [1.0 if w == n else (w - 0.5) / (n - 1) for w in wanted]).first()["q"]
    sizes = at.agg(*[F.count_if(F.col("_s") <= e).alias(f"n{k}") for k, e in enumerate(ends)]).first()
    parts = [i / (splits + 1) * (rows - 1) / max(1, n - 1) for rows in sizes for i in range(1, splits + 1)]
    inner = global_quantiles(at, "_s", parts).first()["q"]  # a few numbers per share
    return [(e, rows, inner[k * splits : (k + 1) * splits]) for k, (e, rows) in enumerate(zip(ends, sizes))]


def _rescaled(blocks: list[np.ndarray], whole: Standardizer) -> tuple[list[np.ndarray], Standardizer]:
    """Moments of features scaled over all rows, scaled anew by the rows of these blocks; what is constant there goes."""
    total = sum(blocks)
    mean = total[0, 1:-1] / total[0, 0]
    spread = np.sqrt(np.maximum(np.diag(total)[1:-1] / total[0, 0] - mean * mean, 0.0))
    scaler = Standardizer(whole.least)
    for c, m, s in zip(whole.kept, mean, spread):
        centre, unit = whole.stats[c]
        scaler.stats[c] = (centre + unit * m, unit * s)
    scaler.kept = [c for c in whole.kept if scaler.stats[c][1] > whole.least]
    kept = [k for k, c in enumerate(whole.kept) if c in scaler.kept]
    turn = np.zeros((len(kept) + 2, len(total)))
    turn[0, 0] = turn[-1, -1] = 1.0
    for row, k in enumerate(kept, 1):
        turn[row, 0], turn[row, k + 1] = -mean[k] / spread[k], 1 / spread[k]
    return [turn @ m @ turn.T for m in blocks], scaler


def fit_prefixes(
    train: DataFrame, features: Sequence[str], models: dict[str, dict], shares: Sequence[float], label: str = "label",
    time: str = "timestamp", at_least: int = 1,
) -> list[tuple[float, int, Regressor]]:
    """(share, rows, fitted model) for every share and linear model, as if each were fitted on `chrono_prefix`."""
    at = train.select(seconds(time).alias("_s")).where("_s IS NOT NULL")
    whole = Standardizer().fit(train, features)
    made = {name: [LINEAR[name](**params) for _ in shares] for name, params in models.items()}
    out = []
    for splits in sorted({m[0].params.get("cv") or 3 for m in made.values()}):
        cuts = _cuts(at, shares, at_least, splits)
        ends = sorted({e for e, _, _ in cuts})
        starts = sorted({c for _, _, inner in cuts for c in inner})
        s = F.col("_s")
        block = sum([(s > e).cast("int") for e in ends] + [(s >= c).cast("int") for c in starts], F.lit(0))
        rows = whole.transform(train.withColumn("_s", seconds(time))).withColumn("_block", block)
        sums = moments(rows.select("_block", *whole.kept, F.col(label).alias("_label")), [*whole.kept, "_label"], "_block")
        for k, (end, n, inner) in enumerate(cuts):
            first = lambda t: sum(t > e for e in ends) + sum(t >= c for c in starts)  # noqa: E731  (the block of a time)
            firsts = [0, *map(first, inner), first(end) + 1]
            empty = np.zeros((len(whole.kept) + 2,) * 2)
            folds = [sum((sums[b] for b in range(a, z) if b in sums), empty) for a, z in zip(firsts, firsts[1:])]
            scaled, scaler = _rescaled(folds, whole)
            for name, fitted in made.items():
                if (fitted[k].params.get("cv") or 3) == splits:
                    fitted[k].features, fitted[k].scaler = list(features), scaler
                    fitted[k].model = fitted[k].solve(scaled)
                    out.append((shares[k], n, fitted[k]))
    return out


def predicted(model: Regressor) -> Column:
    """The prediction of a fitted line as an expression over its features."""
    total = F.lit(model.model.intercept)
    for c, w in zip(model.scaler.kept, model.model.coefficients):
        mean, spread = model.scaler.stats[c]
        total = total + F.lit(float(w / spread)) * (F.col(c) - F.lit(mean))
    return total


def scores(models: Sequence[Regressor], rows: DataFrame, label: str = "label", log_target: bool = True) -> DataFrame:
    """By the place `_k` of a model in `models`: rows `n` and the four errors, of all fitted lines in one pass. The predictions of
    a batch are one product of matrices. A null label or feature leaves the row out of the errors, as in `score_columns`."""
    columns = list(dict.fromkeys(c for m in models for c in m.scaler.kept))
    weights, means, reads = np.zeros((len(columns), len(models))), np.zeros((len(columns), len(models))), np.zeros((len(columns), len(models)))
    for k, m in enumerate(models):
        for c, w in zip(m.scaler.kept, m.model.coefficients):
            mean, spread = m.scaler.stats[c]
            weights[columns.index(c), k], means[columns.index(c), k], reads[columns.index(c), k] = w / spread, mean, 1.0
    starts = np.array([m.model.intercept for m in models]) - (weights * means).sum(axis=0)

    def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return column.fill_null(0.0).to_numpy(zero_copy_only=False), known

    def real(x: np.ndarray) -> np.ndarray:
        # Spark takes NaN for the largest number
        return np.expm1(np.where(np.isnan(x), LOG_CEILING, x.clip(0.0, LOG_CEILING))) if log_target else np.maximum(x, 0.0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((7, len(models)))
        for batch in batches:
            y, known = plain(batch.column(0))
            y = real(y)[:, None]
            x = [plain(c) for c in batch.columns[1:]]
            p = np.broadcast_to(starts, (len(y), len(models)))
            both = np.broadcast_to(known[:, None], p.shape)
            if x:
                p = real(np.column_stack([v for v, _ in x]) @ weights + starts)
                if not all(k.all() for _, k in x):
                    both = both & (np.column_stack([~k for _, k in x]) @ reads == 0)
            else:
                p = real(p)
            gap, log_gap = np.where(both, y - p, 0.0), np.where(both, np.log1p(p) - np.log1p(y), 0.0)
            parts = [(gap * gap).sum(axis=0), np.abs(gap).sum(axis=0), (log_gap * log_gap).sum(axis=0)]
            total += np.stack([np.full(len(models), len(y)), both.sum(axis=0), *parts[:2], np.full(len(models), known.sum()), np.full(len(models), y[known].sum()), parts[2]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), *map(pa.array, total)], names=["_k", *names])

    names = ["_n", "_known", "_squares", "_gaps", "_trues", "_true", "_log_squares"]
    read = rows.select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in columns])
    found = read.mapInArrow(sums, "_k int, " + ", ".join(f"{n} double" for n in names))  # a row per task and model
    return found.groupBy("_k").agg(F.sum("_n").cast("long").alias("n"), *scores_of_sums()).where("n > 0")
