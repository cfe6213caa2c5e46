"""Quality classifier by positive-unlabelled learning.

A small network minimises the non-negative unbiased risk: with trusted positives P, unlabelled text U and the class prior
p, the risk of the negatives is what U has in excess of p times the positives, and it is not let fall below zero. The prior
is the share of positives among the labelled rows that may be learned from. A last step fits slope and offset of the
score on the same labelled rows.

Only the text is an input. At most about `sample` labelled rows, chosen by a hash of their id, come to the driver as numbers.
The unlabelled text is every row that may be learned from: its numbers are written once, and each step of the fit (L-BFGS)
adds up the risk and its gradient over all of them, of which only sums come to the driver. Scores are computed for every
whole text.

Defined results: null texts count as empty; an empty text has a score like any other; a null id is held out; labels
without a value, or with different values for one id, are not used, and repeated equal labels count once; repeated rows
are scored one by one; of the rows that share a labelled id one is learned from as labelled; without any positive label every text gets the score 0.5; empty tables give no rows. An extra
column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meterlake.llm.common import picked
from meterlake.session import durable

FOLDS = 5
SAMPLE = 20_000
KEEP_FROM = 0.3  # score from which a text is taken as good
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
DIGITS = b"0123456789"
ENDS = b".,;:"
MARKS = b"!?"
SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
N_FEATURES = 128 + 16


def features(text: str | None) -> np.ndarray:
    """Shares of bytes, words that repeat, word and line shapes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:128] = counts[:128] / len(raw)
    share = lambda kept: counts[list(kept)].sum() / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    letters = counts[list(UPPER)].sum() + counts[list(LOWER)].sum()
    known = set(words)
    bare = {w.rstrip(ENDS + MARKS) for w in known}
    out[128:] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(raw) / n,
        share(UPPER),
        counts[list(UPPER)].sum() / max(1, letters),
        share(DIGITS),
        share(ENDS),
        share(MARKS),
        share(SYMBOLS),
        counts[128:].sum() / len(raw),
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        len(known) / n,
        len(bare) / n,
        1 - len(set(lines)) / len(lines),
    )
    return out


@dataclass
class Model:
    """Standardisation, one hidden layer, and the slope and offset of the score."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.hidden + self.bias) @ self.out + self.last

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def constant(score: float) -> Model:
    zero = np.zeros((N_FEATURES, 1), np.float32)
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), zero, np.zeros(1), np.zeros(1), float(np.log(score / (1 - score))))


def _split(w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The weights of the network from one vector."""
    n = N_FEATURES * width
    return w[:n].reshape(N_FEATURES, width), w[n : n + width], w[n + width : n + 2 * width], float(w[-1])


def risk(x: np.ndarray, w: np.ndarray, width: int, sign: int) -> np.ndarray:
    """Sum over standardised rows of softplus(sign * margin), followed by its gradient."""
    hidden, bias, out, last = _split(w, width)
    h = np.tanh(x @ hidden + bias)
    z = h @ out + last
    dz = sign * sigmoid(sign * z)
    dh = np.outer(dz, out) * (1 - h * h)
    return np.concatenate([[np.logaddexp(0, sign * z).sum()], (x.T @ dh).ravel(), dh.sum(0), h.T @ dz, [dz.sum()]])


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """The best weights found in so many evaluations; each step is halved until the value falls."""
    (f, g), moves = value(w), []
    step = np.zeros_like(w)
    for _ in range(steps):
        if not step.any():
            q, factors = g.copy(), []
            for s, y in reversed(moves):
                factors.append(s @ q / (s @ y))
                q -= factors[-1] * y
            q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(g))
            for (s, y), a in zip(moves, reversed(factors)):
                q += (a - y @ q / (s @ y)) * s
            if g @ q <= 0:
                q, moves = g / max(1.0, np.linalg.norm(g)), []
            step = -q
        after, slope = value(w + step)
        if after <= f + 1e-4 * (g @ step):
            if (slope - g) @ step > 1e-10:
                moves = [*moves[1 - memory :], (step, slope - g)]
            w, f, g, step = w + step, after, slope, np.zeros_like(w)
        else:
            step = step / 2
            if np.linalg.norm(step) < 1e-9:
                break
    return w


def fit(
    positive: np.ndarray, unlabelled: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]], mean: np.ndarray, scale: np.ndarray,
    prior: float, width: int = 24, steps: int = 40, seed: int = 7,
) -> Model:
    """Least non-negative risk. `unlabelled(w, mean, scale)` is the mean loss of all unlabelled rows as negatives, and its gradient.

    Where the risk of the negatives falls below zero it counts as zero, so that it is not followed any further down."""
    rng = np.random.default_rng(seed)
    p = np.clip((positive - mean) / scale, -8, 8)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        as_positive, as_negative = (risk(p, w, width, sign) / len(p) for sign in (-1, 1))
        loss, slope = unlabelled(w, mean, scale)
        below, down = loss - prior * as_negative[0], slope - prior * as_negative[1:]
        total, grad = prior * as_positive[0], prior * as_positive[1:]
        if below > 0:
            total, grad = total + below, grad + down
        return total + 5e-5 * (w @ w), grad + 1e-4 * w

    start = [rng.normal(0, 1 / np.sqrt(N_FEATURES), N_FEATURES * width), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width), np.zeros(1)]
    hidden, bias, out, last = _split(lbfgs(value, np.concatenate(start), steps), width)
    return Model(mean, scale, hidden, bias, out, last)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Slope and offset by Newton steps on the labelled rows; unchanged where only one class is known."""
    if len(set(y.tolist())) < 2:
        return model
    z = np.stack([model.margin(x), np.ones(len(x))], 1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        q = sigmoid(z @ w)
        step = np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), z.T @ (q - target) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
    if w[0] > 0:
        model.slope, model.offset = float(w[0]), float(w[1])
    return model


def held_out(id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; such rows are never learned from."""
    c = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(numbers, pa.binary())], names=["id", "label", "x"])


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """Rows, and the sum of `of` (additive over rows) over all of them; tasks send one row of sums each to be merged."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            if len(batch):
                n, total = n + len(batch), total + of(_numbers(batch.column("x")))
        if n:
            place = pa.array(np.arange(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([place, pa.array(np.full(len(total), n)), pa.array(total)], names=["place", "n", "v"])

    # decimals add up to the same in any order
    added = [F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(28,9)")).cast("double").alias("v")]
    found = rows.select("x").mapInArrow(add, "place int, n long, v double").groupBy("place").agg(*added)
    got = found.toArrow().sort_by("place")
    return (got.column("n")[0].as_py() if got.num_rows else 0), got.column("v").to_numpy()


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, width: int = 24) -> Model:
    """The model, learned from the rows of `docs` and `labels` that are not held out."""
    rows = picked(docs, id=id, text=text).where(~held_out("id"))
    marks = picked(labels, id=id, label=label).where(~held_out("id") & F.col("label").isin(0, 1))
    share = min(1.0, sample / max(1, marks.count()))
    marks = marks.where(F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)) < int(share * (1 << 32)))
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    marks = marks.where(F.col("label") == F.col("most")).select("id", F.col("label").cast("int"))
    # at most about `sample` marks: small enough to send to every executor
    marked = rows.join(F.broadcast(marks), "id", "left").select("id", "label", "text")
    every = durable(marked.mapInArrow(_featured, f"id {rows.schema['id'].dataType.simpleString()}, label int, x binary"))
    # one row per marked id, however often it repeats
    got = every.where(F.col("label").isNotNull()).groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("id").toArrow()
    y, x = got.column("label").to_numpy(), _numbers(got.column("x"))
    if not (y == 1).any():
        return constant(0.5)
    n, sums = _summed(every, lambda x: np.concatenate([x.sum(0), (x * x).sum(0)]))
    mean = sums[:N_FEATURES] / n
    scale = np.sqrt(np.maximum(0, sums[N_FEATURES:] / n - mean * mean)) + 1e-4

    def unlabelled(w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
        _, total = _summed(every, lambda x: risk(np.clip((x - mean) / scale, -8, 8), w, width, 1))
        return float(total[0] / n), total[1:] / n

    prior = float(np.clip((y == 1).mean(), 0.02, 0.98))
    return calibrate(fit(x[y == 1], unlabelled, mean, scale, prior, width), x, y)


def _scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(x))], names=["row", "score"])

    return score


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with all columns and the score of every whole text, 0 to 1, higher where label 1 is likelier."""
    kept = [c for c in docs.columns if c != score]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    scored = rows.mapInArrow(_scored(model), StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return scored.select("row.*", F.col("score").alias(score))
