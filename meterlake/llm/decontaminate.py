"""Benchmark decontamination: a broadcast set of test n-grams, a scan of the training windows, exact verification,
removal of spans or documents.

A benchmark item of at least `n` words has one window per run of `n` words, a shorter one a single window of all its
words. A document word is hit if it lies in an occurrence of any window.

Defined results: a null text has no words and no hits; a benchmark row without words (null, empty, punctuation) has no
windows; a null item id can hit words but is not listed; repeated benchmark rows count once per item id; repeated
documents give one row each; empty tables give no rows or no hits. Extra columns are ignored by `scan` and kept by
`remove`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import alphanumeric_words, picked
from meterlake.session import durable

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


class WindowSet:
    """The windows of some benchmark items: word numbers, hashes to look up, and exact windows to verify with."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, set[str | None]] = {}
        for item, text in items:
            words = alphanumeric_words(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                self.windows.setdefault(ids[at : at + size].tobytes(), set()).add(item)
        self.hashes: dict[int, np.ndarray] = {}
        for size in {len(w) // 4 for w in self.windows}:
            same = np.frombuffer(b"".join(w for w in self.windows if len(w) == 4 * size), np.uint32).reshape(-1, size)
            self.hashes[size] = np.unique(rolled(same[:, k] for k in range(size)))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint32, len(words))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str | None]]]:
        """First word, number of words and items of every window that occurs; number 0 matches nothing."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size]) if len(ids) >= size else ()
            if not len(at):
                continue
            seen = rolled(ids[at + k] for k in range(size))
            near = np.searchsorted(hashes, seen)
            for i in at[hashes[np.minimum(near, len(hashes) - 1)] == seen]:
                if items := self.windows.get(ids[i : i + size].tobytes()):  # the hash may collide, the window not
                    yield int(i), size, items


def rolled(columns: Iterator[np.ndarray]) -> np.ndarray:
    total = None
    for c in columns:
        total = c.astype(np.uint64) if total is None else total * BASE + c
    return total


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _pass(shared):
    """Adds what one window set finds to what earlier passes found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = shared.value
        for batch in batches:
            words = [alphanumeric_words(t) for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])  # a number 0 between documents
            ids = np.zeros(starts[-1], np.uint32)
            for at, w in zip(starts, words):
                ids[at : at + len(w)] = windows.numbers(w)
            runs = [[(r["first"], r["last"]) for r in old] for old in batch.column("runs").to_pylist()]
            items = [set(old) for old in batch.column("items").to_pylist()]
            for at, size, found in windows.occurrences(ids):
                doc = int(np.searchsorted(starts, at, "right")) - 1
                runs[doc].append((at - int(starts[doc]), at - int(starts[doc]) + size))
                items[doc].update(i for i in found if i is not None)
            columns = {
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "runs": pa.array([[{"first": a, "last": b} for a, b in merged(r)] for r in runs], RUN),
                "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(
                [columns.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names
            )

    return scan


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, item: str, item_text: str, block_bytes: int) -> DataFrame:
    """`docs` (with a column `text`) with n_words, runs and items; the benchmark goes block by block."""
    if n < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    items = picked(benchmark, item=item, text=item_text).select(F.col("item").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.select(
        *docs.columns,
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("runs"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in part.distinct().collect()], n))
        out = out.mapInArrow(_pass(shared), out.schema)
        if block < blocks - 1:  # written, so that the next block's windows take the place of this one's
            out = durable(out)
            shared.destroy()
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """What each document shares with the benchmark: `id`, n_words, runs (merged hit words, last exclusive), items.

    The window set that is broadcast holds at most `block_bytes` of benchmark text (or one row); a larger benchmark is
    cut into such blocks, one at a time: what a block finds is written before the next one is built. No shuffle.
    """
    found = _scanned(picked(docs, **{"id": id, "text": text}), benchmark, n, item, item_text, block_bytes)
    return found.select(F.col("id").alias(id), "n_words", "runs", "items")


def without_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of `runs` and what stands between them."""
    words, at, out = [m.span() for m in WORD.finditer(text)], 0, []
    for first, last in runs:
        out.append(text[at : words[first][0]])
        at = words[last - 1][1]
    return "".join([*out, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, runs = batch.column("text").to_pylist(), batch.column("runs").to_pylist()
        cut = [without_runs(t, [(r["first"], r["last"]) for r in rs]) if rs else t for t, rs in zip(texts, runs)]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(cut, pa.string()))


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "spans",
    n: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """`docs` with all its columns, without contaminated documents (`mode="documents"`) or without the hit words
    (`mode="spans"`; documents of which no word is left go too, those without words before stay)."""
    if mode not in ("spans", "documents"):
        raise ValueError("mode is 'spans' or 'documents'")
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}  # no clash with the operator's own names
    renamed = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    found = _scanned(renamed, benchmark, n, item, item_text, block_bytes)
    if mode == "documents":
        found = found.where(F.size("runs") == 0)
    else:
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + (r["last"] - r["first"]))
        found = found.where((F.size("runs") == 0) | (hit < F.col("n_words")))
        found = found.mapInArrow(_cut, found.schema)
    return found.select(*[F.col("text" if c == text else inner[c]).alias(c) for c in docs.columns])
