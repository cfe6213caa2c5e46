"""Importance resampling towards a target: the documents most like a benchmark, drawn with Gumbel noise.

Every document is a bag of hashed word runs. One pass counts the buckets of all documents and of the target texts; their
smoothed log ratio is an array of `buckets` gains, and the mean gain of a document is its weight. Weight plus Gumbel noise
from a hash of the id is its score; the highest scores are a draw without replacement.

The cutoff is found by weighted medians, without a sort of all scores: every task tells the median of the keys it still
holds and their number, the weighted median of these medians splits the rest, and the part that cannot hold the cutoff
goes, at least about a quarter each time. When few enough are left, they are read, and the cutoff key is exact. Only the
winners are sorted.

Defined results: a null text counts as empty, has no features and weight 0; a null id hashes as the empty text and comes
last among equal scores; of rows with equal score and id any comes first, and all are returned. No rows give no rows. An
empty target leaves the prior counts, so that rare words weigh more. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.common import alphanumeric_words, numbered, picked
from meterlake.session import durable

KEY = ("down", "absent", "id", "part", "place")  # ascending: higher score, smaller id, place in the written table


def hashed_runs(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every run of 1 to `longest` words."""
    words = alphanumeric_words(text)
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """How many features of all texts fall into each bucket; a task adds up its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(hashed_runs(text.as_py(), longest, buckets)[1], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in found.collect():  # at most `buckets` rows
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log of how much likelier each bucket is in the target, each bucket counted once more."""
    buckets, source_total, target_total = len(source), sum(source), sum(target)

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log((t + 1.0) * (source_total + buckets) / ((s + 1.0) * (target_total + buckets))))

    return [gain(s, t) for s, t in zip(source, target)]


def noise(seed: int, name: str) -> int:
    """Thousandths of a Gumbel variate that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: list[int], longest: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, part, place = np.array(gain, np.int64), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for text, name in zip(batch.column("text"), batch.column("name")):
                n_words, features = hashed_runs(text.as_py(), longest, len(gain))
                weight = int(by_bucket[features].sum()) // len(features) if len(features) else 0
                rows.append((n_words, len(features), weight, weight + noise(seed, name.as_py())))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            places = np.arange(place, place + len(rows))
            place += len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, columns), pa.array([part] * len(rows), pa.int32()), pa.array(places)],
                names=["id", "n_words", "n_features", "weight", "score", "part", "place"],
            )

    return weigh


def weighted(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """One row per document, written: id, n_words, n_features, weight, score, and part and place, which tell rows apart.

    `docs` has id and text, `target` has text."""
    gain = gains(bucket_counts(docs.select("text"), longest, buckets), bucket_counts(target, longest, buckets))
    kind = docs.schema["id"].dataType.simpleString()
    named = docs.select("id", "text", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"))
    fields = f"id {kind}, n_words long, n_features long, weight long, score long, part int, place long"
    return durable(named.mapInArrow(_weigh(gain, longest, seed), fields))


def keyed(scored: DataFrame) -> DataFrame:
    """With the columns of KEY, which give all rows one order."""
    return scored.withColumn("down", -F.col("score")).withColumn("absent", F.col("id").isNull().cast("int"))


def up_to(key: tuple, kinds: T.StructType) -> Column:
    """Rows whose key is `key` or comes before it."""
    least = [F.lit(v).cast(kinds[c].dataType) for c, v in zip(KEY, key)]
    here = F.lit(True)
    for c, v in reversed(list(zip(KEY, least))):
        here = F.coalesce(F.col(c) < v, F.lit(False)) | (F.col(c).eqNullSafe(v) & here)
    return (F.col("down") <= least[0]) & here  # the first part reaches the scan


def _in_order(key: tuple) -> tuple:
    down, absent, id, part, place = key
    return (down, absent, *([] if id is None else [id]), part, place)


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        middle = pc.sort_indices(rows, [(c, "ascending") for c in KEY])[(rows.num_rows - 1) // 2].as_py()
        n = pa.array([rows.num_rows], pa.int64())
        yield pa.RecordBatch.from_arrays([n, *(rows[c].slice(middle, 1).combine_chunks() for c in KEY)], names=["n", *KEY])


def cutoff(keys: DataFrame, wanted: int, last: int = 10_000) -> tuple | None:
    """The key that comes at place `wanted` (from 1) of all rows of `keys`, which has the columns of KEY; None for 0.

    A round reads one row per task, the last one at most `last` rows. What is left is written anew whenever it has
    shrunk to a quarter, so that all rounds together read little more than the first.
    """
    if wanted < 1:
        return None
    rest, written = keys.select(*KEY), None
    kinds = rest.schema
    fields = "n long, " + ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in KEY)
    while True:
        told = rest.mapInArrow(_medians, fields).collect()
        total = sum(r["n"] for r in told)
        if not 1 <= wanted <= total:
            raise ValueError(f"place {wanted} of {total} rows")
        if total <= last:
            found = sorted((tuple(r) for r in rest.collect()), key=_in_order)
            return found[wanted - 1]
        if written is None or total * 4 <= written:
            rest, written = durable(rest), total
        middle, before = None, 0
        for row in sorted(told, key=lambda r: _in_order(tuple(r)[1:])):
            middle, before = tuple(row)[1:], before + row["n"]
            if 2 * before >= total:
                break
        ahead = rest.where(up_to(middle, kinds)).count()
        if wanted == ahead:
            return middle
        rest = rest.where(up_to(middle, kinds) if wanted < ahead else ~up_to(middle, kinds))
        wanted -= 0 if wanted < ahead else ahead


def ranked(rows: DataFrame) -> DataFrame:
    """With rank, 1 for the first by KEY."""
    return numbered(rows, [F.col(c) if c != "id" else F.col(c).asc_nulls_last() for c in KEY], "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = 10_000,
    longest: int = 1,
    seed: int = 2024,
    last: int = 10_000,
    id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per document: `id`, n_features, weight, score, rank.

    Of the documents with `least_words` words or more, `percent` of a hundred (rounded down) are drawn, those with the
    highest scores; rank counts them from 1, and is null for all others.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent is from 0 to 100")
    if min(buckets, longest, last) < 1:
        raise ValueError("buckets, longest and last are at least 1")
    scored = keyed(weighted(picked(docs, id=id, text=text), picked(target, text=target_text), buckets, longest, seed))
    able = F.col("n_words") >= least_words
    cut = cutoff(scored.where(able), scored.where(able).count() * percent // 100, last)
    drawn = F.lit(False) if cut is None else able & up_to(cut, scored.schema)
    columns = [F.col("id").alias(id), "n_features", "weight", "score", "rank"]
    others = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(drawn)).select(*columns).unionByName(others.select(*columns))
