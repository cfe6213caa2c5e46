"""Best-fit packing with certificates: documents as token ids in as few sequences as can be had.

Documents longer than a sequence are cut into full sequences and a remainder, which comes first. What is shorter than a
sequence is an item. Items are numbered by size and dealt in turn into groups of a bounded number, so that each group has the
sizes of all; each is packed best-fit decreasing, and dual-feasible functions of the sizes bound its bins from below. A group that meets its bound is certified: none of its
bins can be saved within it. Bins that may still be saved go on, whole: all bins with room of a group with a gap, and the
emptiest bin of a certified one. They meet bins of other groups and are packed again, until a round saves nothing or all
that goes on is one group's. A group keeps the bins it has got if packing anew needs as many, so that no round makes things
worse.

Items travel as (part, place, size); the ids stay in the written table and are cut when all places are known. A sequence is
named after the place of its first token: the partition that encoded it, and the tokens before it there (below 2^40).

Defined results: a null text counts as empty and has only the end id; repeated rows are packed as often as they occur; rows
with a null id are packed as others; no rows give no pieces. Texts are read whole, whatever their length. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import numbered, picked
from meterlake.llm.packing import Encoder
from meterlake.session import durable

PLACED = "part int, place long, size long, bin long, offset long, certified boolean, goes_on boolean"


@cache
def dual_feasible(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Functions of sizes 0 to `length`, as whole numbers, and how much each may add up to in one bin.

    Whatever fits into a bin has function values of at most that sum, so that sums over all items bound the bins from
    below. Three families: small sizes are nothing and those that only fit with these fill the bin; sizes rounded down to
    k + 1 steps, exact steps kept; sizes in steps of e, what is above one half by what it leaves.
    """
    x = np.arange(length + 1, dtype=np.int64)
    rows, full = [x], [length]
    steps = sorted({e for e in range(1, length // 2 + 1) if e <= 64 or e % (1 + length // 128) == 0 or length // e != length // (e + 1)})
    for e in steps:
        rows.append(np.where(x > length - e, length, np.where(x < e, 0, x)))
        full.append(length)
    for k in range(1, min(length, 100)):
        whole = x * (k + 1) % length == 0
        rows.append(np.where(whole, x * k, x * (k + 1) // length * length))
        full.append(k * length)
    for e in steps:
        n = length // e
        rows.append(np.where(2 * x > length, 2 * (n - (length - x) // e), np.where(2 * x == length, n, 2 * (x // e))))
        full.append(2 * n)
    return np.stack(rows), np.array(full, np.int64)


def least_bins(sizes: np.ndarray, length: int) -> int:
    """No packing of these sizes has fewer bins."""
    values, full = dual_feasible(length)
    sums = values @ np.bincount(sizes, minlength=length + 1)
    return int((-(-sums // full)).max())


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of every item: from the largest on, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, n_bins = 0, 0  # bit r of rooms: there is a bin with room r
    order = np.argsort(-sizes, kind="stable")
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, n_bins = length, n_bins, n_bins + 1
        bins[at], offsets[at] = chosen, length - room
        if room > size:
            with_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins, offsets


def _pack_group(length: int, anew: bool):
    """Packs the items of a group. Where they come in bins (`anew`), these stay if nothing is saved."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.sort_values(["part", "place"], ignore_index=True)
        sizes = out["size"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(sizes, length)
        n_bins = int(bins.max()) + 1
        if not anew or n_bins < out["bin"].nunique():
            named = out["part"].to_numpy(np.int64) << 40 | out["place"].to_numpy(np.int64)
            first = np.empty(n_bins, np.int64)
            first[bins[offsets == 0]] = named[offsets == 0]
            out["bin"], out["offset"] = first[bins], offsets
        else:
            n_bins = out["bin"].nunique()
        room = length - out.groupby("bin")["size"].transform("sum")
        out["certified"] = n_bins == least_bins(sizes, length)
        out["goes_on"] = (room > 0) & (~out["certified"] | (out["bin"] == out["bin"][room.idxmax()]))
        return out[["part", "place", "size", "bin", "offset", "certified", "goes_on"]]

    return pack


def best_fit(items: DataFrame, length: int = 1024, group: int = 5_000, rounds: int = 4) -> DataFrame:
    """Every item with its bin, its offset there, and certified: whether the group that packed the bin last met its bound.

    `items` has part and place, which together tell items apart, and size, from 1 to `length`. A group has about `group`
    items; after the first packing, bins are exchanged at most `rounds` times.
    """
    rest, n_rest, n_bins, settled = items.select("part", "place", "size"), items.count(), None, []
    if n_rest > group:
        rest = numbered(rest, [F.col("size"), F.xxhash64("part", "place"), F.col("part"), F.col("place")], "at")
    for turn in range(rounds + 1):
        groups = max(1, -(-n_rest // group))
        at = F.lit(0) if groups == 1 else F.xxhash64(F.lit(turn), "bin") if turn else F.col("at")
        dealt = rest.withColumn("dealt", F.pmod(at, F.lit(groups)))
        packed = durable(dealt.groupBy("dealt").applyInPandas(_pack_group(length, anew=turn > 0), PLACED))
        told = packed.agg(
            F.count_if(F.col("offset") == 0).alias("bins"),
            F.count_if("goes_on").alias("rows"),
            F.count_if(F.col("goes_on") & (F.col("offset") == 0)).alias("bins_going"),
        ).first()
        if groups == 1 or turn == rounds or told["bins"] == n_bins:  # nothing to exchange, or nothing saved
            settled.append(packed)
            break
        settled.append(packed.where(~F.col("goes_on")))
        rest = packed.where("goes_on").select("part", "place", "size", "bin", "offset")
        n_rest, n_bins = told["rows"], told["bins_going"]
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("part", "place", "bin", "offset", "certified")


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _ENCODERS:  # one for all tasks of a worker
            _ENCODERS[path, end_id] = Encoder(path, end_id)
        encoder, part, total = _ENCODERS[path, end_id], TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encoder.one(t.as_py() or "") for t in batch.column("text")]
            counts = np.array([len(i) // encoder.unit.itemsize for i in ids], np.int64)
            places = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            parts = pa.array([part] * len(ids), pa.int32())
            columns = [batch.column("id"), parts, pa.array(places), pa.array(counts), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "place", "n", "ids"])

    return encode


def _cut(length: int):
    """The pieces of every document: the remainder at its place, and the full sequences after it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("at", "piece", "start", "length", "ids", "sequence_id", "offset", "certified")}
            columns = [batch.column(c).to_pylist() for c in ("part", "place", "n", "ids", "bin", "offset", "certified")]
            for at, (part, place, n, ids, bin, offset, certified) in enumerate(zip(*columns)):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                ends = [*([n % length] if n % length else []), *range(n % length + length, n + 1, length)]
                start = 0
                for piece, end in enumerate(ends):
                    told = (bin, offset, certified) if end - start < length else (part << 40 | place + start, 0, True)
                    for c, v in zip(rows, (at, piece, start, end - start, wide[start:end].tobytes(), *told)):
                        rows[c].append(v)
                    start = end
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            arrays = [pa.array(v, kind) for v, kind in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(arrays[0]), *arrays[1:]], names=["id", *list(rows)[1:]])

    return cut


def pack_best_fit(
    docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, group: int = 5_000, rounds: int = 4,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: `id`, piece (from 0), start (its document's ids before it), length, ids (little-endian unsigned
    32-bit), sequence_id, offset (ids before it in the sequence), certified (see `best_fit`; full sequences always are).

    `tokenizer` is the path of a byte-level tokenizer file that every worker can read.
    """
    if min(length, group) < 1 or rounds < 0:
        raise ValueError("length and group are at least 1, rounds at least 0")
    rows = picked(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    stored = durable(rows.mapInArrow(_encode(tokenizer, end_id), f"id {kind}, part int, place long, n long, ids binary"))
    items = stored.select("part", "place", (F.col("n") % length).alias("size")).where("size > 0")
    placed = stored.join(best_fit(items, length, group, rounds), ["part", "place"], "left")
    pieces = placed.mapInArrow(
        _cut(length),
        f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long, certified boolean",
    )
    return pieces.withColumnRenamed("id", id)
