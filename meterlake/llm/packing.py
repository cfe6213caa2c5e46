"""Packing: documents as one stream of token ids, cut into sequences of a fixed length.

Two passes. The first encodes each partition and writes the ids with their place in the partition. The totals of the
partitions, one row each, are summed up to the place of every partition in the whole stream. The second pass cuts each
document where a sequence ends. No token is shuffled, and the places come from the written table, so that a repeated task
gives the same pieces.

Defined results: a null text counts as empty and has only the end id; repeated rows are packed as often as they occur; no
rows give no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import picked
from meterlake.session import durable

# Fixed value: how byte-level tokenizers part a text before they merge.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BEYOND = re.compile("[^\x00-\u024f]")  # letters of other alphabets, whose classes may differ between versions of Unicode


def byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it can be printed, the others in
    order from 256 on."""
    printed = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts by a byte-level tokenizer file.

    The merges of the file go through a faster core where that gives the same ids: the tokenizer does nothing but part and
    merge, ids rise with the order of the merges, and the text has no added token and none but Latin letters. All else is
    encoded by the tokenizer itself.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.unit = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.unit).tobytes()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.added = [t["content"] for t in told["added_tokens"]]
        self.core = self._core(told)

    def _core(self, told: dict):
        import tiktoken

        model, parted = told["model"], told["pre_tokenizer"] or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = told["normalizer"] or told["truncation"] or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if model["type"] != "BPE" or odd or any(parted.get(k) != v for k, v in plain.items()):
            return None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(order, order[1:])):
            return None
        marks = byte_of_mark()
        ranks = {bytes(map(marks.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
        return tiktoken.Encoding("merges", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> bytes:
        """The ids of a text and the end id, as bytes."""
        if self.core is None or BEYOND.search(text) or any(map(text.__contains__, self.added)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.core.encode_ordinary(text)
        return np.array(ids, self.unit).tobytes() + self.end

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = encoder.batch([t or "" for t in batch.column("text").to_pylist()])
            counts = np.array([len(i) // encoder.unit.itemsize for i in ids], np.int64)
            places = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([part] * len(ids), pa.int32()), pa.array(places), pa.array(counts), pa.array(ids, pa.binary())],
                names=["id", "part", "place", "n", "ids"],
            )

    return encode


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:  # one for all tasks of a worker
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("at", "start", "length", "ids", "sequence_id", "offset")}
            places, counts = batch.column("place").to_numpy(), batch.column("n").to_numpy()
            for at, (place, n, ids) in enumerate(zip(places.tolist(), counts.tolist(), batch.column("ids").to_pylist())):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                done = 0
                while done < n:
                    offset = (place + done) % length
                    size = min(length - offset, n - done)
                    for c, v in zip(rows, (at, done, size, wide[done : done + size].tobytes(), (place + done) // length, offset)):
                        rows[c].append(v)
                    done += size
            at = pa.array(rows["at"], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(at),
                    pa.array(rows["start"], pa.int64()),
                    pa.array(rows["length"], pa.int64()),
                    pa.array(rows["ids"], pa.binary()),
                    batch.column("n").take(at),
                    pa.array(rows["sequence_id"], pa.int64()),
                    pa.array(rows["offset"], pa.int64()),
                ],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return cut


def pack(
    docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document in a sequence: `id`, start (its document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset (ids before it in the sequence).

    `tokenizer` is the path of a byte-level tokenizer file that every worker can read. Only the last sequence is shorter
    than `length`. The table of partition totals has one row per partition of the input.
    """
    if length < 1:
        raise ValueError("a sequence has at least one token")
    rows = picked(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    stored = durable(rows.mapInArrow(_encode(tokenizer, end_id), f"id {kind}, part int, place long, n long, ids binary"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    bases = durable(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = stored.join(bases, "part").select("id", (F.col("place") + F.col("base")).alias("place"), "n", "ids")
    pieces = placed.mapInArrow(
        _cut(length),
        f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("id", id)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids. A sequence has at most as many pieces as tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.expr("cast('' as binary)"), lambda done, p: F.concat(done, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
