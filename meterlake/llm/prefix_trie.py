"""Conversations as a trie of shared beginnings: what every prefix of turns covers, and what storing it once saves.

Every conversation is one row: the hashes of its turns, 16 bytes each, joined to a path. Paths sort so that equal beginnings
lie together; ranges of the order are shards. A shard writes its trie as balanced parentheses in preorder. A tree of block
minima over their excess finds the closing parenthesis of every node, which delimits its subtree; the rank of "()" pairs
there counts leaves, and running sums over the preorder give members and savings. Nodes on a shard's first and last path,
its spines, may go on in the neighbours: each shard hands on what hangs off them, one or two rows per shard, and a trie of
all spines, by the same code, completes them. Hashes of the members that end at a node are taken in the shard, or for spines
from the shards' lists in order, as a stream.

Turns are ordered by number (null first), then role, then a hash of the text.

Defined results: null role or text is empty; rows without a conv_id belong to no conversation and are left out; repeated rows
are turns of their own; no rows give no nodes. Texts are read whole, whatever their length; of a long conversation the row
holds 20 bytes a turn. Extra columns are ignored. Turns count as equal if the 128-bit hashes of role and text are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterlake.llm.common import picked
from meterlake.session import durable

WIDTH = 16  # bytes of a turn's hash
FAR = np.iinfo(np.int64).max  # above every conv_id that is there


# --- tries -----------------------------------------------------------------------------------------------------------


def opening_and_closing(depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two parentheses of every node, for the depths of the nodes in preorder.

    After a node's parenthesis as many close as the next node is higher up, so its place is known from the depths; its
    closing one is where the excess first falls below its own, and is found through the minima of blocks of 1, 2, 4, ...
    """
    n = len(depths)
    opens = 2 * np.arange(n) - depths  # nodes before it have opened, and all but its ancestors have closed
    signs = np.full(2 * n + 1, -1, np.int32)
    signs[opens] = 1
    excess = np.cumsum(signs)  # falls to 0 with the last one, and below it at the guard
    minima, widths = [excess], len(excess)
    while widths > 1:
        last = minima[-1]
        last = np.append(last, last[-1]) if widths % 2 else last
        minima.append(last.reshape(-1, 2).min(axis=1))
        widths = len(minima[-1])
    starts = np.cumsum([0, *map(len, minima)])[:-1]
    flat = np.concatenate(minima)
    wanted, at, level = excess[opens] - 1, opens + 1, np.zeros(n, np.int64)
    open_still = np.arange(n)
    while len(open_still):
        a, k = at[open_still], level[open_still]
        beyond = flat[starts[k] + (a >> k)] > wanted[open_still]
        a = np.where(beyond, a + (1 << k), a)
        higher = beyond & ((a >> k) % 2 == 0) & (k + 1 < len(minima))
        at[open_still], level[open_still] = a, np.where(beyond, k + higher, np.maximum(k - 1, 0))
        open_still = open_still[beyond | (k > 0)]
    return opens, at


@dataclass
class Trie:
    """Nodes in preorder, the root first."""

    depths: np.ndarray
    parents: np.ndarray
    ends: list[list[int]]  # of every path, the node of each of its prefixes, the root first

    @classmethod
    def of(cls, paths: list[bytes]) -> Trie:
        """Of sorted paths; some may be equal."""
        depths, parents, spine, before, ends = [0], [-1], [0], b"", []
        for path in paths:
            n, shared = len(path) // WIDTH, 0
            most = min(n, len(before) // WIDTH)
            while shared < most and path[shared * WIDTH : (shared + 1) * WIDTH] == before[shared * WIDTH : (shared + 1) * WIDTH]:
                shared += 1
            del spine[shared + 1 :]
            for depth in range(shared + 1, n + 1):
                parents.append(spine[-1])
                spine.append(len(depths))
                depths.append(depth)
            ends.append(spine[:])
            before = path
        return cls(np.array(depths, np.int64), np.array(parents, np.int64), ends)


@dataclass
class Own:
    """What is known of each node apart from its descendants in the trie: members that end there or below what is already
    done, the least of them, leaves, children and savings that are already done."""

    members: np.ndarray
    least: np.ndarray
    leaves: np.ndarray
    children: np.ndarray
    saved: np.ndarray

    @classmethod
    def nothing(cls, n: int) -> Own:
        return cls(*(np.full(n, FAR if at == 1 else 0, np.int64) for at in range(5)))

    def columns(self) -> list[np.ndarray]:
        return [self.members, self.least, self.leaves, self.children, self.saved]

    def add(self, at: np.ndarray, other: list[np.ndarray]) -> None:
        members, least, leaves, children, saved = other
        for mine, more in ((self.members, members), (self.leaves, leaves), (self.children, children), (self.saved, saved)):
            np.add.at(mine, at, more)
        np.minimum.at(self.least, at, least)


def totals(trie: Trie, own: Own, words: np.ndarray) -> Own:
    """The same of the whole subtrees; children are those of the node itself."""
    opens, closes = opening_and_closing(trie.depths)
    first, last = np.arange(len(opens)), (closes + 1 - opens) // 2 + np.arange(len(opens))  # the subtree in preorder
    below = lambda of_node: (total := np.concatenate([[0], np.cumsum(of_node)]))[last] - total[first]
    children = own.children + np.bincount(trie.parents[1:], minlength=len(first))
    pairs = (closes == opens + 1) & (children == 0)
    members = below(own.members)
    least = own.least.copy()
    for node, parent in zip(range(len(first) - 1, 0, -1), trie.parents[:0:-1].tolist()):
        if least[node] < least[parent]:
            least[parent] = least[node]
    saved = below(own.saved + np.maximum(members - 1, 0) * words)
    return Own(members, least, below(own.leaves + pairs), children, saved)


# --- shards ----------------------------------------------------------------------------------------------------------

OWN = ("members", "least", "leaves", "children", "saved")
NODE = "kind string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
SHARD = NODE + (
    "ends_sha256 string, shard int, side int, up int, seq int, ids string, path binary, words array<int>, "
    + ", ".join(f"{c} array<long>" for c in OWN)
)
COMPLETE = NODE + "shard int, side int"
IDS = 10_000  # ids in one row of a spine's list


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _node(whole: Own, depths: np.ndarray, at: int) -> dict:
    return {
        "kind": "node", "conv_id": int(whole.least[at]), "depth": int(depths[at]), "n_convs": int(whole.members[at]),
        "n_children": int(whole.children[at]), "n_leaves": int(whole.leaves[at]), "saved_tokens": int(whole.saved[at]),
    }


def _shard_rows(number: int, paths: list[bytes], words: list[list[int]], members: list[list[int]]) -> Iterator[dict]:
    """What one shard knows: its inner nodes, its spines, and the lists of members that end on these."""
    trie = Trie.of(paths)
    n = len(trie.depths)
    own, counts, ending = Own.nothing(n), np.zeros(n, np.int64), [None] * n
    for ends, counted, ids in zip(trie.ends, words, members):
        counts[ends[1:]] = counted
        own.members[ends[-1]], own.least[ends[-1]] = len(ids), ids[0]
        ending[ends[-1]] = ids
    whole = totals(trie, own, counts)
    first, last = trie.ends[0], trie.ends[-1]
    side = np.full(n, -1)
    side[last], side[first] = 1, 0
    inner = np.flatnonzero(side < 0)
    hanging = inner[side[trie.parents[inner]] >= 0]  # inner nodes right below a spine
    own.add(trie.parents[hanging], [c[hanging] if at != 3 else np.ones(len(hanging), np.int64) for at, c in enumerate(whole.columns())])
    for at in inner.tolist():
        up = int(trie.parents[at])
        row = _node(whole, trie.depths, at) | {"ends_sha256": _sha256(_joined(ending[at] or []))}
        if side[up] < 0:
            yield row | {"parent_conv_id": int(whole.least[up])}
        else:
            yield row | {"shard": number, "side": int(side[up]), "up": int(trie.depths[up])}
    for which, (path, ends) in enumerate(((paths[0], first), (paths[-1], last))):
        mine = side[ends] == which
        if not mine.any():
            continue
        nothing = Own.nothing(len(ends)).columns()
        told = {c: np.where(mine, v[ends], no).tolist() for c, v, no in zip(OWN, own.columns(), nothing)}
        yield {"kind": "spine", "shard": number, "side": which, "path": path, "words": counts[ends].tolist(), **told}
        for at in np.array(ends)[mine].tolist():
            for seq, start in enumerate(range(0, len(ending[at] or []), IDS)):
                ids = _joined(ending[at][start : start + IDS])
                yield {"kind": "ends", "shard": number, "side": which, "depth": int(trie.depths[at]), "seq": seq, "ids": ids}


def _shard(schema: pa.Schema):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[bytes] = []
        words: list[list[int]] = []
        members: list[list[int]] = []
        for batch in batches:
            for path, counted, id in zip(batch.column("path").to_pylist(), batch.column("words"), batch.column("id").to_pylist()):
                if not paths or paths[-1] != path:
                    paths.append(path)
                    words.append(counted.as_py())
                    members.append([])
                members[-1].append(id)
        if paths:
            yield from _batches(_shard_rows(TaskContext.get().partitionId(), paths, words, members), schema)

    return shard


def _complete(schema: pa.Schema):
    """The trie of all spines, in order: final values of its nodes, and the name of every node that a shard may refer to."""

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            yield from _batches(finished(rows), schema)

    def finished(rows: list[dict]) -> Iterator[dict]:
        trie = Trie.of([r["path"] for r in rows])
        n = len(trie.depths)
        own, counts = Own.nothing(n), np.zeros(n, np.int64)
        for row, ends in zip(rows, trie.ends):
            counts[ends] = row["words"]
            own.add(np.array(ends), [np.array(row[c], np.int64) for c in OWN])
        whole = totals(trie, own, counts)
        for at in range(n):
            up = {"parent_conv_id": int(whole.least[trie.parents[at]])} if at else {}
            yield _node(whole, trie.depths, at) | up
        for row, ends in zip(rows, trie.ends):
            for depth, at in enumerate(ends):
                yield {"kind": "name", "shard": row["shard"], "side": row["side"], "depth": depth, "conv_id": int(whole.least[at])}

    return complete


def _hash_lists(schema: pa.Schema):
    """One hash for each (conv_id, depth), whose lists come one after another."""

    def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            key, state = None, hashlib.sha256()
            for batch in batches:
                for *here, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                    if here != key:
                        if key is not None:
                            yield {"conv_id": key[0], "depth": key[1], "ends_sha256": state.hexdigest()}
                        key, state = here, hashlib.sha256(ids.encode())
                    else:
                        state.update(b"," + ids.encode())
            if key is not None:
                yield {"conv_id": key[0], "depth": key[1], "ends_sha256": state.hexdigest()}

        return _batches(rows(), schema)

    return hash_lists


def _arrow(spark: SparkSession, fields: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], fields).schema)


# --- conversations ---------------------------------------------------------------------------------------------------


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: id, and turns, an array in order of (hash, words)."""
    rows = picked(turns, id=conv, turn=turn, role=role, text=text).where("id IS NOT NULL")
    said = F.concat(F.length("who").cast("string"), F.lit(":"), F.col("who"), F.col("what"))
    told = rows.select(
        F.col("id").cast("long").alias("id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("who"),
        F.coalesce("text", F.lit("")).alias("what"),
    ).select(
        "id",
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn"),
            "who",
            F.md5(said).alias("hash"),
            F.regexp_count("what", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("t"),
    )
    in_order = F.sort_array(F.collect_list("t"))
    return told.groupBy("id").agg(F.transform(in_order, lambda t: F.struct(t["hash"], t["words"])).alias("turns"))


def regrafted(rows: DataFrame, every: int = 20, starts: int = 4) -> DataFrame:
    """Conversations as branches of the first of each `every`: the first h turns are that one's (all if it has fewer, none
    if it isn't there), the others their own; h is the checksum of the id modulo `starts`."""
    heads = rows.where(F.col("id") % every == 0).select(F.col("id").alias("head"), F.slice("turns", 1, max(starts - 1, 1)).alias("first"))
    joined = rows.withColumn("head", F.col("id") - F.col("id") % every).join(heads, "head", "left")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % starts).cast("int")
    nothing = F.slice("turns", 1, 0)
    start = F.coalesce(F.slice("first", F.lit(1), h), nothing)
    return joined.select("id", F.concat(start, F.slice("turns", h + 1, F.size("turns") + 1)).alias("turns"))


def nodes(rows: DataFrame, shard: int = 20_000) -> DataFrame:
    """One row per distinct prefix of turns, the empty one included: conv_id (least member), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `rows` has id and turns, as `ordered` gives them, and an id once. A shard has about `shard` conversations, so that one task
    holds their paths; the trie of spines, in one task, has at most two paths per shard.
    """
    spark = rows.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), ""))
    stored = durable(rows.select("id", path.alias("path"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words")))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // shard))
    in_order = stored.repartitionByRange(shards, "path", "id").sortWithinPartitions("path", "id")
    found = durable(in_order.mapInArrow(_shard(_arrow(spark, SHARD)), SHARD))

    spines = found.where("kind = 'spine'").select("shard", "side", "path", "words", *OWN)
    in_one = spines.repartition(1).sortWithinPartitions("path", "shard", "side")
    completed = durable(in_one.mapInArrow(_complete(_arrow(spark, COMPLETE)), COMPLETE))
    names = completed.where("kind = 'name'").select("shard", "side", F.col("depth").alias("up"), F.col("conv_id").alias("name"))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.where("kind = 'node'")
    deep = inner.where("up IS NULL").select(*columns)
    below = inner.where("up IS NOT NULL").join(names, ["shard", "side", "up"]).withColumn("parent_conv_id", F.col("name"))

    lists = found.where("kind = 'ends'").select("shard", "side", F.col("depth").alias("up"), "seq", "ids")
    named = lists.join(names, ["shard", "side", "up"]).select(F.col("name").alias("conv_id"), F.col("up").alias("depth"), "shard", "seq", "ids")
    in_turn = named.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "shard", "seq")
    fields = "conv_id long, depth int, ends_sha256 string"
    hashed = durable(in_turn.mapInArrow(_hash_lists(_arrow(spark, fields)), fields))
    none = F.sha2(F.lit(""), 256)
    on_spines = completed.where("kind = 'node'").join(hashed, ["conv_id", "depth"], "left")
    on_spines = on_spines.withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    out = deep.unionByName(below.select(*columns)).unionByName(on_spines.select(*columns))
    return out.withColumn("depth", F.col("depth").cast("long"))


def prefix_trie(turns: DataFrame, every: int = 20, starts: int = 4, shard: int = 20_000, **columns: str) -> DataFrame:
    """`nodes` of the conversations of a table of turns, regrafted."""
    return nodes(regrafted(ordered(turns, **columns), every, starts), shard)
