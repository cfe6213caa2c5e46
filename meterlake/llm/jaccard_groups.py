"""N-gram Jaccard join by groups of similar documents (a token-group matrix).

Two documents are linked when the Jaccard similarity of their sets of word shingles reaches `percent`. The result is the
connected components of the links, without listing the pairs inside a group of copies.

1. Every text becomes its set of shingle hashes; equal sets are one node.
2. Nodes that cannot be linked go. With the tokens of all sets in one order, two linked sets share at least a known number
   of tokens in prefixes of known length. A node that has fewer tokens in its prefix that any other prefix has is out. For
   the rest the same is asked of whole sets: a node needs `percent` of its tokens in other sets to be the larger one of a
   linked pair, and more than that to be the smaller one. Copies of a template that differ too much from it have too many
   tokens of their own, and cannot be the smaller one of any pair.
3. Groups: of the nodes that share a token, the one with the smallest document id is the leader. Each node is compared with
   its leaders; those that are linked to a leader form its group. That is one comparison for a copy, however many there are.
4. Token-group matrix: the union of the rarest tokens of a group's members, by token and group. A node of another component
   that has one of them is a query for the group. The query is compared with the leader; this links it or bounds its
   similarity to all members.
5. Only groups that the bound lets through are opened. Members and queries are described by the tokens in which they differ
   from the leader. For a link they must share a known number of these, so pairs meet on such tokens only, and the exact
   similarity follows from their count.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle has one shingle of all its words; repeated rows are in one component; a null id is no candidate for the
smallest id of a component (which is null where all its ids are); empty tables give no rows; extra columns are ignored.
Nodes and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import picked, released
from meterlake.session import durable

SMALL = 1_000_000  # rows of a few long numbers that may be broadcast, by an exact count
CACHED = 500_000  # words whose hash a worker remembers
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; words are what ASCII white space parts, A-Z lower-cased."""
    if len(_HASHES) > CACHED:
        _HASHES.clear()
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.int64)
    each = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    out = np.full(len(parts) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * STEP + each[k : k + len(out)]
    return np.unique(_mixed(out))


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _ceil(a, b: int):
    return -(-a // b)


class Bounds:
    """What a link asks of the sizes of sets; for whole numbers here, as SQL text for columns."""

    def __init__(self, percent: int):
        self.percent = percent

    def larger(self, n: int) -> int:
        """Tokens that the larger set of a pair shares at least."""
        return _ceil(self.percent * n, 100)

    def slack(self, n: int) -> int:
        """Tokens that prefixes share at least. More of them make prefixes longer and the bound sharper."""
        return min(self.larger(n), 16 + n // 16)

    def prefix(self, n: int) -> int:
        return n - self.larger(n) + self.slack(n)

    def larger_sql(self, n: str = "n") -> str:
        return f"cast(ceil(({self.percent} * {n}) / 100) as int)"

    def smaller_sql(self, n: str = "n") -> str:
        """Tokens that the smaller set of a pair shares at least."""
        return f"cast(ceil(({2 * self.percent} * {n}) / {100 + self.percent}) as int)"

    def needed_sql(self, n: str = "n") -> str:
        """Prefix tokens of a set that the prefix of a linked set must have: what the smallest such set shares."""
        least = self.larger_sql(n)
        return f"least({self.larger_sql(least)}, 16 + cast(floor({least} / 16) as int))"

    def linked_sql(self, o: str, a: str, b: str) -> str:
        return f"(100 * {o} >= {self.percent} * ({a} + {b} - {o}))"

    def sizes_sql(self, a: str, b: str) -> str:
        return f"(100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b}))"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _prefixes(words: int, bounds: Bounds):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            cut = _lists([s[: bounds.prefix(len(s))] for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), nodes, sizes, cut], names=["id", "th", "node", "n", "prefix"]
            )

    return make


def _sets(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), nodes, sizes, _lists(sets)], names=["id", "node", "n", "tokens"])

    return make


def _compared(percent: int):
    """Overlap, and the tokens in only one of both sets where the similarity is not too low to matter."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            overlaps, differences = [], []
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                overlaps.append(shared)
                near = 100 * shared >= (2 * percent - 100) * (len(a) + len(b) - shared)
                differences.append(np.setxor1d(a, b, assume_unique=True) if near else a[:0])
            columns = [batch.column(c) for c in ("rank", "l", "r", "nl", "nr")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(overlaps, pa.int64()), _lists(differences)],
                names=["rank", "l", "r", "nl", "nr", "o", "diff"],
            )

    return compare


def _small(df: DataFrame, most: int) -> DataFrame:
    """A written table, marked for broadcast where its count allows that; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of the edges (l, r), by large-star and small-star
    steps. A node with many neighbours takes part by minima and joins, never as a list."""
    e = durable(edges.select(F.greatest("l", "r").alias("u"), F.least("l", "r").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(moved.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id: str, text: str, small: int):
        if words < 1 or not 50 < percent <= 100:
            raise ValueError("shingles have at least one word, and percent is above 50 and at most 100")
        self.words, self.bounds, self.small = words, Bounds(percent), small
        self.docs = picked(docs, id=id, text=text).withColumn("th", F.xxhash64("text"))
        self.kind = self.docs.schema["id"].dataType.simpleString()

    def signed(self) -> DataFrame:
        """A row per document: id, th, node, n, prefix."""
        schema = f"id {self.kind}, th long, node long, n long, prefix array<long>"
        return durable(self.docs.mapInArrow(_prefixes(self.words, self.bounds), schema))

    def candidates(self, rows: DataFrame, firsts: DataFrame) -> DataFrame:
        """One document of every node whose prefix has enough tokens of other prefixes: id, th."""
        copies = durable(firsts.where("copies > 1").select("node", "first"))
        marked = rows.where("n > 0").join(_small(copies, self.small), "node", "left")
        one = marked.where("first is null or id = first").select("id", "th", "node", "n", "prefix")
        tokens = one.select("node", F.explode("prefix").alias("token"))
        shared = released(tokens.groupBy("token").count().where("count > 1").select("token"))
        found = released(tokens.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("shared")))
        enough = one.select("id", "th", "node", "n").join(found, "node").where(f"shared >= {self.bounds.needed_sql()}")
        return durable(enough.select("id", "th"))

    def sets(self, chosen: DataFrame) -> DataFrame:
        """The whole sets of the chosen documents: id, node, n, tokens."""
        keys = _small(chosen.select(F.col("id").alias("key_id"), F.col("th").alias("key_th")), self.small)
        same = self.docs["id"].eqNullSafe(F.col("key_id")) & (self.docs["th"] == F.col("key_th"))
        texts = self.docs.join(keys, same, "left_semi").select("id", "text")
        return durable(texts.mapInArrow(_sets(self.words), f"id {self.kind}, node long, n long, tokens array<long>"))

    def rarest(self, sets: DataFrame) -> DataFrame:
        """The rarest tokens that other sets have too, as many as a linked set must have one of: token, id, node, n, and
        whether that holds for the smaller set of a pair (else only for the larger)."""
        tokens = sets.select("node", F.explode("tokens").alias("token"))
        often = released(tokens.groupBy("token").count().where("count > 1"))
        shared = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("shared"))
        rows = sets.select("id", "node", "n").join(released(shared), "node").withColumn("most", F.size("shared"))
        rows = rows.withColumn("as_larger", F.col("most") - F.expr(self.bounds.larger_sql()) + 1)
        rows = rows.withColumn("as_smaller", F.col("most") - F.expr(self.bounds.smaller_sql()) + 1).where("as_larger > 0")
        cut = rows.select("id", "node", "n", "as_smaller", F.posexplode(F.slice("shared", F.lit(1), F.col("as_larger"))).alias("place", "t"))
        return durable(cut.select("t.token", "id", "node", "n", (F.col("place") < F.col("as_smaller")).alias("smaller")).distinct())

    def compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """`pairs` has rank, l and r. Adds sizes, overlap and the differing tokens."""
        pairs = durable(pairs)
        wanted = durable(pairs.select(F.col("l").alias("node")).unionByName(pairs.select(F.col("r").alias("node"))).distinct())
        some = released(sets.join(_small(wanted, self.small), "node", "left_semi").dropDuplicates(["node"]))
        side = lambda c, n, tokens: some.select(F.col("node").alias(c), F.col("n").alias(n), F.col("tokens").alias(tokens))
        both = pairs.join(side("l", "nl", "left"), "l").join(side("r", "nr", "right"), "r")
        both = both.select("rank", "l", "r", "nl", "nr", "left", "right")
        kind = f"rank {pairs.schema['rank'].dataType.simpleString()}"
        return released(both.mapInArrow(_compared(self.bounds.percent), f"{kind}, l long, r long, nl long, nr long, o long, diff array<long>"))

    def links(self, compared: DataFrame) -> DataFrame:
        return compared.where(self.bounds.linked_sql("o", "nl", "nr"))

    def led(self, rarest: DataFrame, sets: DataFrame) -> DataFrame:
        """Every node compared with the leaders of its tokens."""
        leaders = rarest.groupBy("token").agg(F.min(F.struct("id", "node", "n")).alias("lead"), F.count(F.lit(1)).alias("c"))
        pairs = rarest.join(durable(leaders.where("c > 1")), "token").where("lead.node <> node")
        pairs = pairs.where(self.bounds.sizes_sql("lead.n", "n"))
        return self.compared(pairs.select(F.col("lead.id").alias("rank"), F.col("lead.node").alias("l"), F.col("node").alias("r")).distinct(), sets)

    def queried(self, rarest: DataFrame, led: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Groups (member, leader), the queries for groups of other components, compared with the leaders, and those of
        them that are new links."""
        first = self.links(led)
        homes = durable(first.groupBy(F.col("r").alias("node")).agg(F.min(F.struct("rank", "l"))["l"].alias("leader")))
        roots = durable(components(first.select("l", "r")))
        placed = rarest.join(homes, "node", "left").join(roots, "node", "left")
        placed = placed.select("token", "id", "node", "n", "smaller", F.coalesce("leader", "node").alias("leader"), F.coalesce("root", "node").alias("root"))
        placed = durable(placed)
        matrix = placed.where("smaller").groupBy("token", "leader", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        matrix = durable(matrix.withColumnRenamed("root", "group_root"))
        query = placed.select("token", "node", "n", "root")
        hits = matrix.join(query, "token").where(f"group_root <> root and low <= n and 100 * high >= {self.bounds.percent} * n")
        asked = durable(hits.select(F.col("leader").alias("l"), F.col("node").alias("r")).where("l <> r").distinct())
        known = led.drop("rank")
        known = known.unionByName(known.select(F.col("r").alias("l"), F.col("l").alias("r"), F.col("nr").alias("nl"), F.col("nl").alias("nr"), "o", "diff"))
        new = self.compared(asked.join(known.select("l", "r"), ["l", "r"], "left_anti").select(F.lit(0).alias("rank"), "l", "r"), sets)
        answered = asked.join(known.dropDuplicates(["l", "r"]), ["l", "r"]).unionByName(new.drop("rank"))
        return homes, durable(answered), self.links(new).select("l", "r")

    def opened(self, rarest: DataFrame, led: DataFrame, homes: DataFrame, answered: DataFrame) -> DataFrame:
        """Links between members of groups and queries that are not linked to the leader.

        With the differences D from the leader, two sets differ in |Da| + |Db| - 2 |Da and Db| tokens, and are linked
        when (100 + percent) times that is at most (100 - percent) times the sum of their sizes. `spare` is what a member
        could make up for at most, `lack` what a query needs.
        """
        p = self.bounds.percent
        strays = answered.where(f"not {self.bounds.linked_sql('o', 'nl', 'nr')}").where("size(diff) > 0")
        groups = durable(homes.select(F.col("leader").alias("l")).distinct())
        strays = strays.join(groups, "l", "left_semi").select("l", F.col("r").alias("b"), F.col("nr").alias("nb"), F.col("diff").alias("db"))
        strays = durable(strays.withColumn("lack", F.expr(f"{100 + p} * size(db) - {100 - p} * nb")))
        as_smaller = rarest.where("smaller").select("node").distinct()
        members = homes.join(as_smaller, "node", "left_semi").select(F.col("leader").alias("l"), F.col("node").alias("r"))
        members = members.join(strays.select("l").distinct(), "l", "left_semi")
        members = members.join(led.dropDuplicates(["l", "r"]), ["l", "r"]).select("l", F.col("r").alias("m"), F.col("nr").alias("nm"), F.col("diff").alias("dm"))
        members = durable(members)
        asked = durable(strays.select("l", F.explode("db").alias("token")).distinct())
        of_member = members.select("l", "m", F.explode("dm").alias("token"))
        common = durable(of_member.join(asked, ["l", "token"]).groupBy("l", "m").agg(F.count(F.lit(1)).alias("common")))
        spare = F.expr(f"{100 + p} * (2 * common - size(dm)) + {100 - p} * nm")
        able = members.join(common, ["l", "m"]).withColumn("spare", spare)
        least = durable(strays.groupBy("l").agg(F.min("lack").alias("least")))
        able = durable(able.join(least, "l").where("spare >= least").drop("least"))
        most = durable(able.groupBy("l").agg(F.max("spare").alias("most")))
        fit = strays.join(most, "l").where("lack <= most")
        met = able.select("l", "m", "nm", "spare", F.size("dm").alias("sm"), F.explode("dm").alias("token"))
        asking = fit.select("l", "b", "nb", "lack", F.size("db").alias("sb"), F.explode("db").alias("token"))
        pairs = durable(met).join(durable(asking), ["l", "token"]).where("lack <= spare and m <> b")
        counted = pairs.groupBy("l", "m", "b").agg(F.count(F.lit(1)).alias("c"), F.min("nm").alias("nm"), F.min("nb").alias("nb"), F.min("sm").alias("sm"), F.min("sb").alias("sb"))
        linked = counted.where(f"{100 + p} * (sm + sb - 2 * c) <= {100 - p} * (nm + nb)")
        return linked.select(F.col("m").alias("l"), F.col("b").alias("r"))


def link(
    docs: DataFrame, words: int = 4, percent: int = 85, id: str = "doc_id", text: str = "text", small: int = SMALL
) -> DataFrame:
    """A row per document: `id`, th (hash of the text), n_shingles, component_id (smallest id reachable by links)."""
    join = Join(docs, words, percent, id, text, small)
    rows = join.signed()
    firsts = durable(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    sets = join.sets(join.candidates(rows, firsts))
    rarest = join.rarest(sets)
    led = join.led(rarest, sets)
    homes, answered, new = join.queried(rarest, led, sets)
    edges = reduce(DataFrame.unionByName, [join.links(led).select("l", "r"), new, join.opened(rarest, led, homes, answered)])
    roots = durable(components(edges))
    least = durable(roots.join(firsts, "node").groupBy("root").agg(F.min("first").alias("least")))
    named = durable(roots.join(least, "root").select("node", "least"))
    known = durable(firsts.join(named, "node", "left").select("node", F.coalesce("least", "first").alias("component")))
    out = rows.select("id", "th", "node", "n").join(known, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), "th", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(
    docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", small: int = SMALL
) -> DataFrame:
    """`docs` with all columns, of each component only the rows with its smallest id."""
    found = link(docs, words, percent, id, text, small)
    gone = found.where(~F.col(id).eqNullSafe(F.col("component_id"))).select(F.col(id).alias("gone_id"), F.col("th").alias("gone_th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    same = rows["id"].eqNullSafe(F.col("gone_id")) & (rows["th"] == F.col("gone_th"))
    kept = rows.join(_small(durable(gone.distinct()), small), same, "left_anti")
    return kept.select("row.*")
