"""Line dedup by a deletion-neighbourhood join.

Lines are compared lower-cased and trimmed. Two lines are near when their edit distance is at most 1 and both have at
least `near_from` characters; a line goes if an earlier line is equal or near, where lines are ordered by document id, text
and place. Built-in functions only.

Candidates. An edit leaves what stands before and after it unchanged. So every line emits, as hashed keys, its variants
with a middle part deleted: a prefix and a suffix of whole blocks, the blocks a power of two between a quarter and a half
of the line. Lines at distance 1 or less share such a variant, in whichever block the edit falls, and a line has about
four. Keys that only one line has are counted away before anything is joined.

Of a key that few lines share, the lines are paired and their edit distance is verified. A key that many lines share is not
paired: prefix and suffix being equal, only the deleted middles matter, and these go through the same step again, shorter
each time. Once they have at most `base` characters, single characters are deleted. Then all lines of a key are within
distance 1 of each other, and the earliest of the key is compared with the others by a minimum, without pairs. So nothing
grows with the square of a hot key.

Defined results: a null text has no lines and stays null; blank lines are no lines for this purpose and stay; repeated
rows (same id and text) are one document and get the same result each; a null id comes first; rows with one id and different
texts are ordered by a hash of the text; empty tables give no rows. Extra columns are kept by `dedup`; those with the names
of its result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import durable

NEAR_FROM = 20
PAIRED = 32  # lines of a key that are paired
BASE = 8  # characters of a middle that single deletions take apart
SMALL = 200_000  # handles of lines that may be broadcast (8 bytes each), by an exact count


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.replace(line, F.lit("\r"), F.lit(""))))


def lines_of(docs: DataFrame) -> DataFrame:
    """`docs` has id, th (text hash) and text. One row per line that isn't blank: id, th, place, line (normalised)."""
    cut = docs.select("id", "th", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "raw"))
    return cut.select("id", "th", "place", normal(F.col("raw")).alias("line")).where("line <> ''")


def _block(m: Column, blocks: int) -> Column:
    """The block length of strings of m characters: a power of two of which m has `blocks` to twice as many, or 1."""
    return F.when(m < 2 * blocks, 1).otherwise(F.call_function("shiftleft", F.lit(1), F.floor(F.log2(m.cast("double"))).cast("int") - (blocks.bit_length() - 1)))


def _suffix(m: Column, i: Column | int, s: Column) -> Column:
    """Blocks of the suffix that an edit after i blocks leaves unchanged for certain."""
    return F.greatest(F.floor((m - i * s) / s).cast("int") - 1, F.lit(0))


def variants(line: Column, blocks: int = 2) -> Column:
    """key, before and after: the hashed variants of a string with a middle part deleted, and what they leave of it.

    Two strings at distance 1 have a length m of the shorter one in common: each string is the shorter (or equal) one for
    its own length, and the longer one for a character less. With blocks of s characters and i of them before the edit,
    m - i s - s characters or more after the edit are unchanged.
    """
    n = F.length(line)

    def of_shorter(m: Column) -> Column:
        s = _block(m, blocks)

        def of_prefix(i: Column) -> Column:
            before, j = (i * s).cast("int"), _suffix(m, i, s)
            after = (j * s).cast("int")
            hashed = F.xxhash64(s, i.cast("int"), j, F.xxhash64(F.left(line, before)), F.xxhash64(F.right(line, after)))
            return F.struct(hashed.alias("key"), before.alias("before"), after.alias("after"))

        return F.transform(F.sequence(F.lit(0), F.floor(m / s).cast("int")), of_prefix)

    return F.array_distinct(F.flatten(F.transform(F.array(n, F.greatest(n - 1, F.lit(0))), of_shorter)))


def singles(line: Column) -> Column:
    """The variants with one character or none deleted, by place. All strings of one such key are within distance 1."""
    n = F.length(line)

    def of_prefix(i: Column) -> Column:
        rest = F.array(F.lit(0), F.when(i < n, 1))
        return F.transform(F.filter(rest, lambda d: d.isNotNull()), lambda d: F.xxhash64(i, n - i - d, F.left(line, i), F.lit(0), F.right(line, n - i - d)))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), of_prefix))


def with_keys(lines: DataFrame, near_from: int) -> DataFrame:
    """`lines` with keys, those of `variants`, null for short lines. Written out, since a line has at most four prefixes and
    three suffixes of two to four blocks; lines whose length is a power of two have two block lengths."""
    n = F.col("n")
    out = lines.withColumn("n", F.length("line")).withColumn("s", _block(n, 2))
    part = {f"p{i}": F.xxhash64(F.left("line", (i * F.col("s")).cast("int"))) for i in range(4)}
    part |= {f"q{j}": F.xxhash64(F.right("line", (j * F.col("s")).cast("int"))) for j in range(3)}
    out = out.withColumns({c: F.when(n >= near_from, hashed) for c, hashed in part.items()})
    s = F.col("s")

    def key(m: Column, i: int) -> Column:
        j = _suffix(m, i, s)
        after = F.when(j == 0, F.col("q0")).when(j == 1, F.col("q1")).otherwise(F.col("q2"))
        return F.when(i <= F.floor(m / s), F.xxhash64(s, F.lit(i), j, F.col(f"p{i}"), after))

    own = [key(n, i) for i in range(4)]
    longer = [F.when(n % s == 0, key(n - 1, i)) for i in range(4)]  # else the same as its own
    same = F.array_distinct(F.array_compact(F.array(*own, *longer)))
    power = n.bitwiseAND(n - 1) == 0
    general = F.transform(variants(F.col("line")), lambda v: v["key"])
    return out.withColumn("keys", F.when((n >= near_from) & power, general).when(n >= near_from, same))


def _distinct(lines: DataFrame, near_from: int) -> DataFrame:
    """One row per distinct line: h1, h2 (128 bits of hash), first (its earliest place), keys (null for short lines)."""
    rows = with_keys(lines, near_from).select(
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        F.struct("id", "th", "place").alias("first"),
        "keys",
    )
    return rows.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.any_value("keys").alias("keys"))


def _members(keyed: DataFrame) -> DataFrame:
    """The rows of keys that several lines have, with the number of lines of the key."""
    shared = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return keyed.join(shared, "key")


def _later_of_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The later line of every pair within the bound."""
    side = lambda x: members.select("key", F.struct("h1", "h2").alias(x))
    pairs = side("a").join(side("b"), "key").where("a.h1 < b.h1 or (a.h1 = b.h1 and a.h2 < b.h2)").select("a", "b").distinct()
    text = lambda x: texts.select(F.struct("h1", "h2").alias(x), F.col("first").alias(f"{x}_first"), F.col("line").alias(f"{x}_line"))
    both = pairs.join(text("a"), "a").join(text("b"), "b")
    near = both.where(F.levenshtein("a_line", "b_line", 1) >= 0)
    return near.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("line")).select("line.*")


def _near(distinct: DataFrame, lines: DataFrame, near_from: int, paired: int, base: int, small: int) -> DataFrame | None:
    """h1, h2 of the distinct lines that an earlier line is near to; None where no two lines share a variant."""
    exploded = distinct.where("keys is not null").select("h1", "h2", F.explode("keys").alias("key"))
    members = durable(_members(exploded.select("key", "h1", "h2")))
    handles = durable(members.select("h1").distinct())
    count = handles.count()
    if not count:
        return None
    wanted = F.broadcast(handles) if count <= small else handles
    some = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}).join(wanted, "h1", "left_semi")
    texts = durable(some.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "place")).alias("first"), F.any_value("line").alias("line")))
    found = [_later_of_pairs(members.where(F.col("n") <= paired), texts)]
    hot = members.where(F.col("n") > paired).select("key", "h1", "h2")
    # the middles that the variants of hot keys have deleted
    cut = texts.select("h1", "h2", "first", "line", F.explode(variants(F.col("line"))).alias("v")).select("h1", "h2", "first", "line", "v.*")
    hot = durable(_middles(cut.join(hot, ["key", "h1", "h2"])))
    while longest := hot.agg(F.max(F.length("middle") + 1)).first()[0]:
        if longest <= base + 1:
            cut = hot.select("group", "h1", "h2", "first", F.explode(singles(F.col("middle"))).alias("key"))
            cut = cut.select(F.xxhash64("group", "key").alias("key"), "h1", "h2", "first")
            first = durable(cut.groupBy("key").agg(F.min("first").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1"))
            found.append(cut.join(first, "key").where("earliest < first").select("h1", "h2"))
            break
        cut = hot.select("group", "h1", "h2", "first", F.col("middle").alias("line"), F.explode(variants(F.col("middle"), 4)).alias("v"))
        cut = cut.select(F.xxhash64("group", "v.key").alias("key"), "h1", "h2", "first", "line", "v.before", "v.after")
        cut = durable(_members(cut.dropDuplicates(["key", "h1", "h2"])))
        found.append(_later_of_pairs(cut.where(F.col("n") <= paired), texts))
        hot = durable(_middles(cut.where(F.col("n") > paired)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _middles(rows: DataFrame) -> DataFrame:
    middle = F.substring("line", F.col("before") + 1, F.length("line") - F.col("before") - F.col("after"))
    return rows.select(F.col("key").alias("group"), "h1", "h2", "first", middle.alias("middle"))


def dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    near_from: int = NEAR_FROM,
    paired: int = PAIRED,
    base: int = BASE,
    small: int = SMALL,
) -> DataFrame:
    """`docs` with all columns, the text without repeated lines, n_lines (not blank) and n_kept."""
    result = (text, "n_lines", "n_kept")
    others = [c for c in docs.columns if c not in result]
    source, known = F.col(f"`{text}`"), F.col(f"`{id}`")
    lines = lines_of(docs.select(known.alias("id"), F.xxhash64(source).alias("th"), source.alias("text")))
    distinct = durable(_distinct(lines, near_from))
    near = _near(distinct, lines, near_from, paired, base, small)
    firsts = distinct.select("h1", "h2", "first")
    if near is not None:
        firsts = firsts.join(durable(near), ["h1", "h2"], "left_anti")
    kept = firsts.groupBy(F.col("first.id").alias("kept_id"), F.col("first.th").alias("kept_th")).agg(
        F.collect_list("first.place").alias("places")
    )
    # cut before the join: later it would be cut anew for every line
    rows = docs.select(
        F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`") for c in others]).alias("row"),
        known.alias("id"),
        F.xxhash64(source).alias("th"),
        F.split(source, "\n").alias("cut"),
    )
    full = rows.join(kept, rows["id"].eqNullSafe(F.col("kept_id")) & (rows["th"] == F.col("kept_th")), "left")
    every = F.sequence(F.lit(0), F.size("cut") - 1)
    full = full.withColumn("filled", F.filter(every, lambda i: F.trim(F.replace(F.get("cut", i), F.lit("\r"), F.lit(""))) != ""))
    gone = F.array_except("filled", F.coalesce("places", F.expr("cast(array() as array<int>)")))
    values = {
        text: F.array_join(F.transform(F.array_except(every, gone), lambda i: F.get("cut", i)), "\n"),
        "n_lines": F.coalesce(F.size("filled"), F.lit(0)).cast("long"),
        "n_kept": F.coalesce(F.size("places"), F.lit(0)).cast("long"),
    }
    out = full.select(*[F.col("row").getField(c).alias(c) for c in others], *[values[c].alias(c) for c in result])
    return out.select(*[c for c in docs.columns if c in others or c == text], "n_lines", "n_kept")


# Distance at most 1 in SQL: both agree before and after one place. `{a}` is not longer than `{b}`.
NEAR_SQL = """(length({b}) - length({a}) <= 1 AND len(list_filter(range(0, length({a}) + 1), lambda i:
    left({a}, i) = left({b}, i) AND (CASE WHEN length({a}) = length({b}) THEN substr({a}, i + 2) ELSE substr({a}, i + 1) END)
    = substr({b}, i + 2))) > 0)"""


def dedup_sql(near_from: int = NEAR_FROM) -> str:
    """The result for `documents` in the SQL of an independent engine, with doc_id, n_lines, n_kept and the digest of the
    text. Candidates agree in the first or the second half of the shorter line."""
    norm = "lower(trim(replace({}, chr(13), '')))"
    return f"""
WITH cut AS MATERIALIZED (SELECT doc_id, unnest(parts) AS raw, unnest(range(0, len(parts))) AS place
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
lines AS MATERIALIZED (SELECT doc_id, place, {norm.format("raw")} AS line FROM cut),
firsts AS MATERIALIZED (SELECT line, min((doc_id, place)) AS first FROM lines WHERE line <> '' GROUP BY line),
long AS MATERIALIZED (SELECT line, first, length(line) AS n FROM firsts WHERE length(line) >= {near_from}),
halves AS MATERIALIZED (
    SELECT line, first, m, 0 AS side, left(line, m // 2) AS half FROM (SELECT *, unnest([n, n - 1]) AS m FROM long)
    UNION ALL SELECT line, first, m, 1, right(line, m - m // 2 - 1) FROM (SELECT *, unnest([n, n - 1]) AS m FROM long)),
pairs AS (SELECT DISTINCT a.line AS a, a.first AS a_first, b.line AS b, b.first AS b_first
    FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half
    WHERE a.line <> b.line AND length(a.line) <= length(b.line) AND length(a.line) = a.m),
near AS (SELECT CASE WHEN a_first < b_first THEN b ELSE a END AS line FROM pairs WHERE {NEAR_SQL.format(a="a", b="b")}),
kept AS MATERIALIZED (SELECT first.doc_id AS doc_id, first.place AS place FROM (
    SELECT {{'doc_id': first[1], 'place': first[2]}} AS first FROM firsts WHERE line NOT IN (SELECT line FROM near)))
SELECT c.doc_id, count(*) FILTER (WHERE l.line <> '') AS n_lines, count(k.place) AS n_kept,
    sha256(coalesce(string_agg(c.raw, chr(10) ORDER BY c.place) FILTER (WHERE l.line = '' OR k.place IS NOT NULL), '')) AS text_sha256
FROM cut c JOIN lines l ON c.doc_id = l.doc_id AND c.place = l.place
LEFT JOIN kept k ON c.doc_id = k.doc_id AND c.place = k.place GROUP BY c.doc_id"""
