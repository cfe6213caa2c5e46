import random

import pytest
from pyspark.sql import functions as F

from frames import docs
from meterlake.llm import jaccard_groups


def grams(text, words):
    parts = (text or "").encode().lower().split()
    width = min(words, len(parts))
    return {tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)} if parts else set()


def brute(rows, words, percent):
    """Component of every row by comparing all pairs."""
    sets = [grams(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            ids[find(i)] = min(id, ids.get(find(i), id))
    return sorted(((id or -1, len(sets[i]), ids.get(find(i)) if sets[i] else id) for i, (id, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits, fresh):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        how = rng.randrange(3)
        if how == 0:
            out[at] = rng.choice(fresh)
        elif how == 1:
            out.insert(at, rng.choice(fresh))
        elif len(out) > 1:
            del out[at]
    return out


def corpus(seed, templates, copies, length, most_edits, fresh_size):
    """Copies of templates, with few fresh words so that edits recur, cut and glued in places, plus unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    fresh = [f"f{k}" for k in range(fresh_size)]
    line = rng.choices(vocabulary, k=14)
    rows = []
    for _ in range(templates):
        base = rng.choices(vocabulary, k=rng.randint(*length))
        for _ in range(rng.randint(1, copies)):
            words = edited(rng, base, rng.randint(0, most_edits), fresh)
            if rng.random() < 0.3:
                words += line
            if rng.random() < 0.2:
                words = words[: max(1, int(len(words) * rng.uniform(0.8, 1)))]
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i * 3 % 997 + (i // 997) * 1000, t) for i, t in enumerate(rows)]


def result(found):
    return sorted(((r.doc_id or -1 if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in found.collect()), key=repr)


def expected(rows, words, percent):
    return sorted(((-1 if id == -1 else id or -1, n, c) for id, n, c in brute(rows, words, percent)), key=repr)


@pytest.mark.parametrize(
    ("seed", "templates", "copies", "length", "most_edits", "fresh", "words", "percent", "small"),
    [
        (1, 30, 12, (3, 60), 4, 3, 4, 85, 1_000_000),
        (2, 6, 60, (40, 120), 9, 2, 4, 85, 0),
        (4, 3, 120, (60, 90), 10, 5, 5, 70, 1_000_000),
        (5, 40, 6, (1, 6), 2, 3, 4, 60, 1_000_000),
    ],
)
def test_components_match_brute_force(spark, seed, templates, copies, length, most_edits, fresh, words, percent, small):
    rows = corpus(seed, templates, copies, length, most_edits, fresh)
    found = jaccard_groups.link(docs(spark, rows).repartition(5), words, percent, small=small)
    assert result(found) == expected(rows, words, percent)


def test_a_chain_through_a_member_is_found(spark):
    """b is linked to a member of the leader's group and not to the leader."""
    base = [f"w{k}" for k in range(100)]
    change = lambda n: [f"x{k}" if k < n else w for k, w in enumerate(base)]
    rows = [(1, " ".join(base))] + [(k, " ".join(change(k - 1))) for k in range(2, 14)]
    found = jaccard_groups.link(docs(spark, rows), 1, 85)
    assert result(found) == expected(rows, 1, 85) and {c for _, _, c in result(found)} == {1}
    assert jaccard_groups.Join(docs(spark, rows), 1, 85, "doc_id", "text", 10).bounds.larger(20) == 17


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200), (300, 200)]
    rng = random.Random(6)
    rng.shuffle(edges)
    got = {r.node: r.root for r in jaccard_groups.components(spark.createDataFrame(edges, "l long, r long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(50)}, 300: 200, 200: 200}
    assert jaccard_groups.components(spark.createDataFrame([], "l long, r long")).collect() == []


def test_nulls_repeats_long_texts_and_extra_columns(spark):
    long = " ".join(f"w{k * k % 7919}" for k in range(60_000))
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (3, "A B\tc d e f\ng h"), (None, "a b c d e f g h"), (6, None), (7, ""), (8, " \n ")]
    rows += [(None, "z y"), (None, "z y"), (9, long), (10, long + " end"), (11, "one"), (12, "one "), (5, "other text of this id")]
    frame = docs(spark, rows).selectExpr("*", "'n' as node", "1 as n", "2 as th")
    found = jaccard_groups.link(frame)
    assert sorted(((r.doc_id, r.n_shingles > 0, r.component_id) for r in found.collect()), key=repr) == sorted(
        [(5, True, 3), (5, True, 3), (3, True, 3), (None, True, 3), (6, False, 6), (7, False, 7), (8, False, 8)]
        + [(None, True, None), (None, True, None), (9, True, 9), (10, True, 9), (11, True, 11), (12, True, 11), (5, True, 5)],
        key=repr,
    )
    kept = jaccard_groups.representatives(frame, 4, 85)
    assert kept.columns == ["doc_id", "text", "node", "n", "th"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 6, 7, 8, None, None, 9, 11, 5], key=repr)


def test_empty_table(spark):
    assert jaccard_groups.link(docs(spark, [])).collect() == []
    assert jaccard_groups.representatives(docs(spark, [])).collect() == []


def test_bounds_in_sql_equal_those_of_whole_numbers(spark):
    for percent in (60, 80, 85):
        bounds = jaccard_groups.Bounds(percent)
        rows = spark.range(1, 700).withColumnRenamed("id", "n").select("n", F.expr(bounds.larger_sql()).alias("a"), F.expr(bounds.needed_sql()).alias("b"))
        assert all(r.a == bounds.larger(r.n) and r.b == bounds.slack(bounds.larger(r.n)) for r in rows.collect())
