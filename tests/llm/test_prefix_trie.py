"""The trie of conversations against a plain dictionary of prefixes, at every size of shard."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meterlake.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, every=20, starts=4):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % starts
        path = tuple(convs.get(c - c % every, [])[:h] + convs[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(inside) - 1) * len(WORD.findall(path[-1][1])) if path else 0
    return sorted(
        (
            inside[0], len(path), members[path[:-1]][0] if path else None, len(inside), len(children[path]), leaves[path],
            saved[path], hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
        )
        for path, inside in members.items()
    )


def found(spark, rows, schema=SCHEMA, **how):
    frame = trie.prefix_trie(spark.createDataFrame(rows, schema), **how)
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0], r[1]))


def talks(n, seed=0):
    rng = random.Random(seed)
    said = ["hello", "hello there\tyou", "", None, "a  b c", "ünï\x0bx"]
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in range(n) for t in range(rng.randrange(1, 6))]


def test_parentheses_delimit_subtrees():
    rng = random.Random(3)
    for _ in range(200):
        steps = [b"".join(bytes([rng.randrange(3)]) * trie.WIDTH for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 40))]
        depths = trie.Trie.of(sorted(steps)).depths
        opens, closes = trie.opening_and_closing(depths)
        for at, depth in enumerate(depths):
            after = next((k for k in range(at + 1, len(depths)) if depths[k] <= depth), len(depths))
            assert (closes[at] + 1 - opens[at]) // 2 == after - at


def test_a_very_deep_path():
    opens, closes = trie.opening_and_closing(np.arange(100_001))
    assert (closes == 200_001 - opens).all()


@pytest.mark.parametrize("shard", [1, 4, 20_000])
def test_matches_plain(spark, shard):
    rows = talks(150)
    assert found(spark, rows, shard=shard) == plain(rows)


def test_copies_of_one_conversation_over_many_shards(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    rows = same + [(c + 300, t, r, x) for c, t, r, x in talks(100, 5)]
    assert found(spark, rows, shard=7) == plain(rows)


def test_other_grafts(spark):
    rows = talks(90, 2)
    assert found(spark, rows, every=7, starts=6, shard=5) == plain(rows, 7, 6)
    assert found(spark, rows, starts=1, shard=5) == plain(rows, starts=1)


def test_nulls_repeats_ties_and_gaps(spark):
    rows = [
        (None, 1, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 3, "user", "b"), (1, 3, "user", "a"),
        (1, 3, "assistant", "z"), (41, 0, "user", "no head"), (43, 0, "user", "x y"), (-5, 1, "user", "below zero"),
        (9_000_000_000, 0, "", ""), (60, 5, None, "head"), (61, 5, "user", "own"), (62, 1, "user", "own"), (62, 2, "user", "own"),
    ]
    got = found(spark, rows, shard=2)
    rebuilt = [r for r in rows if r[0] != -5]
    assert found(spark, rebuilt, shard=2) == plain(rebuilt)
    assert sum(r[3] for r in got if r[1] == 0) == 8  # the root holds all, with those that have lost all turns


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(21, 40)]  # no head: of some, nothing is left
    got = found(spark, rows)
    assert got == plain(rows)
    assert got[0][7] != hashlib.sha256(b"").hexdigest()


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    rows = talks(40, 7)
    schema = SCHEMA + ", id long, path string, words string, shard int, depth string"
    assert found(spark, [(*r, 1, "p", "w", 2, "d") for r in rows], schema) == plain(rows)


def test_long_texts_and_long_conversations(spark):
    rows = [(1, 0, "user", "word " * 200_000), (2, 0, "user", "word " * 200_000)] + [(3, t, "user", f"{t}") for t in range(3_000)]
    got = {(r[0], r[1]): r for r in found(spark, rows, starts=1)}
    assert got[1, 1][3] == 2 and got[1, 1][6] == 200_000
    assert got[3, 3_000][2] == 3 and got[1, 0][5] == 2 and len(got) == 3_002
