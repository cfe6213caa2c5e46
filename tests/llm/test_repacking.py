"""Best-fit packing: bounds against exhaustive search, every id in one place, exchange never worse."""

from collections import defaultdict

import numpy as np
import pytest
from frames import docs
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import repacking
from meterlake.llm.queries import tokenizer_path

SIZES = st.lists(st.integers(1, 12), min_size=1, max_size=8)


def fewest(sizes, length):
    """Bins of the best of all packings."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, length - sizes[k]])

    best += 1
    place(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(SIZES)
def test_bound_and_packing_around_the_optimum(sizes):
    array = np.array(sizes)
    bins, offsets = repacking.best_fit_decreasing(array, 12)
    assert repacking.least_bins(array, 12) <= fewest(sizes, 12) <= bins.max() + 1
    for b in range(bins.max() + 1):
        inside = sorted(zip(offsets[bins == b], array[bins == b]))
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
        assert sum(n for _, n in inside) <= 12


@pytest.mark.parametrize("length", [1, 2, 3, 7, 30, 1024])
def test_functions_are_dual_feasible(length):
    values, full = repacking.dual_feasible(length)
    rng = np.random.default_rng(length)
    for _ in range(200):  # any way to fill a bin
        room, sums = length, np.zeros(len(values), np.int64)
        while room:
            size = int(rng.integers(1, room + 1))
            room -= size
            sums += values[:, size]
        assert (sums <= full).all()


def test_bounds_beyond_the_sum():
    assert repacking.least_bins(np.array([513] * 10), 1024) == 10
    assert repacking.least_bins(np.array([342] * 10), 1024) == 5
    assert repacking.least_bins(np.array([342] * 4 + [600] * 4), 1024) == 4


def items(spark, sizes):
    rows = [(k % 3, k, int(n)) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "part int, place long, size long")


def bins_of(rows, sizes, length):
    inside = defaultdict(list)
    for r in rows:
        inside[r["bin"]].append((r["offset"], int(sizes[r["place"]])))
    for found in inside.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) <= length
    return len(inside)


def test_exchange_saves_bins_and_loses_nothing(spark):
    sizes = np.random.default_rng(1).integers(1, 60, 600)
    alone = repacking.best_fit(items(spark, sizes), 100, group=20, rounds=0).collect()
    exchanged = repacking.best_fit(items(spark, sizes), 100, group=20, rounds=4).collect()
    for rows in (alone, exchanged):
        assert sorted(r["place"] for r in rows) == list(range(600))
    least = repacking.least_bins(sizes, 100)
    assert least <= bins_of(exchanged, sizes, 100) < bins_of(alone, sizes, 100)
    assert bins_of(exchanged, sizes, 100) <= least + 5


def test_one_certified_group_is_the_optimum(spark):
    sizes = [60, 40, 50, 50, 99, 1]
    rows = repacking.best_fit(items(spark, sizes), 100).collect()
    assert bins_of(rows, sizes, 100) == 3 and all(r["certified"] for r in rows)


def test_a_size_on_a_third_of_the_items(spark):
    sizes = [51] * 300 + [int(n) for n in np.random.default_rng(2).integers(1, 50, 600)]
    rows = repacking.best_fit(items(spark, sizes), 100, group=100).collect()
    assert bins_of(rows, sizes, 100) <= repacking.least_bins(np.array(sizes), 100) + 3


def pieces(spark, rows, schema="doc_id long, text string", **how):
    return repacking.pack_best_fit(docs(spark, rows, schema), tokenizer_path(), **how).collect()


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def assert_whole(found, rows, length):
    """Every document is there as often as it occurs, cut as stated, and sequences have neither gaps nor overlaps."""
    bodies, sequences = defaultdict(list), defaultdict(list)
    for p in found:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        bodies[p["doc_id"], p["piece"], p["start"]].append(tuple(ids))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    expected = defaultdict(list)
    for (id, _), ids in zip(rows, encoded([t for _, t in rows])):
        start, size = 0, len(ids) % length or min(length, len(ids))
        for piece in range(-(-len(ids) // length)):
            expected[id, piece, start].append(tuple(ids[start : start + size]))
            start, size = start + size, length
    assert {k: sorted(v) for k, v in bodies.items()} == {k: sorted(v) for k, v in expected.items()}
    for inside in sequences.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
        assert sum(n for _, n in inside) <= length
    return len(sequences)


ODD = [(1, None), (2, ""), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "x y"), (5, "Ünï ☃ 文字"), (6, "one two " * 40)]


@pytest.mark.parametrize("length", [1, 5, 16, 1024])
def test_nulls_repeats_and_exact_multiples(spark, length):
    assert_whole(pieces(spark, ODD, length=length), ODD, length)


def test_whole_texts_of_any_length(spark):
    rows = [(1, "word " * 60_000), (2, "short")]
    assert assert_whole(pieces(spark, rows), rows, 1024) == -(-60_003 // 1024)


def test_documents_of_the_table(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    n = assert_whole(pieces(spark, rows, group=50), rows, 1024)
    total = sum(map(len, encoded([t for _, t in rows])))
    assert n <= 1.02 * -(-total // 1024)


def test_empty_table_and_clashing_names(spark):
    assert pieces(spark, []) == []
    rows = [(i, f"text {i} " * i) for i in range(20)]
    wide = [(i, t, 1, 2, "n", b"x") for i, t in rows]
    found = pieces(spark, wide, "doc_id long, text string, part int, place long, n string, ids binary")
    assert_whole(found, rows, 1024)


def test_bad_settings(spark):
    for how in ({"length": 0}, {"group": 0}, {"rounds": -1}):
        with pytest.raises(ValueError):
            repacking.pack_best_fit(docs(spark, []), tokenizer_path(), **how)
