"""Importance resampling against a plain count, a plain sort, and odd rows."""

import hashlib
import math
import re
import zlib

import pytest
from frames import by_id, docs

from meterlake.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, percent=10, least_words=20, buckets=10_000, longest=1, seed=2024):
    lower = {i: i + 32 for i in range(65, 91)}

    def features(text):
        words = WORD.findall((text or "").translate(lower))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    bags = [features(t) for _, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, bag in bags:
        for b in bag:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for (id, _), (n, bag) in zip(rows, bags):
        weight = sum(gain[b] for b in bag) // len(bag) if bag else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        out.append([id, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(spark, rows, target, **how):
    frame = importance.resample(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), **how)
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def texts(n):
    return [(i, " ".join(f"w{(i * j) % 97} Ünï{j % 7}" for j in range(i % 40))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"percent": 100}, {"percent": 0}, {"longest": 3, "buckets": 50}, {"least_words": 0, "percent": 37}])
def test_matches_plain(spark, how):
    rows = texts(300)
    target = ["w3 w5 Ünï1 w3", "", None, "W5 w50"]
    assert found(spark, rows, target, **how) == plain(rows, target, **how)


def test_rounds_of_medians_give_the_same_cutoff(spark):
    rows = texts(700)
    assert found(spark, rows, ["w1 w2"], last=1, percent=33) == plain(rows, ["w1 w2"], percent=33)


@pytest.mark.parametrize("wanted", [1, 2, 499, 500, 999, 1000])
def test_cutoff_with_many_ties(spark, wanted):
    frame = spark.range(1000).selectExpr(
        "id % 3 AS score", "IF(id % 5 = 0, NULL, id % 2) AS id", "CAST(id % 7 AS INT) AS part", "id AS place"
    )
    keys = importance.keyed(frame.repartition(9))
    expected = sorted((tuple(r) for r in keys.select(*importance.KEY).collect()), key=importance._in_order)[wanted - 1]
    assert importance.cutoff(keys, wanted, last=1) == expected


def test_cutoff_beyond_the_rows(spark):
    keys = importance.keyed(spark.createDataFrame([(1, 1, 0, 0)], "score long, id long, part int, place long"))
    assert importance.cutoff(keys, 0) is None
    with pytest.raises(ValueError):
        importance.cutoff(keys, 2)


def test_nulls_repeats_empty_and_long_texts(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "Word " * 50_000), (3, "Word " * 50_000), (4, "--   !")]
    how = {"least_words": 1, "percent": 50}
    assert found(spark, rows, ["word"], **how) == plain(rows, ["word"], **how)


def test_a_row_repeated_on_a_third_of_all(spark):
    rows = [(7, "alpha beta " * 12)] * 200 + texts(400)
    assert found(spark, rows, ["alpha"], last=5) == plain(rows, ["alpha"])


def test_empty_tables_and_clashing_names(spark):
    assert found(spark, [], ["a"]) == []
    rows = texts(60)
    assert found(spark, rows, []) == plain(rows, [])
    schema = "doc_id long, text string, id string, score string, part string, rank string, name string"
    wide = docs(spark, [(i, t, "x", "y", "z", "r", "n") for i, t in rows], schema)
    got = importance.resample(wide, spark.createDataFrame([("w1", 5)], "text string, n long"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, ["w1"])


def test_ids_of_text(spark):
    frame = spark.createDataFrame([(f"d{i}", t) for i, t in texts(100)], "key string, body string")
    got = importance.resample(frame, spark.createDataFrame([("w1",)], "text string"), id="key", text="body", percent=50)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    scores = [r["score"] for r in got.where("rank is not null").orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True)


def test_bad_settings(spark):
    frame = docs(spark, [(1, "a")])
    for how in ({"percent": 101}, {"buckets": 0}, {"longest": 0}, {"last": 0}):
        with pytest.raises(ValueError):
            importance.resample(frame, frame, **how)


def test_likeness_to_the_target_raises_the_weight(spark):
    rows = [(1, "solve the equation for x " * 5), (2, "buy cheap watches now " * 5)]
    got = by_id(importance.resample(docs(spark, rows), spark.createDataFrame([("solve the equation",)], "text string")))
    assert got[1]["weight"] > got[2]["weight"]
