import random

import pytest
from pyspark.sql import functions as F

from frames import docs
from meterlake.llm import line_dedup


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, near_from):
    """Kept texts of unique (id, text) rows whose ids differ."""
    seen, out = [], {}
    for id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, n_lines, n_kept = [], 0, 0
        for raw in (text or "").split("\n"):
            line = raw.replace("\r", "").strip(" ").lower()
            if not line:
                kept.append(raw)
                continue
            n_lines += 1
            again = any(line == s or (min(len(line), len(s)) >= near_from and within_one(line, s)) for s in seen)
            if not again:
                n_kept += 1
                kept.append(raw)
            seen.append(line)
        out[id] = (None if text is None else "\n".join(kept), n_lines, n_kept)
    return out


def edited(rng, line, alphabet="abcé"):
    at = rng.randrange(len(line) + 1)
    how = rng.randrange(4)
    if how == 0:
        return line[:at] + rng.choice(alphabet) + line[at:]
    if how == 1:
        return line[:at] + line[at + 1 :]
    if how == 2 and at < len(line):
        return line[:at] + rng.choice(alphabet) + line[at + 1 :]
    return line.upper() if rng.random() < 0.5 else line


@pytest.mark.parametrize(("paired", "base", "small"), [(32, 64, 200_000), (1, 64, 0), (1, 3, 200_000), (2, 8, 0)])
def test_every_path_matches_brute_force(spark, paired, base, small):
    rng = random.Random(paired * 100 + base)
    seeds = ["".join(rng.choices("abc é", k=n)).strip() + "." for n in (6, 9, 16, 17, 31, 32, 33, 64, 90)]
    rows = []
    for id in range(60):
        lines = [edited(rng, rng.choice(seeds)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            lines.append(edited(rng, edited(rng, rng.choice(seeds))))
        rows.append((id, "\n".join(lines)))
    rows += [(None, seeds[4] + "\n\n  " + seeds[4]), (100, None), (101, ""), (102, "\n \n")]
    frame = docs(spark, rows).repartition(4)
    found = line_dedup.dedup(frame, near_from=6, paired=paired, base=base, small=small).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in found} == brute(rows, 6)


def test_long_lines_and_hot_keys(spark):
    """Hundreds of lines that agree but for a part in the middle, and a line of 40,000 characters with a copy."""
    rng = random.Random(4)
    head, tail = "h" * 50 + " ", " " + "t" * 50
    middle = lambda k: "".join(random.Random(k).choices("xyz", k=90))
    rows = [(k, head + middle(k % 150) + tail) for k in range(300)]
    rows += [(300 + k, head + edited(rng, middle(k)) + tail) for k in range(40)]
    huge = "".join(rng.choices("abcdefgh ", k=40_000))
    rows += [(900, huge), (901, huge[:20_000] + "!" + huge[20_000:]), (902, huge[:100] + "??" + huge[100:])]
    found = line_dedup.dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in found} == brute(rows, line_dedup.NEAR_FROM)


def test_lines_at_distance_one_share_a_variant(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(900):
        line = "".join(rng.choices("ab", k=k % 70 + 1))
        pairs.append((line, edited(rng, line, "ab").lower()))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for blocks in (2, 4):
        keys = lambda c: F.transform(line_dedup.variants(F.col(c), blocks), lambda v: v["key"])  # noqa: B023, E731
        assert frame.where(~F.arrays_overlap(keys("a"), keys("b"))).count() == 0
    single = frame.select(F.levenshtein("a", "b").alias("d"), F.arrays_overlap(line_dedup.singles(F.col("a")), line_dedup.singles(F.col("b"))).alias("met"))
    assert single.where("met <> (d <= 1)").count() == 0
    others = spark.createDataFrame([(a, d) for a, _ in pairs[:60] for _, d in pairs[60:120:3]], "a string, b string")
    single = others.select(F.levenshtein("a", "b").alias("d"), F.arrays_overlap(line_dedup.singles(F.col("a")), line_dedup.singles(F.col("b"))).alias("met"))
    assert single.where("met <> (d <= 1)").count() == 0


def test_written_out_keys_are_the_variants(spark):
    lines = spark.createDataFrame([("é" * (k % 3) + "".join(random.Random(k).choices("abc", k=k)),) for k in range(200)], "line string")
    keys = line_dedup.with_keys(lines, 5)
    general = F.when(F.length("line") >= 5, F.array_sort(F.transform(line_dedup.variants(F.col("line")), lambda v: v["key"])))
    assert keys.where(~F.array_sort("keys").eqNullSafe(general)).count() == 0


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    rows = [(1, "One line here.\nAnother line here.", 5, "x"), (1, "One line here.\nAnother line here.", 6, None), (2, "one line here. ", None, "y")]
    frame = docs(spark, rows, "doc_id long, text string, places int, n_kept string")
    found = line_dedup.dedup(frame)
    assert found.columns == ["doc_id", "text", "places", "n_lines", "n_kept"]
    assert sorted((r.doc_id, r.text, r.places or 0, r.n_kept) for r in found.collect()) == [
        (1, rows[0][1], 5, 2),
        (1, rows[0][1], 6, 2),
        (2, "", 0, 0),
    ]
    assert line_dedup.dedup(docs(spark, [])).collect() == []
