import random

from frames import by_id, docs
from meterlake.llm import decontaminate
from meterlake.llm.common import alphanumeric_words

ITEMS = "item_id long, text string"


def brute(text, items, n):
    words, hit, found = alphanumeric_words(text), set(), set()
    for item, t in items:
        w = alphanumeric_words(t)
        size = min(n, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1 if wins else 0):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found)


def test_scan_matches_brute_force_in_any_number_of_blocks(spark):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "été", "x9", "z", "ÉTÉ", "the"]
    sentence = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, sentence(rng.randint(1, 9))) for i in range(12)]
    items += [(3, "other text"), (20, None), (21, ""), (22, "?!"), (None, "alpha beta z"), (0, items[0][1]), (0, items[0][1])]
    rows = [(i, sentence(rng.randint(0, 60))) for i in range(40)] + [(90, None), (91, ""), (7, "the the the")]
    rows.append((99, " ".join(rng.choices(vocabulary, k=30_000))))
    benchmark = spark.createDataFrame(items, ITEMS)
    for block_bytes in (1 << 20, 60):
        found = decontaminate.scan(docs(spark, rows), benchmark, n=4, block_bytes=block_bytes).collect()
        got = sorted((r.doc_id, r.n_words, sum(x.last - x.first for x in r.runs), tuple(r["items"])) for r in found)
        expected = []
        for i, t in rows:
            words, hit, names = brute(t, items, 4)
            expected.append((i, words, hit, tuple(names)))
        assert got == sorted(expected)


def test_remove_cuts_spans_or_documents(spark):
    rows = [
        (1, "Keep this. ONE two, three four! And that.", 1, "a"),
        (2, "one two three four", 2, "b"),
        (3, "nothing here", None, None),
        (4, None, 4, "d"),
        (5, "one two three; one two three four five", 5, "e"),
    ]
    frame = docs(spark, rows, "doc_id long, text string, items long, n_words string")  # names the operator uses itself
    benchmark = spark.createDataFrame([(1, "one two three four")], ITEMS)
    cut = by_id(decontaminate.remove(frame, benchmark, n=4))
    assert {i: r.text for i, r in cut.items()} == {
        1: "Keep this. ! And that.",
        3: "nothing here",
        4: None,
        5: "one two three;  five",
    }
    assert cut[1]["items"] == 1 and cut[5].n_words == "e"
    assert sorted(by_id(decontaminate.remove(frame, benchmark, mode="documents", n=4))) == [3, 4]


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "one two three four")], ITEMS)
    assert decontaminate.scan(docs(spark, []), benchmark).collect() == []
    found = decontaminate.scan(docs(spark, [(1, "one two"), (None, "one two")]), spark.createDataFrame([], ITEMS)).collect()
    assert [(r.doc_id, r.n_words, r.runs) for r in found] == [(1, 2, []), (None, 2, [])]
