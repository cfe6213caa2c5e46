import random
import zlib

import numpy as np

from frames import docs
from meterlake.llm import quality
from meterlake.llm.queries import op6_quality

LABELS = "doc_id long, quality int"


def auc(scores, marks):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    marks = np.array(marks)
    n = marks.sum()
    return (ranks[marks == 1].sum() - n * (n + 1) / 2) / (n * (len(marks) - n))


def corpus(n=500):
    rng = random.Random(3)
    words = [f"w{k}x" for k in range(80)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        picked = rng.choices(words, k=rng.randint(5, 60))
        rows.append((i, " ".join(picked) + "." if good else " ".join(w.upper() + "!!" for w in picked)))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_of_the_query(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op6_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for _, y, p in held) / len(held) >= 0.9


def test_learns_from_positives_and_unlabelled_text(spark):
    rows, labels = corpus()
    only_good = [x for x in labels if x[1] == 1]
    model = quality.train(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    x = np.array([quality.features(t) for _, t in rows], float)
    good = [int("!!" not in t) for _, t in rows]
    assert auc(model.score(x), good) > 0.98
    trained = quality.fit(x[[i for i, _ in only_good]], everything(x), x.mean(0), x.std(0) + 1e-4, 0.8)
    assert auc(trained.margin(x), good) > 0.95


def everything(x, width=24):
    """Mean loss of all rows as negatives and its gradient, in one piece."""

    def unlabelled(w, mean, scale):
        total = quality.risk(np.clip((x - mean) / scale, -8, 8), w, width, 1) / len(x)
        return total[0], total[1:]

    return unlabelled


def test_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(9, quality.N_FEATURES)), rng.normal(size=quality.N_FEATURES * 2 + 5) / 4
    for sign in (-1, 1):
        found = quality.risk(x, w, 2, sign)
        for k in (0, 7, 2 * quality.N_FEATURES, len(w) - 3, len(w) - 1):
            e = np.eye(len(w))[k] * 1e-6
            slope = (quality.risk(x, w + e, 2, sign)[0] - quality.risk(x, w - e, 2, sign)[0]) / 2e-6
            assert abs(slope - found[1 + k]) < 1e-5


def test_every_unlabelled_row_is_summed_whatever_the_sample(spark):
    rows, labels = corpus(300)
    model = quality.train(docs(spark, rows * 2), spark.createDataFrame(labels, LABELS), sample=40)
    x = np.array([quality.features(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5], float)
    assert np.allclose(model.mean, x.mean(0), atol=1e-6) and np.allclose(model.scale, x.std(0) + 1e-4, rtol=1e-3, atol=1e-6)
    w = np.random.default_rng(2).normal(size=quality.N_FEATURES * 2 + 5) / 4
    table = spark.createDataFrame([(quality.features(t).tobytes(),) for _, t in rows], "x binary").repartition(4)
    n, total = quality._summed(table, lambda x: quality.risk(x, w, 2, 1))
    assert n == len(rows)
    assert np.allclose(total, quality.risk(np.array([quality.features(t) for _, t in rows], float), w, 2, 1), rtol=1e-6, atol=1e-6)


def test_held_out_labels_are_never_learned(spark):
    rows, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = quality.train(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    b = quality.train(docs(spark, rows), spark.createDataFrame(flipped, LABELS))
    x = np.array([quality.features(t) for _, t in rows], float)
    assert np.allclose(a.score(x), b.score(x))


def test_nulls_repeats_conflicts_and_empty_tables(spark):
    rows, labels = corpus(120)
    odd = [(None, "text"), (500, None), (500, None), (501, ""), (502, "long " * 50_000)]
    marks = labels + labels + [(None, 1), (7, None), (rows[2][0], 0), (rows[2][0], 1)]
    model = quality.train(docs(spark, rows + odd), spark.createDataFrame(marks, LABELS))
    frame = docs(spark, rows + odd).selectExpr("*", "'x' as score", "1 as label", "2 as `any`")
    found = quality.score(frame, model)
    assert found.columns == ["doc_id", "text", "label", "any", "score"]
    got = found.collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert quality.score(docs(spark, []), model).collect() == []
    none = quality.train(docs(spark, []), spark.createDataFrame([], LABELS))
    assert [r.score for r in quality.score(docs(spark, [(1, "a")]), none).collect()] == [0.5]
