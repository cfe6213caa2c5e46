"""Each stage against a plain version of what it has to do, on the output of the stage before."""

import re

import pytest

import corpus_pipeline
from meterlake.llm import quality
from meterlake.llm.common import alphanumeric_words
from meterlake.llm.queries import op6_quality, tokenizer_path
from meterlake.session import durable
from test_jaccard_groups import brute as jaccard_brute
from test_line_dedup import brute as line_brute
from test_packing import direct, whole

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, folder))
        out.append(docs)
    return [d.collect() for d in out]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    for rows in stages[1:-1]:
        assert rows and list(rows[0].asDict()) == COLUMNS
        assert len({r.doc_id for r in rows}) == len(rows)


def test_quality_keeps_what_scores_high_enough(spark, folder, stages):
    kept = {r.doc_id for r in op6_quality(spark, folder).collect() if r.score >= quality.KEEP_FROM}
    before = {r.doc_id: r for r in stages[0]}
    assert {r.doc_id for r in stages[1]} == kept and all(r == before[r.doc_id] for r in stages[1])
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept) / len(good) > 0.97


def test_line_dedup_leaves_no_repeated_line(stages):
    expected = line_brute([(r.doc_id, r.text) for r in stages[1]], 20)
    assert {r.doc_id: r.text for r in stages[2]} == {i: t for i, (t, n, k) in expected.items() if k or not n}
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2]]
    assert {r.doc_id for r in stages[3]} == {i if i >= 0 else 0 for i, _, c in jaccard_brute(rows, 5, 80) if c == (i if i >= 0 else 0)}


def test_no_benchmark_passage_is_left(spark, folder, stages):
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = alphanumeric_words(r.text)
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        words = alphanumeric_words(text)
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3] if not hit(r.text)}


def test_packed_sequences_hold_all_that_is_left(stages):
    assert whole(stages[5], 1024) == {r.doc_id: direct(r.text) for r in stages[4]}


def test_run_gives_the_pieces_of_the_last_stage(spark, folder, stages):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in stages[5])
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[5]}


def test_stages_on_odd_and_empty_tables(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "Some words here.\nMore words there.", None, "s", 3)]
    docs = spark.createDataFrame(odd, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, folder))
        assert docs.columns == COLUMNS
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} <= {None, 1, 2}
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, folder))
    assert docs.count() == 0


def test_guard_is_in_the_entry_alone():
    """The pipeline and the operators raise import errors; only the entry point looks whether they are there."""
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except\s+\(?(ImportError|ModuleNotFoundError|Exception)", source)
    assert tokenizer_path().endswith(".json")
