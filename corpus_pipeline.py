"""From raw documents to packed training sequences: five stages, each over all that the one before has kept.

1. quality classifier: documents that score below the threshold go;
2. line dedup: repeated lines go, and documents of which no line is left;
3. n-gram Jaccard join (five words, 0.8): of each group of near copies the smallest id stays;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. packing: token ids cut into sequences.

A stage takes (spark, docs, sf_dir); docs has the columns of `documents`, and all stages but the last return these. Rows
that repeat an id count as stated by each operator; of rows with the id that a group keeps, all stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, jaccard_groups, line_dedup, packing, quality
from meterlake.llm.common import prepared, table
from meterlake.llm.queries import tokenizer_path
from meterlake.session import durable


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, takes as good."""
    prepared(spark)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= quality.KEEP_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has."""
    prepared(spark)
    left = line_dedup.dedup(docs).where("n_kept > 0 or n_lines = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    prepared(spark)
    return jaccard_groups.representatives(docs, words=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    prepared(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their ids."""
    prepared(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack),
]
ORACLE_SQL = None  # the classifier and the tokenizer have no SQL; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
