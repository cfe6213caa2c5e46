"""URL filters: rules of a list, and gradient-boosted trees on lexical features for what no rule covers.

The trees learn from labelled URLs: those that a rule decides. Features are lengths, depth, digit share, entropy of the
characters, counts of labels, hyphens and parameters, and statistics of the host's suffix: the blocked share and the count of
the labelled URLs with it. They are out of fold: a host's own fifth of the hosts does not count for its labelled URLs. The
path segments that rules read give no statistics, so that the trees do not copy the rules.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged by the trees alone; repeated
rows are judged one by one; where the labelled URLs are of one verdict only, that is the verdict of the trees, and `allow`
where there are none; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import picked
from meterlake.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MOST_RULES = 500  # a list that people keep; it becomes one expression
FOLDS = 5
SAMPLE = 50_000  # labelled URLs to learn from, about
COUNTED = ["n_url", "n_host", "n_path", "depth", "labels", "longest_label", "digits", "hyphens", "dots", "params", "marks", "entropy"]
STATISTICS = ["suffix_blocked", "suffix_n"]


@dataclass(frozen=True)
class Rule:
    """`host` and all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, PARTS, 1), UPPER, LOWER), F.regexp_extract(known, PARTS, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, str(rule)).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")).cast("double")


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def with_features(rows: DataFrame) -> DataFrame:
    """`rows` with url, host and path gets the features that need no labels, and the suffix."""
    url = F.coalesce("url", F.lit(""))
    labels = F.split("host", r"\.")
    length = lambda c: F.length(c).cast("double")
    longest = F.aggregate(labels, F.lit(0), lambda a, b: F.greatest(a, F.length(b)))
    return rows.withColumns(
        {
            "n_url": length(url),
            "n_host": length("host"),
            "n_path": length("path"),
            "depth": _count(F.col("path"), "/"),
            "labels": F.size(labels).cast("double"),
            "longest_label": longest.cast("double"),
            "digits": _count(url, "0-9") / F.greatest(length(url), F.lit(1.0)),
            "hyphens": _count(url, "-"),
            "dots": _count(F.col("path"), "."),
            "params": F.when(F.contains(url, F.lit("?")), _count(F.substring_index(F.regexp_replace(url, "(?s)^[^?]*[?]", ""), "#", 1), "&") + 1).otherwise(0.0),
            "marks": _count(url, "%@~_=+"),
            "entropy": _entropy(url),
            "suffix": F.element_at(labels, -1),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Blocked share, drawn towards one half, and log count of the labelled URLs by suffix: of all (fold -1), and of those in
    other folds than `fold`."""
    own = labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    of_all = Window.partitionBy("suffix")  # FOLDS rows at most
    rest = own.withColumns({"b": F.sum("b").over(of_all) - F.col("b"), "n": F.sum("n").over(of_all) - F.col("n")})
    both = rest.unionByName(own.groupBy("suffix").agg(F.lit(-1).alias("fold"), F.sum("b").alias("b"), F.sum("n").alias("n")))
    blocked = (F.col("b") + 1.0) / (F.col("n") + 2.0)
    return durable(both.select("suffix", "fold", blocked.alias("suffix_blocked"), F.log1p("n").alias("suffix_n")))


def _joined(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """`rows` with the statistics of their suffix, a written table, so that Spark knows its size."""
    return rows.join(statistics, ["suffix", "fold"], "left").na.fill({"suffix_blocked": 0.5, "suffix_n": 0.0})


def train(labelled: DataFrame, sample: int, seed: int) -> GBTClassificationModel | float:
    """Boosted trees, or the verdict of all labelled URLs where there is only one (0.0 where there are none)."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    share = min(1.0, sample / sum(counts.values()))
    chosen = labelled.where(F.xxhash64("url").bitwiseAND(F.lit((1 << 32) - 1)) < int(share * (1 << 32)))
    vectors = VectorAssembler(inputCols=COUNTED + STATISTICS, outputCol="x").transform(chosen).select("x", "label")
    trees = GBTClassifier(featuresCol="x", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=seed)
    return trees.fit(durable(vectors))  # written, so that a boosting round reads numbers and not URLs


def judge(
    pages: DataFrame, rules: Sequence[Rule], id: str = "page_id", url: str = "url", sample: int = SAMPLE, seed: int = 7
) -> DataFrame:
    """`id`, host, path, rule, verdict, and the probability that the trees give for `block`."""
    host, path = host_and_path(F.col("url"))
    rows = picked(pages, id=id, url=url).withColumns({"host": host, "path": path})
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = with_features(rows.withColumns({"rule": name, "ruled": verdict}))
    fold = F.when(F.col("ruled").isNull(), -1).otherwise(F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    rows = rows.withColumn("fold", fold)
    labelled = rows.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    statistics = suffix_statistics(labelled)
    model = train(_joined(labelled, statistics), sample, seed)
    full = _joined(rows, statistics)
    if isinstance(model, float):
        scored = full.withColumn("blocked", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=COUNTED + STATISTICS, outputCol="x").transform(full)
        scored = model.transform(vectors).withColumn("blocked", F.element_at(vector_to_array("probability"), 2))
    trees = F.when(F.col("blocked") > 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce("ruled", trees).alias("verdict"), "blocked"
    )
